"""Plain restatements of what the corpus operators return, one row at a time."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def lower(text):
    return (text or "").translate(UPPER)


def simhash(text, k=3):
    words = SPACED.findall(lower(text))
    if not words:
        return 0
    grams = [words[i : i + k] for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def shingles(text, k=5):
    words = SPACED.findall(lower(text))
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def groups(ids, same):
    """Component id (the least id, or None) of each row, where same(i, j) links rows."""
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if find(i) != find(j) and same(i, j):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, id_ in enumerate(ids):
        if id_ is not None:
            least[find(i)].append(id_)
    return [min(least[find(i)], default=None) for i in range(len(ids))]


def components(prints, radius=2):
    """prints: (id, fingerprint) -> component id of each row."""
    return groups([i for i, _ in prints], lambda i, j: (prints[i][1] ^ prints[j][1]).bit_count() <= radius)


def near_copies(rows):
    """rows: (id, text) -> group of each; texts are near if four fifths of their five-word shingles are shared."""
    sets = [shingles(t) for _, t in rows]

    def same(i, j):
        return 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])

    return groups([i for i, _ in rows], same)


def decontaminate(text, items, window=10):
    words = WORDS.findall(lower(text))
    hit, found = set(), set()
    for item, body in items:
        w = WORDS.findall(lower(body))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            gram = w[i : i + window]
            for p in range(len(words) - len(gram) + 1):
                if words[p : p + len(gram)] == gram:
                    hit.update(range(p, p + len(gram)))
                    found.add("" if item is None else str(item))
    sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), sha, bool(hit)


def license_base(text, phrases):
    words = WORDS.findall(lower(text))
    found = []
    for phrase, label in phrases:
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def language_model(docs, mu, boost):
    """docs: (id, text) -> (n_tokens, n_known, train_tokens, base_score, score) of each."""
    held = [id_ is not None and zlib.crc32(str(id_).encode()) % 7 == 2 for id_, _ in docs]
    tokens = [[*SPACED.findall(lower(t)), "\n"] for _, t in docs]
    c, pairs, triples = Counter(), Counter(), Counter()
    for h, t in zip(held, tokens):
        if not h:
            c.update(t)
            c["\r"] += 1
            pairs.update([("\r", "\r"), *zip(["\r", *t], t)])
            triples.update(zip(["\r", "\r", *t], ["\r", *t], t))
    n, v = sum(c.values()) - c["\r"], len(c) - ("\r" in c)
    out = []
    for t in tokens:
        prior = [(c[w] + 1) / (n + v + 1) for w in t]
        joint = [
            (boost * triples[g, h, w] + pairs[h, w] + mu * p) / (boost * pairs[g, h] + c[h] + mu)
            for g, h, w, p in zip(["\r", "\r", *t], ["\r", *t], t, prior)
        ]
        out.append((len(t), sum(c[w] > 0 for w in t), n, sum(map(math.log10, prior)), sum(map(math.log10, joint))))
    return held, out


def scaled(text, scale=4, k=16, bits=48):
    """Sorted distinct hashes below 1 / scale of the hash space, of the k bytes at each byte of a text."""
    odd = lambda i: int.from_bytes(hashlib.sha256(f"multiplier {i}".encode()).digest()[:8], "little") | 1
    data, full = b" ".join(w.encode() for w in SPACED.findall(lower(text))), (1 << 64) - 1
    out = set()
    for i in range(max(1, len(data) - k + 1)) if data else ():
        part = data[i : i + k].ljust(k, b"\0")
        h = sum(int.from_bytes(part[j : j + 8], "little") * odd(j // 8) for j in range(0, k, 8)) & full
        for shift, m in ((33, 100), (29, 101)):
            h = (h ^ h >> shift) * odd(m) & full
        out.add((h ^ h >> 32) >> 64 - bits)
    return sorted(h for h in out if h < (1 << bits) // scale)


def scaled_likeness(a, b):
    n = min(len(a), len(b))
    return (len(set(a) & set(b)) / n if n else float(len(a) == len(b))), n


def neighbour_rows(rows):
    """rows: (id, text), ids distinct -> id, n_chars, sha, fingerprints, likenesses and what they rest on."""
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: -r[0])
    out = []
    for (i, t), (_, after) in zip(order, [*order[1:], *order[:1]]):
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        a, b, c = map(scaled, (t, edited, after))
        shown = ["".join(f"{h:012x}" for h in hashes) for hashes in (a, b)]
        (near, n), (next_, m) = scaled_likeness(a, b), scaled_likeness(a, c)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), *shown, near, next_, n, m))
    return out


def rule_of(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = lower(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(re.match(r"[^/?#]*", rest)[0]) :])[0]
    fits = []
    for verdict, rule in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((len(rule), len(h), rule, verdict))
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def planted(text, id_):
    """Words of a text; of one in ten, by its id's CRC-32, those from some place on repeat."""
    words = SPACED.findall(text or "")
    h = zlib.crc32(str(id_).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def runs(words, least_length, exponent):
    """(start, length, period) of every longest stretch with a smallest period."""
    out, n = [], len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least_length, exponent * q):
                part = words[i : i + length]
                if all(part[p:] != part[:-p] for p in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def without_repeats(words, found):
    gone = {i for a, n, p in found for i in range(a + p, a + n)}
    return [w for i, w in enumerate(words) if i not in gone]
