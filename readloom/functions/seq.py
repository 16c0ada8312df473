"""Column functions over sequences, labels and scores; all built-in expressions, nothing leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from readloom.functions.draws import pick
from readloom.schema import ENCODINGS, IUPAC, LABELS


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def letters(seq: Column) -> Column:
    """One element a character; an empty sequence has none."""
    return F.when(F.length(seq) > 0, F.split(seq, "")).otherwise(F.array().cast("array<string>"))


def reverse_complement(seq: Column) -> Column:
    """Upper-case; anything but A, C, G, T becomes N."""
    return F.reverse(F.translate(F.regexp_replace(F.upper(seq), "[^ACGT]", "N"), "ACGT", "TGCA"))


def gc_content(seq: Column) -> Column:
    """Share of G and C; 0 for an empty sequence."""
    return F.coalesce(F.try_divide((F.length(seq) - F.length(F.translate(seq, "GCgc", ""))).cast("double"), F.length(seq)), F.lit(0.0))


def polya_length(seq: Column, least: int = 10, lookback: int = 2000) -> Column:
    """Characters that trimming takes off the end: the As of a tail of A and N, if there are ``least`` or more."""
    tail = F.regexp_extract(F.right(seq, F.lit(lookback)), "[AN]*$", 0)
    n = F.length(F.translate(tail, "N", ""))
    return F.when(n >= least, n).otherwise(0)


def trim_polya(seq: Column, least: int = 10, lookback: int = 2000) -> Column:
    """Takes as many characters off the end as the tail has As, so Ns inside the tail leave As behind."""
    return F.left(seq, F.length(seq) - polya_length(seq, least, lookback))


def iupac_regex(pattern: str) -> str:
    return "^" + "".join(f"[{IUPAC[c]}]" if c in IUPAC else "(?!)" for c in pattern.upper()) + "$"


def iupac_match(seq: Column, pattern: str) -> Column:
    """Same length and every base allowed by the pattern's code; an unknown code never matches."""
    return F.upper(seq).rlike(iupac_regex(pattern))


def iupac_resolve(seq: Column, seed: int, row: Column) -> Column:
    """Every ambiguity code replaced by one of its bases, drawn by seed, row and place; unknown: any base."""
    bases = F.create_map(*[x for c, b in IUPAC.items() for x in (F.lit(c), F.lit(b))])

    def one(c: Column, i: Column) -> Column:
        among = F.coalesce(F.try_element_at(bases, c), F.lit("ACGT"))
        return F.substring(among, pick(seed, F.length(among), row, i) + 1, F.lit(1))

    return F.array_join(F.transform(letters(F.upper(seq)), one), "")


def encode(seq: Column, encoding: str = "training") -> Column:
    """Numbers of the bases, upper or lower case."""
    table, other = ENCODINGS[encoding]
    known = F.create_map(*[F.lit(x) for item in table.items() for x in item])
    return F.transform(letters(F.upper(seq)), lambda c: F.coalesce(F.try_element_at(known, c), F.lit(other)))


def decode(codes: Column, encoding: str = "one_based", drop: int | None = 0) -> Column:
    """Bases of numbers; ``drop`` leaves one number out (padding), unknown numbers become N."""
    table, _ = ENCODINGS[encoding]
    back = {n: b for b, n in table.items() if b != "U"}
    known = F.create_map(*[F.lit(x) for item in back.items() for x in item])
    kept = codes if drop is None else F.filter(codes, lambda x: x != drop)
    return F.array_join(F.transform(kept, lambda x: F.coalesce(F.try_element_at(known, x), F.lit("N"))), "")


def encode_labels(labels: Column, vocabulary: Sequence[str] = LABELS, unknown: int = 0) -> Column:
    known = F.create_map(*[x for i, v in enumerate(vocabulary) for x in (F.lit(v), F.lit(i))])
    return F.transform(labels, lambda v: F.coalesce(F.try_element_at(known, v), F.lit(unknown)))


def pad(values: Column, n: int, filler: Column | int = 0) -> Column:
    """Exactly n elements: cut, or filled up at the end."""
    filler = filler if isinstance(filler, Column) else F.lit(filler)
    return F.slice(F.concat(values, F.array_repeat(filler, n)), 1, n)


def one_hot(labels: Column, k: int) -> Column:
    return F.transform(labels, lambda v: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(i == v, 1).otherwise(0)))


def phred_error(quality: Column) -> Column:
    return F.pow(F.lit(10.0), -quality / 10)


def phred_decode(text: Column) -> Column:
    return F.transform(letters(text), lambda c: F.ascii(c) - 33)


def phred_encode(quality: Column) -> Column:
    return F.array_join(F.transform(quality, lambda q: F.char((q + 33).cast("long"))), "")


def barcode_key(i7: Column, i5: Column, cbc: Column) -> Column:
    return F.concat_ws("+", i7, i5, cbc)


def length_bin(n: Column, width: int = 100) -> Column:
    """``lo-hi`` of the bin that holds n."""
    low = (F.floor(n / width) * width).cast("long")
    return F.concat(low.cast("string"), F.lit("-"), (low + width).cast("string"))


def softmax(scores: Column) -> Column:
    """Shifted by the largest score, so large scores don't overflow."""
    high = F.array_max(scores)
    powers = F.transform(scores, lambda x: F.exp(x - high))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def confidence(scores: Column, n: Column, kind: str = "probs") -> Column:
    """Mean of the highest probability over the read's own n places; 1 for a read without scores."""
    own = F.slice(scores, F.lit(1), n)
    best = F.transform(own, lambda p: F.array_max(softmax(p) if kind == "logits" else p))
    total = F.aggregate(best, F.lit(0.0), lambda a, x: a + x)
    return F.coalesce(F.try_divide(total, F.size(best)), F.lit(1.0))


def argmax_decode(scores: Column) -> Column:
    """The number of the highest score at each place; the first of equal ones."""
    return F.transform(scores, lambda p: (F.array_position(p, F.array_max(p)) - 1).cast("int"))


def cds(header: Column, seq: Column) -> Column:
    """The coding part named in a header as ``CDS:a-b`` or ``CDS a-b`` (1-based, inclusive); null without one."""
    pattern = r"CDS[:\s]+(\d+)-(\d+)"
    a = F.regexp_extract(header, pattern, 1)
    b = F.regexp_extract(header, pattern, 2)
    first, last = F.nullif(a, F.lit("")).cast("int"), F.nullif(b, F.lit("")).cast("int")
    return F.when(first.isNotNull(), F.substring(seq, first, last - first + 1))


def chunks(seq: Column, width: int = 100) -> Column:
    """Pieces of ``width`` characters; an empty sequence has none."""
    n = F.ceil(F.length(seq) / width).cast("int")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.substring(seq, i * width + 1, F.lit(width)))


def map_lookup(values: Mapping[str, str], key: Column, default: str) -> Column:
    table = F.create_map(*[F.lit(x) for item in values.items() for x in item])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def folded_lookup(values: Mapping[str, str], key: Column) -> Column:
    """The value of a key as it is, else of its upper case, else of its lower case; else null. Empty values count as none."""
    table = F.create_map(*[F.lit(x) for item in values.items() if item[1] for x in item]) if any(values.values()) else F.lit(None).cast("map<string,string>")
    return F.coalesce(*[F.try_element_at(table, k) for k in (key, F.upper(key), F.lower(key))])


def temperature_from_threshold(threshold: Column) -> Column:
    return 2.5 - 2 * threshold


def ramped_weight(weight: float, epoch: Column, ramp: int) -> Column:
    return weight * F.least(epoch / ramp, F.lit(1.0))


def hamming(a: Column, b: Column) -> Column:
    """Differing places over the shorter one's length."""
    n = F.least(F.length(a), F.length(b))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(places, lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays, as a fold over a of a row over b."""
    zero = F.transform(b, lambda _: F.lit(0))

    def row(before: Column, x: Column) -> Column:
        step = F.aggregate(
            F.zip_with(b, before, lambda y, up: F.struct(y.alias("y"), up.alias("up"))),
            F.struct(F.array().cast("array<int>").alias("row"), F.lit(0).alias("left"), F.lit(0).alias("diagonal")),
            lambda s, e: F.struct(
                F.concat(s["row"], F.array(_cell(s, e, x))).alias("row"), _cell(s, e, x).alias("left"), e["up"].alias("diagonal")
            ),
        )
        return step["row"]

    return F.coalesce(F.array_max(F.aggregate(a, zero, row)), F.lit(0))


def _cell(s: Column, e: Column, x: Column) -> Column:
    return F.when(e["y"].eqNullSafe(x), s["diagonal"] + 1).otherwise(F.greatest(s["left"], e["up"]))
