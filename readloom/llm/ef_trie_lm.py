"""Language-model scoring (operator 6): trigrams in Elias-Fano tries, sharded by the predicted word.

The model merges the counts of both contexts with a prior, over all training text,

    p(w | g h) = (BOOST c(g h w) + c(h w) + MU p(w)) / (BOOST c(g h) + c(h) + MU),   p(w) = (c(w) + 1) / (N + V + 1),

which sums to one with a share for unknown words. Tries are stored in reverse order, word first and
then the contexts before it, so log10 p splits into a part that belongs to the n-gram (g, h, w), found below w,
and a part that belongs to the pair (g, h), found below h: each token adds its own part and that of the token
after it where its word is, and texts are scored with one shuffle of their tokens.

1. Words of training texts are counted (map-side first). Words with over N / HOT tokens, of which there
   can't be more than HOT, are sent to all tasks with their counts.
2. Each batch of texts sends every shard its tokens: word, two contexts and document, words run-length
   coded and hot contexts as two bytes. A hot word's contexts are dealt over several shards. A batch makes
   one row for each shard, so rows grow with both; larger batches and shards (BATCH, SHARD) keep them few.
3. ``fit`` counts each shard's n-grams and writes its trie (see elias_fano.py) as a row of a table in the shared
   folder. ``score`` brings tries and tokens of a shard together; the task that scores never saw the training
   texts. ``fit_score`` does both in one visit of a shard: the trie is built from its training tokens, and all
   tokens are looked up in it.

Words are told apart by 63 bits of their XXH64, contexts of one shard, if they aren't hot, by 48 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import as_bytes, slices, written
from readloom.llm.elias_fano import Trie

#: Strength of the prior, in tokens, and what a trigram counts for beside a bigram (chosen among seven pairs of
#: values by the held-out texts of a table of 10,000 documents).
MU, BOOST = 500.0, 30.0
#: There can't be more hot words than this.
HOT = 50_000
#: Tokens of a shard, about, and shards that one call scores one after another, adding up as it goes.
SHARD, BIN = 750_000, 4
#: Bytes of text whose tokens are sent together.
BATCH = 8 << 20


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) >> 1


# no word holds white space
END, START = _hash(b"\n"), _hash(b"\r")


class Tokens:
    """A batch of texts as numbers: each token's word, counting from 0, and the texts' lengths."""

    def __init__(self, texts: list[bytes | None]):
        split = [(t or b"").lower().split() for t in texts]
        known = {w: i for i, w in enumerate(set().union(*split))}
        self.hashes = np.fromiter((*map(_hash, known), END, START), np.int64, len(known) + 2)
        self.end, self.start = len(known), len(known) + 1
        self.sizes = np.fromiter(map(len, split), np.int64, len(split)) + 1
        place = known.__getitem__
        parts = (x for words in split for x in (*map(place, words), self.end))
        self.words = np.fromiter(parts, np.int64, int(self.sizes.sum()))

    def documents(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """The word before each token, and the one before that; START where a text begins."""
        before = np.concatenate([[self.start], self.words[:-1]])
        before = np.where(before == self.end, self.start, before)
        further = np.concatenate([[self.start], before[:-1]])
        return before, np.where(before == self.start, self.start, further)


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n) over the ``text`` of rows whose ``held`` is false."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH):
            tokens = Tokens(as_bytes(batch.column("text")))
            n = np.bincount(tokens.words, minlength=tokens.end + 1)[: tokens.end + 1]
            yield pa.RecordBatch.from_arrays([pa.array(tokens.hashes[: tokens.end + 1]), pa.array(n)], ["word", "n"])

    words = rows.filter("not held").select("text").mapInArrow(run, "word long, n long")
    return words.filter("n > 0").groupBy("word").agg(F.sum("n").alias("n"))


def held_out_rows(id_: Column, folds: int = 7, fold: int = 2) -> Column:
    """crc32 of the id's text leaves ``fold``; a null id is never held out."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % folds == fold, F.lit(False))


def _smallest(x: np.ndarray) -> bytes:
    top = int(x.max()) if len(x) else 0
    kind = "u1" if top < 1 << 8 else "u2" if top < 1 << 16 else "u4"
    return kind[1].encode() + x.astype(f"<{kind}").tobytes()


def _back(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[:1].decode()}", offset=1).astype(np.int64)


def _join(parts: list[np.ndarray], kind=np.int64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, kind)


@dataclass
class Model:
    """Tries by shard, as a table in the shared folder, and what every task has to know."""

    tries: DataFrame | None
    hot: tuple[np.ndarray, np.ndarray]
    tokens: int
    words: int
    texts: int
    shards: int
    mu: float
    boost: float

    @property
    def most(self) -> int:
        """Tokens of a hot word in one shard."""
        return max(1, self.tokens // self.shards // 8)


_TOKENS = ("hot0", "cold0", "runs", "hot1", "cold1", "hot2", "cold2", "docs")
#: Of contexts that aren't hot, which are told apart within a shard only, so many bits of the hash are sent.
CONTEXT_BITS = 48


def _packed(x: np.ndarray) -> bytes:
    """The lower CONTEXT_BITS bits of each number."""
    return x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, : CONTEXT_BITS // 8].tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    part = np.frombuffer(x, np.uint8).reshape(-1, CONTEXT_BITS // 8)
    out = np.zeros((len(part), 8), np.uint8)
    out[:, : CONTEXT_BITS // 8] = part
    return out.view("<i8").ravel().astype(np.int64)


def _prepared(rows: DataFrame, mu: float, boost: float) -> Model:
    counts = written(word_counts(rows), "words")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    hot = sorted(map(tuple, counts.filter((F.col("n") * HOT > n) | F.col("word").isin(END)).collect()))
    arrays = np.array([w for w, _ in hot], np.int64), np.array([c for _, c in hot], np.int64)
    return Model(None, arrays, n, v, int(dict(hot).get(END, 0)), max(1, -(-n * 7 // 6 // SHARD)), mu, boost)


def head_shard(name: int, shards: int) -> int:
    """The group, below 0, of a batch's head."""
    return -1 - xxhash.xxh64_intdigest(name.to_bytes(8, "little")) % shards


def _sent(rows: DataFrame, model: Model, heads: bool) -> DataFrame:
    """Rows (shard, block, tokens...) of the texts; with ``heads`` also a row for each batch with its ids and sizes."""
    kind = rows.schema["id"].dataType.simpleString()
    sent = rows.sparkSession.sparkContext.broadcast(model.hot)
    shards, most = model.shards, model.most

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_words, hot_counts = sent.value
        task, block = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text", BATCH):
            tokens = Tokens(as_bytes(batch.column("text")))
            flags = ~batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
            place = np.searchsorted(hot_words, tokens.hashes)
            is_hot = place < len(hot_words)
            is_hot[is_hot] = hot_words[place[is_hot]] == tokens.hashes[is_hot]
            code = np.where(is_hot, place + 1, 0)
            parts = np.ones(len(tokens.hashes), np.int64)
            parts[is_hot] = np.minimum(1 + hot_counts[place[is_hot]] // most, shards)
            before, further = tokens.contexts()
            split = tokens.hashes[before] % parts[tokens.words]
            shard = (tokens.hashes[tokens.words] + split) % shards
            order = np.argsort(shard * len(tokens.hashes) + tokens.words)
            w, h, g, shard = tokens.words[order], before[order], further[order], shard[order]
            doc = tokens.documents()[order]
            doc = doc * 2 + flags[doc]
            edges = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
            out: dict[str, list] = {c: [] for c in ("shard", *_TOKENS)}
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                first = np.flatnonzero(np.diff(w[a:b], prepend=-1))
                out["shard"].append(int(shard[a]))
                kinds = w[a:b][first]
                out["hot0"].append(_smallest(code[kinds]))
                out["cold0"].append(tokens.hashes[kinds[~is_hot[kinds]]].tobytes())
                out["runs"].append(_smallest(np.diff(first, append=b - a)))
                for i, ctx in (("1", h[a:b]), ("2", g[a:b])):
                    out["hot" + i].append(_smallest(code[ctx]))
                    out["cold" + i].append(_packed(tokens.hashes[ctx[~is_hot[ctx]]]))
                out["docs"].append(_smallest(doc[a:b]))
            m = len(out["shard"])
            name, extra = (task << 32) + block, int(heads)
            block += 1
            none = [None] * m
            yield pa.RecordBatch.from_arrays(
                [
                    # the heads, one for each batch, are spread as shards of their own, by the batch's full name
                    pa.array([*out["shard"], head_shard(name, shards)][: m + extra], pa.int64()),
                    pa.array(np.full(m + extra, name)),
                    *(pa.array([*out[c], None][: m + extra], pa.binary()) for c in _TOKENS),
                    pa.array([*none, batch.column("id").to_pylist()][: m + extra], pa.list_(batch.column("id").type)),
                    pa.array([*none, tokens.sizes.tolist()][: m + extra], pa.list_(pa.int64())),
                    pa.array([*none, flags.tolist()][: m + extra], pa.list_(pa.bool_())),
                ],
                ["shard", "block", *_TOKENS, "ids", "sizes", "train"],
            )

    columns = ", ".join(f"{c} binary" for c in _TOKENS)
    out = rows.mapInArrow(send, f"shard long, block long, {columns}, ids array<{kind}>, sizes array<long>, train array<boolean>")
    bins = F.when(F.col("shard") < 0, F.col("shard")).otherwise(F.floor(F.col("shard") / BIN))
    return out.withColumn("bin", bins.cast("long"))


def _rows(docs: DataFrame, id_col: str, text_col: str, held: Column) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), held.alias("held"), F.col(text_col).alias("text"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None, mu: float = MU, boost: float = BOOST) -> Model:
    """A model of the texts that aren't held out; its tries are a table (shard, trie) in the shared folder."""
    held = held_out_rows(F.col(id_col)) if held_out is None else held_out
    rows = _rows(docs, id_col, text_col, held).filter("not held")
    model = _prepared(rows, mu, boost)
    known = _Known(model)

    def build(group: pa.Table) -> pa.Table:
        shard = group.column("shard").to_numpy()
        names = np.unique(shard)
        tries = [_Shard(group.filter(pa.array(shard == x)), known).trie() for x in names]
        return pa.table({"shard": names, "trie": pa.array(tries, pa.binary())})

    model.tries = written(_sent(rows, model, False).groupBy("bin").applyInArrow(build, "shard long, trie binary"), "tries")
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """Scores every text by a model that ``fit`` made, of these or other texts; columns as of ``fit_score``."""
    held = held_out_rows(F.col(id_col)) if held_out is None else held_out
    return _scored(_rows(docs, id_col, text_col, held), model, id_col)


def fit_score(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    held_out: Column | None = None,
    mu: float = MU,
    boost: float = BOOST,
) -> DataFrame:
    """Scores every text by a model of the texts that aren't held out.

    Returns id, held_out, n_tokens, n_known, train_tokens, base_score and score. A text's tokens are its
    words (runs of anything but ASCII white space, A-Z lower-cased) and an end; null and empty texts
    are an end alone. base_score sums log10 p(w), score log10 p(w | g h) with values quantised to 16
    bits. Without training texts every word is unknown. Repeated rows count each time; an empty table
    gives no rows; other columns are ignored.
    """
    held = held_out_rows(F.col(id_col)) if held_out is None else held_out
    rows = _rows(docs, id_col, text_col, held)
    return _scored(rows, _prepared(rows.filter("not held"), mu, boost), id_col)


def _scored(rows: DataFrame, model: Model, id_col: str) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()
    known, n, texts, mu, boost = _Known(model), model.tokens, model.texts, model.mu, model.boost
    id_type = pa.schema(_arrow_schema(rows.select("id"))).field(0).type
    fitted = model.tries is not None

    def score_bin(key: tuple, group: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return _partial(group.column("block"), {}, group.column("ids"), group.column("sizes"), group.column("train"))
        tries = {}
        if fitted:
            stored = group.filter(group.column("trie").is_valid())
            tries = dict(zip(stored.column("shard").to_pylist(), stored.column("trie").to_pylist()))
            group = group.filter(group.column("trie").is_null())
        shard = group.column("shard").to_numpy()
        names = np.unique(group.column("block").to_numpy())
        parts = []
        for x in np.unique(shard):
            part = group.filter(pa.array(shard == x))
            tokens = _Shard(part, known)
            own, *sums = tokens.score(Trie(tries.get(int(x)) or (_EMPTY if fitted else tokens.trie())))
            block = np.searchsorted(names, part.column("block").to_numpy())[own >> 32]
            parts.append(((block << 32) + (own & 0xFFFFFFFF), *sums))
        if not parts:
            return _partial(pa.array([], pa.int64()), {})
        texts_, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        base, total, seen = (np.bincount(at, np.concatenate([p[i] for p in parts]), len(texts_)) for i in (1, 2, 3))
        block, doc = texts_ >> 32, texts_ & 0xFFFFFFFF
        edges = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
        sums: dict[str, list[bytes]] = {c: [] for c in ("docs", "base", "total", "known")}
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            sums["docs"].append(_smallest(doc[a:b]))
            sums["base"].append(base[a:b].tobytes())
            sums["total"].append(total[a:b].astype(np.float32).tobytes())
            sums["known"].append(_smallest(seen[a:b].astype(np.int64)))
        return _partial(pa.array(names[block[edges[:-1]]]), sums)

    def _partial(block, sums: dict, ids=None, sizes=None, train=None) -> pa.Table:
        rows_ = len(block)
        return pa.table(
            {
                "block": block,
                **{c: pa.array(sums.get(c, [None] * rows_), pa.binary()) for c in ("docs", "base", "total", "known")},
                "ids": pa.nulls(rows_, pa.list_(id_type)) if ids is None else ids,
                "sizes": pa.nulls(rows_, pa.list_(pa.int64())) if sizes is None else sizes,
                "train": pa.nulls(rows_, pa.list_(pa.bool_())) if train is None else train,
            }
        )

    def add_up(group: pa.Table) -> pa.Table:
        parts = {c: group.column(c).to_pylist() for c in ("docs", "base", "total", "known")}
        head = next(i for i, x in enumerate(group.column("sizes").to_pylist()) if x is not None)
        ids, sizes = group.column("ids")[head].values, np.array(group.column("sizes")[head].as_py(), np.int64)
        sums = np.zeros((3, len(sizes)))
        sums[1] -= np.log10((1 + boost) * texts + mu)  # the start as the first token's context
        for d, b, t, k in zip(*parts.values()):
            if d is not None:
                at = _back(d)
                for i, x in enumerate((np.frombuffer(b), np.frombuffer(t, np.float32), _back(k))):
                    sums[i, at] += x
        return pa.table(
            {
                "id": ids,
                "held_out": pa.array([not x for x in group.column("train")[head].as_py()], pa.bool_()),
                "n_tokens": pa.array(sizes),
                "n_known": pa.array(sums[2].astype(np.int64)),
                "train_tokens": pa.array(np.full(len(sizes), n, np.int64)),
                "base_score": pa.array(sums[0]),
                "score": pa.array(sums[1]),
            }
        )

    tokens = _sent(rows, model, True)
    if fitted:
        tries = model.tries.withColumn("bin", F.floor(F.col("shard") / BIN).cast("long"))
        tokens = tokens.unionByName(tries, allowMissingColumns=True)
    tail = f"ids array<{kind}>, sizes array<long>, train array<boolean>"
    found = tokens.groupBy("bin").applyInArrow(score_bin, f"block long, docs binary, base binary, total binary, known binary, {tail}")
    out = found.groupBy("block").applyInArrow(
        add_up,
        f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
    return out.withColumnRenamed("id", id_col)


class _Known:
    """What a shard has to know of the whole: hot words with their counts, sizes, and the model's constants."""

    def __init__(self, model: Model):
        self.hot_words, self.hot_counts = model.hot
        self.total = model.tokens + model.words + 1
        self.mu, self.boost = model.mu, model.boost

    def counts(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """``counts`` of words, those of hot words put right."""
        if not len(self.hot_words):
            return counts
        place = np.minimum(np.searchsorted(self.hot_words, words), len(self.hot_words) - 1)
        return np.where(self.hot_words[place] == words, self.hot_counts[place], counts)


class _Shard:
    """One shard's tokens as numbers: their words, contexts (in the order of their hashes), n-grams and texts."""

    def __init__(self, group: pa.Table, known: _Known):
        self.known = known
        words, owners, coded, cold = [], [], ([], []), ([], [])
        cols = [group.column(c).to_pylist() for c in _TOKENS]
        for i, (hot0, cold0, runs, hot1, cold1, hot2, cold2, docs) in enumerate(zip(*cols)):
            code = _back(hot0)
            kinds = np.empty(len(code), np.int64)
            kinds[code > 0] = known.hot_words[code[code > 0] - 1]
            kinds[code == 0] = np.frombuffer(cold0, np.int64)
            words.append((kinds, _back(runs)))
            for j, (h, c) in enumerate(((hot1, cold1), (hot2, cold2))):
                coded[j].append(_back(h))
                cold[j].append(_unpacked(c))
            owners.append(_back(docs) + (i << 33))  # the lowest bit tells whether the text is learnt from
        self.own = _join(owners)
        self.words, place = np.unique(_join([w for w, _ in words]), return_inverse=True)
        self.w = np.repeat(place, _join([r for _, r in words]))
        # contexts: hot ones by their number, cold ones by their hash
        codes = [_join(x) for x in coded]
        hashes, where = np.unique(_join([*cold[0], *cold[1]]), return_inverse=True)
        there = np.flatnonzero(np.bincount(np.concatenate(codes), minlength=len(known.hot_words) + 1)[1:])
        every = np.concatenate([known.hot_words[there], hashes]) if len(known.hot_words) else hashes
        order = np.argsort(every)
        rank = np.empty(len(every), np.int64)
        rank[order] = np.arange(len(every))
        self.contexts = every[order]
        of_hot = np.zeros(len(known.hot_words) + 1, np.int64)
        of_hot[there + 1] = rank[: len(there)]
        sides, at = [], 0
        for code in codes:
            ids, lone = of_hot[code], code == 0
            n = int(lone.sum())
            ids[lone] = rank[len(there) + where[at : at + n]]
            at += n
            sides.append(ids)
        k = max(1, len(self.contexts))
        self.pairs, self.pair = np.unique(self.w * k + sides[0], return_inverse=True)
        self.triples, self.triple = np.unique(self.pair * k + sides[1], return_inverse=True)
        self.k = k

    def trie(self) -> bytes:
        """The trie of the n-grams in texts that are learnt from."""
        learnt = (self.own & 1).astype(np.float64)
        c3, c2 = np.bincount(self.triple, learnt, len(self.triples)), np.bincount(self.pair, learnt, len(self.pairs))
        c1 = np.bincount(self.w, learnt, len(self.words)).astype(np.int64)
        seen2, seen3 = np.flatnonzero(c2), np.flatnonzero(c3)
        word, first = self.pairs[seen2] // self.k, self.pairs[seen2] % self.k
        pair, second = self.triples[seen3] // self.k, self.triples[seen3] % self.k
        words = np.flatnonzero(c1)
        contexts = np.flatnonzero(np.bincount(np.concatenate([first, second]), minlength=self.k))
        count = self.known.counts(self.words[words], c1[words])
        place = np.searchsorted(words, word)
        prior = self.known.mu * (count[place] + 1) / self.known.total
        parent = np.searchsorted(seen2, pair)
        value2, after2 = c2[seen2] + prior, self.known.boost * c2[seen2] + count[place] + self.known.mu
        value3 = self.known.boost * c3[seen3] + value2[parent]
        return Trie.build(
            self.words[words], count, self.contexts[contexts] if len(contexts) else contexts, place, np.searchsorted(contexts, first),
            parent, np.searchsorted(contexts, second), np.log10(value2), np.log10(after2), np.log10(value3),
        )

    def score(self, trie: Trie) -> tuple[np.ndarray, ...]:
        """(text, base, total, known): sums over the tokens for each text that has some.

        A text is its row number in the group, and its place in that row's block, as one number.
        """
        at1 = trie.words.find(self.words)
        count = np.zeros(len(self.words), np.int64)
        count[at1 >= 0] = trie.counts[at1[at1 >= 0]]
        count = self.known.counts(self.words, count)
        prior = (count + 1) / self.known.total
        context = trie.contexts.find(self.contexts)
        word, pair = self.pairs // self.k, self.triples // self.k
        at2 = trie.child(2, at1[word], context[self.pairs % self.k] if len(context) else np.full(len(word), -1))
        at3 = trie.child(3, at2[pair], context[self.triples % self.k] if len(context) else np.full(len(pair), -1))
        # a pair that was never seen leaves the prior alone; a triple, what its pair has
        value = np.log10(self.known.mu * prior[word])
        after = np.log10(count[word] + self.known.mu)
        seen = at2 >= 0
        value[seen], after[seen] = trie.value2(at2[seen]), trie.after(at2[seen])
        after[self.words[word] == END] = 0.0  # nothing follows
        values = value[pair]
        seen = at3 >= 0
        values[seen] = trie.value3(at3[seen])
        texts, owner = np.unique(self.own >> 1, return_inverse=True)
        base = np.bincount(owner, np.log10(prior)[self.w])
        total = np.bincount(owner, values[self.triple] - after[self.pair])
        return texts, base, total, np.bincount(owner, (count > 0)[self.w])


_EMPTY = Trie.build(*[np.empty(0, np.int64)] * 7, *[np.empty(0)] * 3)


def _arrow_schema(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)
