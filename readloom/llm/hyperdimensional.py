"""Language identification (operator 10): hyperdimensional letter n-gram profiles.

Every character has a random vector of +-1, a function of its code point. A trigram abc is bound into
rot2(a) * rot1(b) * c; the trigrams of a text are bundled (added); a language's prototype is the
bundle of its training texts. A text gets the language whose prototype has the highest cosine.

Bundling is linear, so a text's inner product with a prototype is the sum of its trigrams' inner
products with it. These are worked out once for each distinct trigram of a batch, and texts only add
them up. The text's own norm, by which all languages are divided alike, is the expected one, that of
independent trigram vectors: sqrt(dimensions * sum of squared counts). So the ranking of languages is that of
the cosines, and the score is the cosine up to the ratio of the bundle's norm to its expectation, which
a test holds within 15 % of 1 (texts of the tables: see the README).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import slices

DIMENSIONS = 2_048
SEED = 10
#: Labelled rows that prototypes are learnt from, at most about so many, dealt evenly over the languages.
FIT_ROWS = 20_000
#: Predictions whose cosine is lower are no language that was learnt.
LEAST_SCORE = 0.05
UNKNOWN = "und"


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """+-1 vectors for code points, each drawn from a generator seeded by its code point."""
    out = np.empty((len(points), DIMENSIONS), np.int8)
    for i, p in enumerate(points.tolist()):
        out[i] = np.random.default_rng((SEED, p)).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1
    return out


class Profile:
    """Trigrams of a batch of texts: their codes, the text of each, and the letters they are made of."""

    def __init__(self, texts: list[str | None]):
        lowered = [(t or "").lower() for t in texts]
        sizes = np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1
        points = np.frombuffer(" ".join([*lowered, ""]).encode("utf-32-le"), "<u4")
        kinds = np.unique(points[points >= 128]) if len(points) else points
        known = np.concatenate([np.arange(128, dtype=np.uint32), kinds])
        letter = np.array([chr(p).isalpha() for p in known.tolist()])
        # place 0 is anything that is no letter
        self.alphabet = np.concatenate([[32], known[letter]]).astype(np.int64)
        place = np.zeros(len(known), np.int64)
        place[letter] = np.arange(1, letter.sum() + 1)
        index = np.where(points < 128, points, 0)
        if len(kinds):
            index = np.where(points < 128, points, 128 + np.searchsorted(kinds, points))
        chars = place[index]
        k = self.base = len(self.alphabet)
        before = np.concatenate([[0], chars[:-1]]) if len(chars) else chars
        after = np.concatenate([chars[1:], [0]]) if len(chars) else chars
        codes = (before * k + chars) * k + after
        self.starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        row = np.repeat(np.arange(len(texts)), sizes)
        used = chars > 0  # a trigram is centred on a letter; beyond a text's ends there is a blank
        self.codes, self.rows, self.n = codes[used], row[used], len(texts)
        self.letters = np.bincount(self.rows, minlength=self.n) if self.n else np.zeros(0, np.int64)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct codes, and where each trigram's code is among them."""
        if self.base**3 <= 1 << 22:
            seen = np.flatnonzero(np.bincount(self.codes, minlength=1))
            place = np.zeros(self.base**3, np.int64)
            place[seen] = np.arange(len(seen))
            return seen, place[self.codes]
        return np.unique(self.codes, return_inverse=True)

    def bound(self, codes: np.ndarray) -> np.ndarray:
        """The trigrams' vectors."""
        v, k = letter_vectors(self.alphabet), self.base
        return np.roll(v, 2, 1)[codes // k // k] * np.roll(v, 1, 1)[codes // k % k] * v[codes % k]

    def inner(self, codes: np.ndarray, prototypes: np.ndarray) -> np.ndarray:
        """Inner products of trigrams (rows) with prototypes (columns), a stretch of trigrams at a time."""
        v, k = letter_vectors(self.alphabet), self.base
        first, second = np.roll(v, 2, 1), np.roll(v, 1, 1)
        out = np.empty((len(codes), len(prototypes)), np.float32)
        for s in range(0, len(codes), 4096):
            c = codes[s : s + 4096]
            out[s : s + 4096] = (first[c // k // k] * second[c // k % k] * v[c % k]).astype(np.float32) @ prototypes.T
        return out


def fit(docs: DataFrame, text_col: str, lang_col: str, fit_rows: int = FIT_ROWS, id_col: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and their prototypes as unit vectors.

    Learns from rows with a text and a language. Each language has an even part of ``fit_rows``: of one with
    more rows, rows are drawn by a hash of their id (whatever file they are in), of rarer ones all rows
    stay, so no language is lost for its rarity. Rows without an id are drawn by a hash of their text.
    Bounded: one vector for each language, of which there may be ``fit_rows`` at most.
    """
    key = F.when(F.col(id_col).isNull(), F.xxhash64(F.col(text_col))).otherwise(F.xxhash64(F.col(id_col)))
    rows = docs.select(key.alias("key"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    # the number of each language's rows is counted without reading texts
    sizes = docs.select(F.col(lang_col).cast("string").alias("lang")).filter("lang is not null").groupBy("lang").count()
    counts = dict(sizes.limit(fit_rows + 1).collect())
    if len(counts) > fit_rows:
        raise ValueError(f"more than {fit_rows} languages")
    each = fit_rows // max(1, len(counts))
    drawn = F.lit(False)
    often = {lang: n for lang, n in counts.items() if n > each}
    for lang, n in sorted(often.items()):  # fewer than fit_rows / each of them
        drawn = F.when(F.col("lang") == lang, F.pmod("key", F.lit(1 << 30)) <= int(each / n * (1 << 30))).otherwise(drawn)
    rare = ~F.col("lang").isin(list(often)) if often else F.lit(True)
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (rare | drawn)).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text", 2 << 20):
            profile = Profile(batch.column("text").to_pylist())
            codes, at = profile.distinct()
            names, lang = np.unique(np.array(batch.column("lang").to_pylist(), object), return_inverse=True)
            counts = np.bincount(lang[profile.rows] * len(codes) + at, minlength=len(names) * len(codes))
            counts = counts.reshape(len(names), -1).astype(np.float32)
            total = np.zeros((len(names), DIMENSIONS))
            for s in range(0, len(codes), 4096):
                total += counts[:, s : s + 4096] @ profile.bound(codes[s : s + 4096]).astype(np.float32)
            for name, vector in zip(names, total):
                sums[name] = sums.get(name, 0) + vector
        names = sorted(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([np.rint(sums[x]).astype(np.int64) for x in names], pa.list_(pa.int64()))],
            ["lang", "sums"],
        )

    parts = rows.mapInArrow(run, "lang string, sums array<long>").select("lang", F.posexplode("sums"))
    found = parts.groupBy("lang", "pos").agg(F.sum("col").alias("x"))
    found = found.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "x")))["x"].alias("x")).orderBy("lang").collect()
    vectors = np.array([r["x"] for r in found], float).reshape(len(found), DIMENSIONS)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True) if len(found) else vectors
    return [r["lang"] for r in found], (vectors / np.maximum(norms, 1e-9)).astype(np.float32)


def with_language(
    docs: DataFrame,
    langs: list[str],
    prototypes: np.ndarray,
    text_col: str = "text",
    pred_col: str = "lang_pred",
    score_col: str = "score",
) -> DataFrame:
    """``docs`` and two columns: the language and its cosine (0 to 1). No shuffle.

    Null, empty and letterless texts are ``und`` with score 0, as is every text if nothing was learnt;
    ties go to the language that sorts first. Columns of ``docs`` with these names give way.
    """
    docs = docs.drop(pred_col, score_col)
    at = docs.columns.index(text_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    names = np.array([*langs, UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 2 << 20):
            profile = Profile(batch.column(at).to_pylist())
            best, score = np.full(profile.n, len(langs)), np.zeros(profile.n)
            full = np.flatnonzero(profile.letters)
            if len(full) and len(langs):
                codes, place = profile.distinct()
                inner = profile.inner(codes, prototypes)
                runs = np.concatenate([[0], np.cumsum(profile.letters[full])[:-1]])
                sums = np.stack([np.add.reduceat(inner[place, j], runs, dtype=float) for j in range(len(langs))], 1)
                best[full] = np.argmax(sums, 1)
                score[full] = np.clip(sums.max(1) / np.sqrt(DIMENSIONS * _squares(place, runs, len(codes))), 0, 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names[best], pa.string()), pa.array(score)], [*batch.schema.names, pred_col, score_col]
            )

    return docs.mapInArrow(run, f"{fields}, `{pred_col}` string, `{score_col}` double")


def _squares(place: np.ndarray, runs: np.ndarray, n: int) -> np.ndarray:
    """Sum of squared trigram counts of each run."""
    ends = [*runs[1:].tolist(), len(place)]
    out = np.empty(len(runs))
    for i, (a, b) in enumerate(zip(runs.tolist(), ends)):
        part = place[a:b]
        counts = np.bincount(part) if b - a > n // 4 else np.unique(part, return_counts=True)[1]
        out[i] = np.dot(counts, counts)
    return out


def training_rows(docs: DataFrame, id_col: str = "doc_id", folds: int = 5) -> Column:
    """True for rows that may be learnt from: crc32 of the id's text isn't divisible by ``folds``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds != 0, F.lit(False))
