"""Read generation and corruption. Every draw is a function of the seed, the read and the draw's purpose,
so results don't depend on the number of partitions or workers, and nothing is shuffled."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.functions.draws import normal, pick, uniform
from readloom.functions.seq import let, letters, reverse_complement
from readloom.operators.motif import Matrix, sample
from readloom.operators.runs import run_lengths

BASES = "ACGT"


@dataclass
class Source:
    """Where a segment's bases come from: ``fixed``, ``random``, ``polya``, ``pwm``, ``whitelist`` or ``transcript``."""

    label: str
    kind: str = "random"
    length: int = 20
    sequence: str = ""
    matrix: Matrix = field(default_factory=list)
    mean: float = 100.0
    std: float = 20.0
    low: int = 20
    high: int = 500
    #: With ``polya``: normal, gamma, uniform, fixed or empirical (one of ``lengths``).
    spread: str = "normal"
    lengths: Sequence[int] = ()
    #: With ``whitelist`` or ``transcript``: the column of the read that holds the chosen sequence.
    column: str = ""
    #: Quality of the segment's bases.
    quality: int = 30


def random_bases(n: Column, seed: int, row: Column, purpose: str) -> Column:
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(places, lambda i: F.substring(F.lit(BASES), pick(seed, 4, row, F.lit(purpose), i) + 1, F.lit(1))), "")


def tail_length(source: Source, seed: int, row: Column) -> Column:
    """normal, gamma (Wilson and Hilferty's cube of a normal draw), uniform, fixed, or one of the given lengths."""
    if source.spread == "fixed":
        return F.lit(source.mean)
    if source.spread == "uniform":
        return source.low + uniform(seed, row, "tail") * (source.high - source.low)
    if source.spread == "empirical":
        return F.get(F.array(*map(F.lit, source.lengths)), pick(seed, len(source.lengths), row, "tail"))
    z = normal(seed, row, "tail")
    if source.spread == "gamma":
        shape = (source.mean / source.std) ** 2
        return source.mean * F.pow(1 - 1 / (9 * shape) + z / (3 * shape**0.5), F.lit(3))
    return source.mean + source.std * z


def polya_tail(source: Source, seed: int, row: Column, purity: float = 0.95) -> Column:
    """A tail of a length drawn from ``source.spread``, within bounds; a base is A with probability ``purity``."""
    n = F.least(F.greatest(F.round(tail_length(source, seed, row)), F.lit(source.low)), F.lit(source.high)).cast("int")
    one = lambda i: F.when(uniform(seed, row, "pure", i) < purity, "A").otherwise(F.substring(F.lit("CGT"), pick(seed, 3, row, "other", i) + 1, F.lit(1)))
    return F.array_join(F.transform(F.sequence(F.lit(1), n), one), "")


def segment(source: Source, seed: int, row: Column) -> Column:
    if source.kind == "fixed":
        return F.lit(source.sequence)
    if source.kind == "pwm":
        return sample(source.matrix, seed, row)
    if source.kind == "polya":
        return polya_tail(source, seed, row)
    if source.kind in ("whitelist", "transcript"):
        return F.coalesce(F.col(source.column), F.lit(""))
    return random_bases(F.lit(source.length), seed, row, source.label)


def assemble(rows: DataFrame, layout: Sequence[Source], seed: int, reverse: bool = False) -> DataFrame:
    """``rows`` (with read_id) and sequence, labels and quality: the segments one after another."""
    row, parts = F.col("read_id"), {}
    for i, s in enumerate(layout):
        parts[f"_s{i}"] = segment(s, seed, row)
    made = rows.withColumns(parts)
    texts = [F.col(p) for p in parts]
    labels = F.flatten(F.array(*[F.array_repeat(F.lit(s.label), F.length(t)) for s, t in zip(layout, texts)]))
    quality = F.flatten(F.array(*[F.array_repeat(F.lit(float(s.quality)).cast("float"), F.length(t)) for s, t in zip(layout, texts)]))
    seq = F.concat(*texts)
    made = made.withColumns(
        {
            "sequence": reverse_complement(seq) if reverse else seq,
            "labels": F.reverse(labels) if reverse else labels,
            "quality": F.reverse(quality) if reverse else quality,
        }
    )
    return made.drop(*parts)


def generate(spark: SparkSession, n: int, layout: Sequence[Source], seed: int, error_rate: float = 0.0, offset: int = 0) -> DataFrame:
    """n reads, in as many partitions as Spark likes, always the same."""
    rows = spark.range(offset, offset + n).withColumnRenamed("id", "read_id")
    made = assemble(rows, layout, seed)
    made = made.withColumns({"is_invalid": F.lit(False), "error_type": F.lit(None).cast("string")})
    return sequencing_errors(made, seed, error_rate) if error_rate else made


def whitelisted(rows: DataFrame, whitelist: DataFrame, seed: int, column: str) -> DataFrame:
    """``rows`` and a sequence of the whitelist (ordinal, seq) for each, drawn evenly: an equi-join on the ordinal."""
    n = whitelist.count()
    drawn = rows.withColumn("_o", pick(seed, max(1, n), F.col("read_id"), F.lit(column)).cast("long"))
    table = whitelist.select(F.col("ordinal").cast("long").alias("_o"), F.col("seq").alias(column))
    return drawn.join(table, "_o", "left").drop("_o")


def fragments(rows: DataFrame, transcripts: DataFrame, seed: int, low: int, high: int, column: str = "fragment", weighted: bool = True) -> DataFrame:
    """A fragment and the id (``transcript``) of a transcript (id, seq) for each row: transcript by length (or evenly), place and length evenly.

    Choosing by length is a point in the cumulative lengths: transcripts are cut into buckets of about equal
    length, so the range join is an equi-join on the bucket.
    """
    lengths = transcripts.select("id", "seq", (F.length("seq") if weighted else F.lit(1)).cast("long").alias("w")).filter("w > 0")
    spread = F.sum("w").over(Window.partitionBy("part").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    parts = lengths.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("upto", spread)
    sizes = {r["part"]: r["n"] for r in parts.groupBy("part").agg(F.sum("w").alias("n")).collect()}  # 64 rows
    base, before = 0, {}
    for p in sorted(sizes):
        before[p], base = base, base + sizes[p]
    table = F.create_map(*[F.lit(x).cast("long") for item in before.items() for x in item])
    placed = parts.withColumn("end", F.col("upto") + F.try_element_at(table, F.col("part"))).withColumn("start", F.col("end") - F.col("w"))
    width = max(1, base // max(1, transcripts.count()))
    buckets = placed.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    point = F.floor(uniform(seed, F.col("read_id"), "transcript") * base).cast("long")
    drawn = rows.withColumn("_p", point).withColumn("bucket", F.floor(F.col("_p") / width))
    found = drawn.join(buckets.select("bucket", "start", "end", "seq", F.col("id").alias("transcript")), "bucket").filter((F.col("_p") >= F.col("start")) & (F.col("_p") < F.col("end")))
    n = F.least(F.length("seq"), low + pick(seed, high - low + 1, F.col("read_id"), "length"))
    at = pick(seed, F.length("seq") - n + 1, F.col("read_id"), "place")
    cut = F.substring("seq", at + 1, n)
    turned = F.when(uniform(seed, F.col("read_id"), "strand") < 0.5, reverse_complement(cut)).otherwise(cut)
    return found.withColumn(column, turned).drop("_p", "bucket", "start", "end", "seq")


def sequencing_errors(reads: DataFrame, seed: int, rate: float, substitution: float = 0.7, insertion: float = 0.15) -> DataFrame:
    """Substituted bases (ERROR_SUB), bases put in after one (ERROR_INS), and bases left out, by shares of ``rate``.

    The places of errors are drawn first; what lies between them is copied in stretches, so the work grows with a read's length.
    """
    row, text, at = F.col("read_id"), F.coalesce("sequence", F.lit("")), F.col("_at")
    n = F.length(text)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    # places without a label have a null one
    labels = F.coalesce("labels", F.array().cast("array<string>"))
    labels = F.when(F.size(labels) < n, F.concat(labels, F.array_repeat(F.lit(None).cast("string"), n - F.size(labels)))).otherwise(labels)
    made = reads.withColumns({"_text": text, "_labels": labels, "_at": F.filter(places, lambda i: uniform(seed, row, "error", i) < rate)})
    text, labels, n = F.col("_text"), F.col("_labels"), F.length("_text")

    def before(i: Column, k: Column) -> Column:
        """Where the stretch begins that ends before the k-th error, at i."""
        return F.coalesce(F.get(at, k - 1) + 1, F.lit(0))

    def one(which: str, i: Column, k: Column) -> Column:
        start, kind, base = before(i, k), uniform(seed, row, "kind", i), F.substring(text, i + 1, F.lit(1))
        if which == "text":
            other = F.substring(F.replace(F.lit(BASES), base, F.lit("")), pick(seed, 3, row, "base", i) + 1, F.lit(1))
            extra = F.substring(F.lit(BASES), pick(seed, 4, row, "base", i) + 1, F.lit(1))
            changed = (other, F.concat(base, extra), F.lit(""))
            stretch = F.substring(text, start + 1, i - start)
        else:
            own = F.slice(labels, i + 1, F.lit(1))
            changed = (F.array(F.lit("ERROR_SUB")), F.concat(own, F.array(F.lit("ERROR_INS"))), F.array().cast("array<string>"))
            stretch = F.slice(labels, start + 1, i - start)
        return F.concat(stretch, F.when(kind < substitution, changed[0]).when(kind < substitution + insertion, changed[1]).otherwise(changed[2]))

    rest = F.coalesce(F.get(at, F.size(at) - 1) + 1, F.lit(0))
    new = {
        "sequence": F.concat(F.array_join(F.transform(at, lambda i, k: one("text", i, k)), ""), F.substring(text, rest + 1, n - rest)),
        "labels": F.concat(F.flatten(F.transform(at, lambda i, k: one("labels", i, k))), F.slice(labels, rest + 1, n - rest)),
    }
    return made.withColumns(new).drop("_text", "_labels", "_at", "quality")


# --- architectural corruption -------------------------------------------------------------------------

KINDS: Mapping[str, float] = {"segment_loss": 0.3, "segment_duplication": 0.3, "truncation": 0.2, "chimeric": 0.1, "scrambled": 0.1}
_READ = "struct<sequence:string,labels:array<string>>"


def _read(seq: Column, labels: Column) -> Column:
    return F.struct(seq.alias("sequence"), labels.alias("labels"))


def _joined(seq: Column, labels: Column, runs: Column) -> Column:
    """The read made of the given runs, in their order."""
    text = F.array_join(F.transform(runs, lambda r: F.substring(seq, r["start"] + 1, r["end"] - r["start"])), "")
    return _read(text, F.flatten(F.transform(runs, lambda r: F.slice(labels, r["start"] + 1, r["end"] - r["start"]))))


def lost(seq: Column, labels: Column, seed: int, row: Column, among: Sequence[str] = ("UMI", "ACC", "CBC")) -> Column:
    """Without any run of one of the labels ``among`` that the read has; reads with none stay."""
    there = F.array_sort(F.array_intersect(F.array(*map(F.lit, among)), labels))
    gone = F.get(there, pick(seed, F.greatest(F.size(there), F.lit(1)), row, "lost"))
    kept = let(gone, lambda g: F.filter(run_lengths(labels), lambda r: r["label"] != g))
    return F.when(F.size(there) > 0, let(kept, lambda k: _joined(seq, labels, k))).otherwise(_read(seq, labels))


def duplicated(seq: Column, labels: Column, seed: int, row: Column) -> Column:
    """One run repeated in place, one to three times more."""
    copies = 2 + pick(seed, 3, row, "copies")

    def more(runs: Column) -> Column:
        at = pick(seed, F.greatest(F.size(runs), F.lit(1)), row, "doubled")
        return F.flatten(F.transform(runs, lambda r, i: F.array_repeat(r, F.when(i == at, copies).otherwise(1))))

    return let(let(run_lengths(labels), more), lambda k: _joined(seq, labels, k))


def cut(seq: Column, labels: Column, seed: int, row: Column) -> Column:
    """Either end taken off at a place between a quarter (50 at least) and 20 before the end; short reads stay."""
    n = F.length(seq)
    low, high = F.greatest(F.lit(50), F.floor(n / 4)).cast("int"), n - 20
    at = low + pick(seed, F.greatest(high - low + 1, F.lit(1)), row, "cut")
    front = uniform(seed, row, "side") < 0.5
    mark = F.array(F.lit("ERROR_BOUNDARY"))
    tail = _read(F.substring(seq, at + 1, n), F.concat(mark, F.slice(labels, at + 2, n)))
    head = _read(F.substring(seq, F.lit(1), at), F.concat(F.slice(labels, F.lit(1), at - 1), mark))
    return F.when(low >= high, _read(seq, labels)).when(front, tail).otherwise(head)


def scrambled(seq: Column, labels: Column, seed: int, row: Column) -> Column:
    """The runs in an order drawn by hash; the first base of a run that isn't in its old place is ERROR_ORDER."""
    keyed = F.transform(run_lengths(labels), lambda r, i: F.struct(uniform(seed, row, "order", i).alias("k"), i.alias("i"), r.alias("r")))

    def own(x: Column, i: Column) -> Column:
        part = F.slice(labels, x["r"]["start"] + 1, x["r"]["end"] - x["r"]["start"])
        return F.when(x["i"] == i, part).otherwise(F.concat(F.array(F.lit("ERROR_ORDER")), F.slice(part, F.lit(2), F.size(part))))

    def build(mixed: Column) -> Column:
        text = F.array_join(F.transform(mixed, lambda x: F.substring(seq, x["r"]["start"] + 1, x["r"]["end"] - x["r"]["start"])), "")
        return _read(text, F.flatten(F.transform(mixed, own)))

    return let(F.array_sort(keyed), build)


def chimeric(seq: Column, labels: Column, other: Column, seed: int, row: Column) -> Column:
    """The start of one read and the end of another (a struct), both cut within their middle half."""

    def place(n: Column, which: str) -> Column:
        return (F.floor(n / 4) + pick(seed, F.floor(3 * n / 4) - F.floor(n / 4) + 1, row, which)).cast("int")

    a, b = place(F.length(seq), "first"), place(F.length(other["sequence"]), "second")
    rest = F.slice(other["labels"], b + 1, F.greatest(F.size(other["labels"]), F.lit(1)))
    marked = F.when(F.size(rest) > 0, F.concat(F.array(F.lit("ERROR_BOUNDARY")), F.slice(rest, F.lit(2), F.size(rest)))).otherwise(rest)
    return _read(
        F.concat(F.substring(seq, F.lit(1), a), F.substring(other["sequence"], b + 1, F.length(other["sequence"]))),
        F.concat(F.slice(labels, F.lit(1), a), marked),
    )


def corrupt(reads: DataFrame, seed: int, fraction: float, kinds: Mapping[str, float] = KINDS) -> DataFrame:
    """Reads of which a share is corrupted, in a way drawn by the given weights; all other columns stay.

    Each read is chosen by its own draw, so the share holds on average and no order over all reads is needed.
    Reads that a corruption leaves as they were aren't marked. Markers never lengthen ``labels``.
    """
    row, seq, labels = F.col("read_id"), F.col("sequence"), F.col("labels")
    total, upto, kind = sum(kinds.values()), 0.0, None
    u = uniform(seed, row, "kind of corruption")
    for name, w in kinds.items():
        upto += w / total
        kind = F.when(u < upto, name) if kind is None else kind.when(u < upto, name)
    kind = kind.otherwise(list(kinds)[-1])
    chosen = uniform(seed, row, "corrupted") < fraction
    marked = reads.withColumn("_kind", F.when(chosen, kind))
    changed = (
        F.when(F.col("_kind") == "segment_loss", lost(seq, labels, seed, row))
        .when(F.col("_kind") == "segment_duplication", duplicated(seq, labels, seed, row))
        .when(F.col("_kind") == "truncation", cut(seq, labels, seed, row))
        .when(F.col("_kind") == "chimeric", let(scrambled(seq, labels, seed, row), lambda other: chimeric(seq, labels, other, seed, row)))
        .when(F.col("_kind") == "scrambled", scrambled(seq, labels, seed, row))
        .otherwise(_read(seq, labels))
    )
    out = marked.withColumn("_new", changed)
    different = (F.col("_new.sequence") != seq) | (F.col("_new.labels") != labels)
    return (
        out.withColumn("is_invalid", F.coalesce(different, F.lit(False)))
        .withColumn("error_type", F.when(F.col("is_invalid"), F.col("_kind")))
        .withColumns({"sequence": F.col("_new.sequence"), "labels": F.col("_new.labels")})
        .drop("_kind", "_new", "quality")
    )


def transcripts(spark: SparkSession, n: int, seed: int, low: int = 200, high: int = 5000) -> DataFrame:
    """(id, seq): n random transcripts of evenly drawn lengths."""
    rows = spark.range(n)
    size = low + pick(seed, high - low + 1, F.col("id"), "transcript length")
    return rows.select("id", random_bases(size, seed, F.col("id"), "transcript").alias("seq"))


def schedule(n: int, kind: str = "increasing", seed: int = 0) -> Column:
    """Diversity of the read with a given ``read_id`` out of n: rising or falling between 0.5 and 2, drawn, or 1."""
    share = F.col("read_id") / max(1, n)
    return {
        "increasing": 0.5 + 1.5 * share,
        "decreasing": 2.0 - 1.5 * share,
        "random": 0.5 + 1.5 * uniform(seed, F.col("read_id"), "diversity"),
        "constant": F.lit(1.0),
    }[kind]
