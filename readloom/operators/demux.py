"""Demultiplexing: architecture validation, barcode matching, sample assignment and statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.seq import lcs_length
from readloom.functions.sizes import at_most
from readloom.operators import membership
from readloom.operators.runs import last_boundaries, segments, slice_of
from readloom.schema import EXPECTED, OPTIONAL, REQUIRED

#: Up to this many samples, each distinct unmatched barcode triple is compared with the whole sheet; a larger
#: sheet is joined on shared pieces of the barcodes, so the work follows the matches and not the product.
SHEET_EVERYWHERE = 64


def order_score(found: Column, expected: Sequence[str], strict: bool = False) -> Column:
    """Share of the expected order that the found segments keep; 0 without segments."""
    want = F.array(*map(F.lit, expected))
    score = F.when(found == want, 1.0).otherwise(0.0) if strict else lcs_length(found, want) / max(1, len(expected))
    return F.when(F.size(found) > 0, score).otherwise(0.0)


def validate(
    found: Column,
    expected: Sequence[str] = EXPECTED,
    required: Sequence[str] = REQUIRED,
    optional: Sequence[str] = OPTIONAL,
    least: float = 0.8,
    reverse: bool = True,
    strict: bool = False,
) -> Column:
    """struct(classification, orientation, issues) of a read's segment names, in order.

    A read without a required segment, or whose order fits neither direction, is invalid; one that only has
    segments that aren't expected is ambiguous; names within an issue are sorted.
    """
    core = [s for s in expected if s not in optional]
    own = F.filter(found, lambda x: ~x.isin(*optional))
    forward = order_score(own, core, strict)
    back = order_score(own, core[::-1], strict) if reverse else F.lit(0.0)
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, required)), found))
    strange = F.array_sort(F.array_except(found, F.array(*map(F.lit, [*expected, *optional]))))
    orientation = F.when(forward >= least, "forward").when(back >= least, "reverse").otherwise("unknown")
    issues = F.concat(
        F.transform(missing, lambda x: F.concat(F.lit("missing:"), x)),
        F.when(orientation == "unknown", F.array(F.lit("order"))).otherwise(F.array().cast("array<string>")),
        F.transform(strange, lambda x: F.concat(F.lit("unexpected:"), x)),
    )
    broken = (F.size(missing) > 0) | (orientation == "unknown")
    kind = F.when(broken, "invalid").when(F.size(strange) > 0, "ambiguous").otherwise("valid")
    return F.struct(kind.alias("classification"), orientation.alias("orientation"), issues.alias("issues"))


def threshold(validation: Column, confidence: Column, least: float = 0.85) -> Column:
    """The same struct; below ``least`` the read is invalid, whatever it was before."""
    low = confidence < least
    return F.struct(
        F.when(low, "invalid").otherwise(validation["classification"]).alias("classification"),
        validation["orientation"].alias("orientation"),
        F.when(low, F.concat(validation["issues"], F.array(F.lit("low_confidence")))).otherwise(validation["issues"]).alias("issues"),
    )


def extract(reads: DataFrame) -> DataFrame:
    """Segments, their last boundaries and the three barcodes of reads with a ``labels`` array."""
    runs = segments(F.col("labels"), F.length("sequence"))
    found = reads.withColumn("segments", runs).withColumn("boundaries", last_boundaries(F.col("segments")))
    codes = {c.lower(): slice_of(F.col("sequence"), F.col("boundaries"), c) for c in ("CBC", "i5", "i7")}
    return found.withColumns(codes)


def edit_distance(read: Column, sample: Column) -> Column:
    """Levenshtein distance; a read's barcode that isn't there or is empty counts as the whole target."""
    return F.when(F.coalesce(F.length(read), F.lit(0)) == 0, F.length(sample)).otherwise(F.levenshtein(read, sample))


def exact(reads: DataFrame, sheet: DataFrame, probe: bool = False) -> DataFrame:
    """Reads with the sample whose three barcodes are equal; of sheet rows with one triple the last counts.

    ``probe``: a filter of the sheet's triples goes before the join, for sheets of millions that few reads match.
    """
    last = sheet.groupBy("cbc", "i5", "i7").agg(F.max_by("sample_name", "sheet_ordinal").alias("sample_name"))
    if probe:
        return membership.probed(reads, last, ["cbc", "i5", "i7"])
    return reads.join(last, ["cbc", "i5", "i7"], "left")


def nearest(triples: DataFrame, sheet: DataFrame, most: int = 2, everywhere: int = SHEET_EVERYWHERE) -> DataFrame:
    """(cbc, i5, i7, sample_name, distance): the sheet row with the least summed edit distance, at most ``most``.

    Ties go to the first row of the sheet. Of two strings within d edits, cut into d + 1 pieces, one piece is
    untouched; a sheet too large to be sent everywhere is joined on that.
    """
    sheet = sheet.select(*[F.col(c).alias("s_" + c) for c in ("cbc", "i5", "i7")], "sample_name", "sheet_ordinal")
    near = [F.abs(F.length(c) - F.length("s_" + c)) <= most for c in ("cbc", "i5", "i7")]
    close = near[0] & near[1] & near[2]
    if sheet.count() <= everywhere:
        pairs = triples.join(F.broadcast(sheet), close)
    else:
        pairs = _sharing(triples, sheet, most).filter(close)
    parts = [edit_distance(F.col(c), F.col("s_" + c)) for c in ("cbc", "i5", "i7")]
    found = pairs.withColumn("distance", parts[0] + parts[1] + parts[2]).filter(F.col("distance") <= most)
    best = found.groupBy("cbc", "i5", "i7").agg(F.min(F.struct("distance", "sheet_ordinal", "sample_name")).alias("best"))
    return best.select("cbc", "i5", "i7", F.col("best.sample_name").alias("sample_name"), F.col("best.distance").alias("distance"))


def _sharing(triples: DataFrame, sheet: DataFrame, most: int) -> DataFrame:
    """Pairs that agree on a piece of the joined barcodes, up to a shift of ``most``."""

    def text(prefix: str) -> Column:
        return F.concat_ws("|", *[F.col(prefix + c) for c in ("cbc", "i5", "i7")])

    sample = text("s_")
    size = F.floor(F.length(sample) / (most + 1)).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), F.lit(most)),
        lambda i: F.struct(i.alias("i"), (i * size).alias("at"), F.substring(sample, i * size + 1, F.when(i == most, F.length(sample)).otherwise(size)).alias("piece")),
    )
    pieces = sheet.withColumn("x", F.explode(cut)).select("*", "x.at", "x.piece").drop("x").withColumn("n", F.length("piece"))
    shapes = [tuple(r) for r in at_most(pieces.select("at", "n").distinct(), 1000, "kinds of barcode pieces").collect()]
    read = text("")
    windows = F.array_distinct(F.flatten(F.array(*[F.array(*[F.substring(read, max(1, at + s + 1), n) for s in range(-most, most + 1)]) for at, n in shapes])))
    probe = triples.withColumn("piece", F.explode(windows))
    keys = [c for c in sheet.columns]
    return probe.join(pieces, "piece").select("cbc", "i5", "i7", *keys).distinct()


def assign(reads: DataFrame, sheet: DataFrame, most: int = 2) -> DataFrame:
    """sample_name, distance and match (exact, corrected, none) for reads with cbc, i5 and i7.

    The exact match is an equi-join. Only distinct triples that it leaves are compared with the sheet, so the
    costly part depends on how many different barcodes there are, not on the reads.
    """
    probed = exact(reads, sheet).withColumnRenamed("sample_name", "_exact")
    triples = probed.filter(F.col("_exact").isNull()).select("cbc", "i5", "i7").distinct().na.drop()
    fuzzy = nearest(triples, sheet, most).withColumnRenamed("sample_name", "_fuzzy")
    both = probed.join(fuzzy, ["cbc", "i5", "i7"], "left")
    match = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_fuzzy").isNotNull(), "corrected").otherwise("none")
    return both.withColumns(
        {
            "match": match,
            "sample_name": F.coalesce("_exact", "_fuzzy", F.lit("undetermined")),
            "distance": F.when(F.col("_exact").isNotNull(), 0).otherwise(F.col("distance")),
        }
    ).drop("_exact", "_fuzzy")


def statistics(assigned: DataFrame) -> DataFrame:
    """Counters of every sample and of all (sample_name null), in one pass, with rates.

    Ambiguous reads count as invalid. A valid read without all of its barcodes is in no match counter.
    """
    valid = F.col("classification") == "valid"
    coded = valid & F.col("cbc").isNotNull() & F.col("i5").isNotNull() & F.col("i7").isNotNull()
    out = assigned.rollup("sample_name").agg(
        F.count("*").alias("total"),
        F.count_if(valid).alias("valid"),
        F.count_if(~valid).alias("invalid"),
        F.count_if(F.col("classification") == "ambiguous").alias("ambiguous"),
        F.count_if(coded & (F.col("match") == "exact")).alias("exact"),
        F.count_if(coded & (F.col("match") == "corrected")).alias("corrected"),
        F.count_if(coded & (F.col("match") == "none")).alias("no_match"),
    )
    return out.withColumns(
        {
            "valid_rate": F.try_divide(F.col("valid"), F.col("total")),
            "assignment_rate": F.try_divide(F.col("exact") + F.col("corrected"), F.col("total")),
        }
    )


def issues(validated: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent issues (issue, n), ties by name."""
    flat = validated.select(F.explode("issues").alias("issue"))
    return flat.groupBy("issue").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "issue").limit(k)


def architecture_counts(validated: DataFrame) -> DataFrame:
    """(classification, orientation, n): how many reads came out in each way."""
    return validated.groupBy("classification", "orientation").agg(F.count("*").alias("n"))


def sheet_issues(sheet: DataFrame, cbc_lengths: Sequence[int] = (6, 8, 10, 16), index_length: int = 8) -> DataFrame:
    """One row for each rule that the sheet breaks: (rule, subject, n)."""
    names = sheet.groupBy("sample_name").count().filter("count > 1").select(F.lit("duplicate_name").alias("rule"), F.col("sample_name").alias("subject"), F.col("count").alias("n"))
    triple = F.concat_ws("+", "cbc", "i5", "i7")
    codes = sheet.groupBy(triple.alias("subject")).count().filter("count > 1").select(F.lit("duplicate_barcodes").alias("rule"), "subject", F.col("count").alias("n"))
    long = sheet.select(
        F.explode(
            F.array(
                F.struct(F.lit("cbc_length").alias("rule"), (~F.length("cbc").isin(*cbc_lengths)).alias("bad")),
                F.struct(F.lit("i5_length").alias("rule"), (F.length("i5") != index_length).alias("bad")),
                F.struct(F.lit("i7_length").alias("rule"), (F.length("i7") != index_length).alias("bad")),
            )
        ).alias("x"),
        "sample_name",
    )
    lengths = long.filter("x.bad").select("x.rule", F.col("sample_name").alias("subject"), F.lit(1).cast("long").alias("n"))
    return names.union(codes).union(lengths)


def first_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, all columns kept: a grouped minimum, which combines map-side and needs no sort."""
    fields = F.struct(order, *[c for c in rows.columns if c != order])
    best = rows.groupBy(F.col(key).alias("_key")).agg(F.min(fields).alias("x")).select("x.*")
    return best.select(rows.columns)


def ranked(rows: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def valid_sequence(sequence: Column) -> Column:
    """Whether a sequence has bases, and none but A, C, G, T and N in either case."""
    return F.coalesce(sequence.rlike("^[ACGTNacgtn]+$"), F.lit(False))


def sequence_findings(sequence: Column, length: Column | None = None, trimmed: bool = False) -> Column:
    """What is wrong with a sequence: ``length`` (not the index entry's; of a trimmed one, longer), ``unknown`` (over half N), ``bases``.

    A null sequence has the wrong length and no valid bases; an empty one has nothing to be unknown.
    """
    n = F.length(sequence)
    unfit = F.lit(False) if length is None else F.coalesce((n > length) if trimmed else (n != length), F.lit(True))
    unknown = n - F.length(F.replace(sequence, F.lit("N"))) > n / 2
    checks = (("length", unfit), ("unknown", F.coalesce(unknown, F.lit(False))), ("bases", F.coalesce(sequence.rlike("[^ACGTN]"), F.lit(True))))
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks]))


def valid_reads(reads: DataFrame) -> DataFrame:
    """Reads that aren't marked invalid, have a valid sequence and as many labels as bases."""
    fits = F.size("labels") == F.length("sequence")
    return reads.filter(~F.coalesce("is_invalid", F.lit(False)) & valid_sequence(F.col("sequence")) & fits)
