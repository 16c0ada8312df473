"""Reads, labels, barcodes, sheets and predictions derived from the benchmark tables by digests of their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEX = "0123456789abcdef"
#: A hexadecimal digit's base.
AS_BASES = "ACGT" * 4
MODELS = ("m0", "m1", "m2")
#: Places of a read that predictions are made for, and labels to choose from.
PLACES, CLASSES = 8, 4
#: Layout of the digest reads: label, start, end.
LAYOUT = (("i7", 0, 8), ("UMI", 8, 16), ("ACC", 16, 22), ("cDNA", 22, 44), ("CBC", 44, 52), ("i5", 52, 60), ("p5", 60, 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digest(key: Column, suffix: str = "") -> Column:
    text = key.cast("string")
    return F.md5((F.concat(text, F.lit(suffix)) if suffix else text).cast("binary"))


def digit(text: Column, i: Column | int) -> Column:
    """The value, 0 to 15, of a digest's i-th digit (from 0)."""
    code = F.ascii(F.substring(text, i + 1 if isinstance(i, Column) else F.lit(i + 1), F.lit(1)))
    return code - F.when(code < 58, 48).otherwise(87)


def as_bases(text: Column) -> Column:
    return F.translate(text, HEX, AS_BASES)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, sequence of 64 bases, labels) of every document."""
    key = F.col("doc_id")
    seq = as_bases(F.concat(digest(key), digest(key, "-1")))
    labels = F.flatten(F.array(*[F.array_repeat(F.lit(name), end - start) for name, start, end in LAYOUT]))
    return table(spark, sf_dir, "documents").select(key.alias("read_id"), seq.alias("sequence"), labels.alias("labels"))


def motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, motif of 6 bases)."""
    return reads(spark, sf_dir).select("read_id", F.substring("sequence", 17, 6).alias("motif"))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, pos, label): each user's events in order."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return events.select(F.col("user_id").alias("read_id"), (F.row_number().over(order) - 1).alias("pos"), F.col("event_type").alias("label"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, pos, truth, label): every event's type, and the type of the user's event before it as prediction."""
    order = Window.partitionBy("read_id").orderBy("pos")
    rows = states(spark, sf_dir)
    return rows.select("read_id", "pos", F.col("label").alias("truth"), F.coalesce(F.lag("label").over(order), F.col("label")).alias("label"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, read_id, pos, label, p): three models' probabilities of four labels at eight places."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("read_id"), F.explode(F.array(*map(F.lit, MODELS))).alias("model"))
    cells = docs.select("model", "read_id", F.md5(F.concat(F.col("read_id").cast("string"), F.lit("-"), "model").cast("binary")).alias("h"))
    # digits are taken after the rows are made, so that counting rows takes none
    long = cells.select("model", "read_id", "h", F.explode(F.array(*map(F.lit, range(PLACES * CLASSES)))).alias("i"))
    first = F.col("i") - F.col("i") % CLASSES
    # a place's labels are neighbours in the digest, so their sum needs no grouping
    total = sum((1 + digit(F.col("h"), first + k) for k in range(1, CLASSES)), 1 + digit(F.col("h"), first))
    p = (1 + digit(F.col("h"), F.col("i"))) / total
    return long.select("model", "read_id", F.floor(F.col("i") / CLASSES).cast("int").alias("pos"), (F.col("i") % CLASSES).alias("label"), p.alias("p"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, pos, label)."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("read_id"), digest(F.col("doc_id"), "-t").alias("h"))
    long = docs.select("read_id", "h", F.explode(F.sequence(F.lit(0), F.lit(PLACES - 1))).alias("pos"))
    return long.select("read_id", "pos", (digit(F.col("h"), F.col("pos")) % CLASSES).alias("label"))


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample for each supplier; its barcodes are bases of its key's digest."""
    h = as_bases(digest(F.col("s_suppkey"), "-s"))
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("long").alias("sheet_ordinal"),
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("sample_name"),
        F.substring(h, 1, 8).alias("cbc"),
        F.substring(h, 9, 8).alias("i5"),
        F.substring(h, 17, 8).alias("i7"),
    )


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, cbc, i5, i7, classification) of every customer: a supplier's barcodes, damaged by the key's remainder.

    Remainder 0, 1: as they are; 2: one base of cbc changed; 3: one base of i5 and one of i7; 4: no sample's.
    """
    suppliers = sheet(spark, sf_dir).select(F.col("sheet_ordinal").alias("k"), "cbc", "i5", "i7")
    n = suppliers.count()
    c = F.col("c_custkey").cast("long")
    own = as_bases(digest(c, "-c"))
    rows = table(spark, sf_dir, "customer").select(c.alias("read_id"), (c % F.lit(n) + suppliers.agg(F.min("k")).first()[0]).alias("k"), own.alias("own"))
    joined = rows.join(suppliers, "k")
    r = F.col("read_id") % 5
    other = F.translate(F.substring("cbc", 1, 1), "ACGT", "CGTA")
    changed = {
        "cbc": F.when(r == 2, F.concat(other, F.substring("cbc", 2, 7))).when(r == 4, F.substring("own", 1, 8)).otherwise(F.col("cbc")),
        "i5": F.when(r == 3, F.concat(F.translate(F.substring("i5", 1, 1), "ACGT", "CGTA"), F.substring("i5", 2, 7))).when(r == 4, F.substring("own", 9, 8)).otherwise(F.col("i5")),
        "i7": F.when(r == 3, F.concat(F.translate(F.substring("i7", 1, 1), "ACGT", "CGTA"), F.substring("i7", 2, 7))).when(r == 4, F.substring("own", 17, 8)).otherwise(F.col("i7")),
    }
    kind = F.when(F.col("read_id") % 11 == 0, "invalid").when(F.col("read_id") % 13 == 0, "ambiguous").otherwise("valid")
    return joined.select("read_id", *[v.alias(k) for k, v in changed.items()], kind.alias("classification"))
