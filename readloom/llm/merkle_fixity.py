"""WARC fixity audit (operator 1): Merkle trees over record digests and ordered offset ranges.

A replica is a manifest of records: archive, offset, length and payload. A record's digest is that of
its payload; a leaf is a fixed stretch of an archive's offsets and hashes its records in order; a node
hashes ``fanout`` children. Because leaves are tied to offsets, a damaged or missing record changes one
path of its own tree only. Roots are compared first, and from level to level only the children of
nodes that differ are joined; at the leaves, only records of differing stretches are compared.

Payloads are read once a replica and never shuffled; digests are about 100 bytes a record. Equal
records are counted before a stretch is put together, so repeats take no room. Records without an offset
are dealt by their digest over ``UNPLACED`` stretches of their own, which have negative numbers.

``warc_records`` reads WARC files as such records, with the files' own offsets; ``write_warc`` writes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.llm.common import written

STRETCH = 1 << 16
FANOUT = 16
#: Stretches for the records of an archive that have no offset.
UNPLACED = 1 << 16
#: Levels above the leaves: 16 ** 8 stretches of 64 KB cover any archive.
LEVELS = 8


def digest_of(payload) -> Column:
    """SHA-256 of a payload column; a null payload has its own digest."""
    return F.coalesce(F.sha2(payload.cast("binary"), 256), F.lit("null"))


def digests(records: DataFrame, archive: str, offset: str, length: str, payload: str | None, keys: list[str], digest: str | None = None) -> DataFrame:
    """(archive, offset, length, digest, keys as k0, k1...) of each record, from its payload or a column of digests."""
    found = digest_of(F.col(payload)) if digest is None else F.coalesce(F.col(digest), F.lit("null"))
    return records.select(
        F.coalesce(F.col(archive).cast("string"), F.lit("")).alias("archive"),
        F.coalesce(F.col(offset).cast("long"), F.lit(-1)).alias("offset"),
        F.coalesce(F.col(length).cast("long"), F.lit(-1)).alias("length"),
        found.alias("digest"),
        *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)],
    )


def _stretch_of(stretch: int) -> Column:
    unplaced = -1 - F.pmod(F.xxhash64("length", "digest"), F.lit(UNPLACED))
    return F.when(F.col("offset") < 0, unplaced).otherwise(F.floor(F.col("offset") / stretch)).cast("long")


def _leaves(records: DataFrame, stretch: int) -> DataFrame:
    same = records.groupBy("archive", "offset", "length", "digest").count()
    entry = F.struct("offset", "length", "digest", "count")
    listed = same.groupBy("archive", _stretch_of(stretch).alias("node")).agg(F.sort_array(F.collect_list(entry)).alias("x"))
    return listed.select("archive", "node", F.sha2(F.to_json("x").cast("binary"), 256).alias("hash"))


def _parents(nodes: DataFrame, fanout: int) -> DataFrame:
    up = nodes.groupBy("archive", F.floor(F.col("node") / fanout).cast("long").alias("up"))
    listed = up.agg(F.sort_array(F.collect_list(F.struct("node", "hash"))).alias("x"))
    return listed.select("archive", F.col("up").alias("node"), F.sha2(F.to_json("x").cast("binary"), 256).alias("hash"))


def tree(records: DataFrame, stretch: int = STRETCH, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(archive, level, node, hash): level 0 holds the leaves, the highest level one root an archive."""
    level = _leaves(records, stretch)
    out = level.withColumn("level", F.lit(0))
    for i in range(1, levels + 1):
        level = _parents(level, fanout)
        out = out.union(level.withColumn("level", F.lit(i)))
    return out.select("archive", "level", "node", "hash")


def height(records: DataFrame, stretch: int, fanout: int) -> int:
    """Levels above the leaves so that each archive has one root."""
    last = records.agg(F.max("offset")).first()[0] or 0
    levels, nodes = 1, max(last, 0) // stretch + 1
    while nodes > fanout:
        levels, nodes = levels + 1, -(-nodes // fanout)
    return levels


def audit(
    primary: DataFrame,
    replica: DataFrame,
    archive: str = "archive",
    offset: str = "offset",
    length: str = "length",
    payload: str = "payload",
    keys: tuple[str, ...] = (),
    stretch: int = STRETCH,
    fanout: int = FANOUT,
    digest: str | None = None,
) -> DataFrame:
    """One row for each record that differs: a place (archive, offset) has as many as it lost or won.

    Digests are those of ``payload``, or a column ``digest`` of both. Returns archive, offset, the primary's ``keys``, lengths and digests of both, and kind: ``missing``
    (not in the replica), ``extra`` (only there), ``resized`` (another length) or ``altered`` (another
    payload). Of several records that claim one place, those of equal length are paired first, by digest,
    then the others, the longest first. Each lost copy of equal records is a row; their ``keys`` are null
    where other copies are still there, as nothing tells which of them was lost.
    Null archives are the archive ''; null offsets and lengths are -1; null payloads differ from empty
    ones. Empty replicas make every record missing or extra; equal replicas give no rows.
    """
    mine = written(digests(primary, archive, offset, length, payload, list(keys), digest), "fixity")
    theirs = written(digests(replica, archive, offset, length, payload, [], digest), "fixity")
    named, keys = list(keys), [f"k{i}" for i in range(len(keys))]
    levels = max(height(mine, stretch, fanout), height(theirs, stretch, fanout))
    trees = [written(tree(x, stretch, fanout, levels), "tree") for x in (mine, theirs)]

    def differing(level: int, below: DataFrame | None) -> DataFrame:
        a, b = [t.filter(F.col("level") == level).select("archive", "node", "hash") for t in trees]
        if below is not None:  # children of nodes that differ; no other branch is opened
            a, b = [
                x.join(below, (x["archive"] == below["a"]) & (F.floor(x["node"] / fanout) == below["n"]), "left_semi") for x in (a, b)
            ]
        both = a.withColumnRenamed("hash", "ha").join(b.withColumnRenamed("hash", "hb"), ["archive", "node"], "full")
        return both.filter(~F.col("ha").eqNullSafe(F.col("hb"))).select(F.col("archive").alias("a"), F.col("node").alias("n"))

    nodes = None
    for level in range(levels, -1, -1):
        nodes = written(differing(level, nodes), "differing")
    at = _stretch_of(stretch)

    def records(x: DataFrame) -> DataFrame:
        return x.join(nodes, (x["archive"] == nodes["a"]) & (at == nodes["n"]), "left_semi")

    # equal records are counted, and only those whose counts differ are listed, a row for each copy
    own = ["archive", "offset", "length", "digest"]
    a = records(mine).groupBy(*own).agg(F.count("*").alias("n"))
    b = records(theirs).groupBy(*own).agg(F.count("*").alias("m"))
    over = F.coalesce("n", F.lit(0)) - F.coalesce("m", F.lit(0))
    odd = written(a.join(b, own, "full").withColumn("over", over).filter("over <> 0"), "odd")
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.abs("over"))).alias("copy")
    lost = records(mine).join(odd.filter("m IS NULL").select(*own), own, "left_semi").select(*own, *keys)
    some = odd.filter("over > 0 AND m IS NOT NULL").select(*own, copy)
    lost = lost.union(some.select(*own, *[F.lit(None).cast(mine.schema[k].dataType).alias(k) for k in keys]))
    more = odd.filter("over < 0").select(*own, copy).drop("copy")

    def paired(x: DataFrame, y: DataFrame, by: list[str], x_by: list, y_by: list) -> DataFrame:
        x = x.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(*x_by)))
        y = y.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(*y_by)))
        return x.join(y, [*by, "k"], "full").drop("k")

    # first those of one length at a place, then what is left there, the longest first
    x = lost.select("archive", "offset", "length", F.struct("length", "digest", *keys).alias("a"))
    y = more.select("archive", "offset", "length", F.struct("length", "digest").alias("b"))
    first = written(paired(x, y, ["archive", "offset", "length"], ["a"], ["b"]).drop("length"), "paired")
    x, y = first.filter("b IS NULL").drop("b"), first.filter("a IS NULL").drop("a")
    rest = paired(x, y, ["archive", "offset"], [F.desc("a.length"), "a"], [F.desc("b.length"), "b"])
    sides = first.filter("a IS NOT NULL AND b IS NOT NULL").unionByName(rest)
    kind = (
        F.when(F.col("b").isNull(), "missing")
        .when(F.col("a").isNull(), "extra")
        .when(F.col("a.length") != F.col("b.length"), "resized")
        .otherwise("altered")
    )
    return sides.select(
        "archive",
        "offset",
        *[F.col(f"a.{k}").alias(name) for k, name in zip(keys, named)],
        F.col("a.length").alias("length"),
        F.col("b.length").alias("replica_length"),
        F.col("a.digest").alias("digest"),
        F.col("b.digest").alias("replica_digest"),
        kind.alias("kind"),
    )


# --- WARC files -----------------------------------------------------------------------------------

_VERSION = "WARC/1.0\r\n"
_BETWEEN = "\r\n\r\n"
#: What every version line starts with, and what it is after that.
_MARK, _NUMBER = "WARC/", r"^\d+\.\d+\r\n"


def warc_records(spark: SparkSession, path: str, keep_block: bool = False) -> DataFrame:
    """The records of WARC files: archive (the file), offset, length, type, id, url, digest, whole (and block).

    Files are read by Spark's own readers, from any store, large ones in parts. offset and length are the
    record's place in its file, headers and the blank lines after it included (of a compressed file: of what it
    unpacks to); digest is the SHA-256 of its block. whole is false where the block's length isn't the
    header's Content-Length: in a file that was cut short, or where the block itself holds two line ends and the start of a
    version line, at which it is cut (both parts are then rows that aren't whole). Records of any version, mixed ones too, are
    told apart; a file that doesn't start with a version line is refused. Only digests and lengths are brought together by
    file, to add up offsets. Header names count in any letter case; missing headers are null. Empty files
    give no rows; bytes that aren't UTF-8 stay as they are.
    """
    # a record ends where two line ends and the next version line stand; what stands before is whole
    parts = spark.read.option("lineSep", _BETWEEN + _MARK).text(path).select(
        F.col("_metadata.file_path").alias("archive"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("n"), "value"
    )
    body = F.when(F.startswith("value", F.lit(_MARK)), F.substring("value", F.lit(len(_MARK) + 1), F.length("value"))).otherwise(F.col("value"))
    parts = parts.select("*", body.alias("body")).withColumn("cut", F.instr("body", _BETWEEN))
    head = F.when(F.col("cut") > 0, F.substring("body", F.lit(1), F.col("cut") - 1)).otherwise(F.col("body"))
    after = F.when(F.col("cut") > 0, F.substring("body", F.col("cut") + len(_BETWEEN), F.length("body"))).otherwise(F.lit(""))
    # the last record of a file still has its two line ends
    block = F.when(F.endswith("after", F.lit(_BETWEEN)), F.substring("after", F.lit(1), F.length("after") - len(_BETWEEN))).otherwise(F.col("after"))
    parts = parts.select("archive", "part", "n", head.alias("head"), after.alias("after"), F.octet_length("body").alias("bytes"))
    stated = F.regexp_extract("head", r"(?im)^content-length:[ \t]*(\d+)", 1).try_cast("long")
    fits = F.octet_length("after") == stated

    def header(name: str) -> Column:
        return F.nullif(F.regexp_extract("head", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))

    # a block that ends in two line ends of its own is told by its length
    found = parts.withColumn("block", F.when(fits, F.col("after")).otherwise(block))
    rest = F.octet_length("after") - F.octet_length("block")
    found = found.select(
        "archive", "part", "n", (F.col("bytes") - rest + len(_MARK) + len(_BETWEEN)).cast("long").alias("length"), F.rlike("head", F.lit(_NUMBER)).alias("versioned"),
        header("warc-type").alias("type"), header("warc-record-id").alias("id"), header("warc-target-uri").alias("url"),
        digest_of(F.col("block")).alias("digest"), F.coalesce(F.octet_length("block") == stated, F.lit(False)).alias("whole"),
        *(["block"] if keep_block else []),
    )
    found = found.filter(f"length > {len(_MARK) + len(_BETWEEN)} or type is not null")
    along = Window.partitionBy("archive").orderBy("part", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = found.withColumn("offset", F.sum("length").over(along) - F.col("length"))
    refused = F.raise_error(F.concat(F.lit("not a WARC file: "), "archive")).cast("long")
    return found.withColumn("offset", F.when((F.col("offset") == 0) & ~F.col("versioned"), refused).otherwise(F.col("offset"))).drop("part", "n", "versioned")


def write_warc(records: DataFrame, path: str, archive: str = "archive", order: str = "offset", url: str = "url", block: str = "payload") -> None:
    """Writes records as WARC files, a folder ``archive=...`` for each archive, in the order of a column.

    Each record gets the headers WARC-Type (resource), WARC-Record-ID (a digest of its place and block),
    WARC-Target-URI and Content-Length. Null blocks are written as empty ones, null URLs without the header.
    """
    body = F.coalesce(F.col(block).cast("string"), F.lit(""))
    name = F.md5(F.concat_ws("|", F.col(archive).cast("string"), F.col(order).cast("string"), body).cast("binary"))
    lines = F.concat_ws(
        "\r\n", F.lit(_VERSION[:-2]), F.lit("WARC-Type: resource"), F.concat(F.lit("WARC-Record-ID: <urn:md5:"), name, F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.col(url)), F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    )
    value = F.concat(lines, F.lit(_BETWEEN), body).alias("value")
    rows = records.select(F.col(archive).alias("archive"), F.col(order).alias("at"), value)
    rows.repartition("archive").sortWithinPartitions("archive", "at").select("archive", "value").write.partitionBy("archive").option("lineSep", _BETWEEN).text(path)
