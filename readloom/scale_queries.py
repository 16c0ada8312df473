"""Queries of the sources, searches and fits that are built for large data: the same register as ``queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from readloom.functions import seq
from readloom.operators import calibrate, combine, demux, ensemble, heavy, membership, motif, quantiles, runs
from readloom.plans import ensembles, inputs
from readloom.plans.settings import EnsembleSettings
from readloom.queries import (
    ASSIGNED_SQL,
    CODED_SQL,
    COMBINED_SQL,
    MATRIX,
    MOTIFS_SQL,
    PRED_SQL,
    READS_SQL,
    ROUNDED_SQL,
    SQL,
    TRUTH_SQL,
    _folder,
    _r,
    _weights,
    _with_quality,
    architecture_validate,
    query,
)
from readloom.sources import fasta, fastq, ranges, register, sinks, tables
from readloom.streaming import stateful

# --- FASTA --------------------------------------------------------------------------------------------


def _written_fasta(spark, sf, name: str, width: int, line_end: str = "\n") -> str:
    path = _folder(spark, name)
    head = F.concat(F.lit("r"), F.col("read_id").cast("string"))
    records = inputs.reads(spark, sf).select(head.alias("name"), F.lit("of a document").alias("note"), "sequence", "read_id")
    fasta.write(records, path, width, line_end, by=(F.floor(F.col("read_id") / 40), "read_id"))
    return path


@query(
    f"""WITH {READS_SQL}, r AS (SELECT read_id, read_id // 40 AS part, 'r' || read_id AS name, strlen('>r' || read_id || ' of a document') + 2 AS head FROM reads)
    SELECT part, name, 64 AS length, sum(head + 64 + 3 * 2) OVER (PARTITION BY part ORDER BY read_id) - (64 + 3 * 2) AS "offset", 23 AS line_bases, 25 AS line_width FROM r"""
)
def fasta_index(spark, sf):
    """The index of FASTA files with Windows line ends, made by all tasks; places are told by the sums of the parts before."""
    found = fasta.read_split(spark, f"{_written_fasta(spark, sf, 'lines', 23, chr(13) + chr(10))}/*")
    part = F.regexp_extract("file", "part=([0-9]+)/", 1).cast("long")
    return fasta.index(found, files=True).select(part.alias("part"), "name", "length", "offset", "line_bases", "line_width")


@query(
    f"""WITH {READS_SQL} SELECT o_orderkey, name, sequence FROM (SELECT o_orderkey, 'r' || o_custkey % 300 AS name FROM orders)
    LEFT JOIN (SELECT 'r' || read_id AS name, sequence FROM reads) USING (name)"""
)
def sequences_by_offset(spark, sf):
    """Sequences by name, read from the bytes that the index says they have; those of other names aren't read."""
    found = fasta.read_split(spark, f"{_written_fasta(spark, sf, 'ranges', 20)}/*")
    path = _folder(spark, "entries")
    fasta.index(found, files=True).write.parquet(path)
    orders = inputs.table(spark, sf, "orders")
    wanted = orders.select("o_orderkey", F.concat(F.lit("r"), (F.col("o_custkey") % 300).cast("string")).alias("name"))
    return ranges.fetch_ranges(wanted, spark.read.parquet(path))


@query(
    f"""WITH {READS_SQL}, s AS (SELECT read_id, CASE read_id % 6 WHEN 0 THEN translate(sequence, 'ACG', 'NNN') WHEN 1 THEN sequence || 'RX' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE sequence END AS s,
      CASE WHEN read_id % 5 = 0 THEN 60 ELSE 64 END AS n FROM reads)
    SELECT read_id, concat_ws(',', CASE WHEN s IS NULL OR length(s) <> n THEN 'length' END, CASE WHEN length(s) > 0 AND length(s) - length(replace(s, 'N', '')) > length(s) / 2 THEN 'unknown' END,
      CASE WHEN s IS NULL OR regexp_matches(s, '[^ACGTN]') THEN 'bases' END) AS findings FROM s"""
)
def sequence_findings(spark, sf):
    """What is wrong with a sequence beside its index entry."""
    k = F.col("read_id") % 6
    s = F.when(k == 0, F.translate("sequence", "ACG", "NNN")).when(k == 1, F.concat("sequence", F.lit("RX"))).when(k == 2, "").when(k == 3, None).otherwise(F.col("sequence"))
    found = demux.sequence_findings(s, F.when(F.col("read_id") % 5 == 0, 60).otherwise(64))
    return inputs.reads(spark, sf).select("read_id", F.array_join(found, ",").alias("findings"))


# --- reads as JSON, FASTQ by sample -----------------------------------------------------------------------


@query(f"WITH {READS_SQL} SELECT read_id::VARCHAR AS id, sequence, 64 AS n_labels, 52 AS cbc_end, CASE WHEN read_id % 2 = 0 THEN 'a \"}}]\\' ELSE 'none' END AS note FROM reads")
def invalid_reads_json(spark, sf):
    """Invalid reads as indented lists, one a file, and read again in parts."""
    path = _folder(spark, "lists")
    regions = F.map_from_entries(F.array(*[F.struct(F.lit(name), F.array(F.array(F.lit(a), F.lit(b)))) for name, a, b in inputs.LAYOUT]))
    note = F.when(F.col("read_id") % 2 == 0, 'a "}]\\').otherwise("none")
    metadata = F.create_map(F.lit("id"), F.col("read_id").cast("string"), F.lit("note"), note)
    sinks.write_json_lists(inputs.reads(spark, sf).select("sequence", "labels", regions.alias("label_regions"), metadata.alias("metadata")), path)
    found = tables.read_invalid(spark, path)
    return found.select(
        F.col("metadata")["id"].alias("id"), "sequence", F.size("labels").alias("n_labels"), F.col("label_regions")["CBC"][0][1].alias("cbc_end"), F.col("metadata")["note"].alias("note")
    )


@query(f"WITH {READS_SQL} SELECT read_id::VARCHAR AS read_id, 'S' || read_id % 7 AS sample, sequence, translate(sequence, 'ACGT', '+@IF') AS quality FROM reads")
def fastq_committed(spark, sf):
    """Reads by sample through the committing sink, and read again."""
    register(spark)
    path = _folder(spark, "committed")
    named = _with_quality(spark, sf).withColumn("sample_name", F.concat(F.lit("S"), (F.col("read_id").cast("long") % 7).cast("string")))
    named.write.format("fastq_samples").mode("append").save(path)
    found = fastq.read_split(spark, f"{path}/sample=*")
    return found.select("read_id", F.regexp_extract("file", "sample=([^/]*)/", 1).alias("sample"), "sequence", "quality")


@query(
    f"""WITH {MOTIFS_SQL}, m AS (SELECT read_id, CASE WHEN read_id % 2 = 0 THEN lower(translate(motif, 'T', 'U')) ELSE motif || 'X' END AS motif FROM motifs)
    SELECT read_id, motif, translate(upper(motif), 'ACGTUX', '012304') AS codes FROM m"""
)
def base_encode_training(spark, sf):
    """Numbers of the training arrays; U has that of A."""
    m = F.when(F.col("read_id") % 2 == 0, F.lower(F.translate("motif", "T", "U"))).otherwise(F.concat("motif", F.lit("X")))
    rows = inputs.motifs(spark, sf).select("read_id", m.alias("motif"))
    return rows.select("read_id", "motif", F.array_join(F.transform(seq.encode(F.col("motif"), "training"), lambda x: x.cast("string")), "").alias("codes"))


@query(f"SELECT read_id, CASE WHEN score >= 0.85 THEN pos END AS pos, score >= 0.85 AS detected FROM ({SQL['pwm_best_match']})")
def motif_detected(spark, sf):
    """Whether a read has the motif, and where."""
    best = motif.best_match(F.col("sequence"), MATRIX)
    found = inputs.reads(spark, sf).select("read_id", best.alias("m")).select("read_id", "m", motif.detected(F.col("m"), 0.85).alias("detected"))
    return found.select("read_id", F.when(F.col("detected"), F.col("m.pos")).alias("pos"), "detected")


@query(
    f"""WITH {READS_SQL}, x AS (SELECT read_id, sequence, unnest([8, 16, 44]) AS start, unnest([12, 22, 60]) AS "end" FROM reads WHERE read_id % 3 <> 0)
    SELECT read_id, start, "end", substr(sequence, start + 1, "end" - start) AS bases FROM x"""
)
def motif_instances(spark, sf):
    """The bases of every run of one label; some reads have none, some several."""
    label = lambda i: F.when((i < 12) & (i >= 8) | (i >= 16) & (i < 22) | (i >= 44) & (i < 60), "ACC").otherwise("cDNA")
    labels = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(F.col("read_id") % 3 == 0, "cDNA").otherwise(label(i)))
    reads = inputs.reads(spark, sf).select("read_id", "sequence", labels.alias("labels"))
    found = reads.select("read_id", F.explode(runs.instances(F.col("sequence"), runs.segments(F.col("labels"), F.length("sequence")), "ACC")).alias("x"))
    return found.select("read_id", "x.*")


@query(f"SELECT classification, orientation, count(*) AS n FROM ({SQL['architecture_validate']}) GROUP BY ALL")
def architecture_counts(spark, sf):
    """How many reads each classification and orientation has."""
    return demux.architecture_counts(architecture_validate(spark, sf))


@query(f"WITH {READS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY read_id // 40 ORDER BY read_id) AS n FROM reads) SELECT read_id // 40 AS part, read_id::VARCHAR AS read_id FROM r WHERE n <= 7")
def fastq_first_of_each_file(spark, sf):
    """The first seven reads of each file."""
    path = _folder(spark, "capped")
    rows = _with_quality(spark, sf).withColumn("part", F.floor(F.col("read_id").cast("long") / 40))
    lines = F.concat_ws("\n", F.concat(F.lit("@"), "read_id"), "sequence", F.lit("+"), "quality")
    dealt = rows.select(lines.alias("value"), "part", F.col("read_id").cast("long").alias("at")).repartition("part").sortWithinPartitions("part", "at")
    dealt.select("value", "part").write.partitionBy("part").text(path)
    found = fastq.read_split(spark, f"{path}/*", most_per_file=7)
    return found.select(F.regexp_extract("file", "part=([0-9]+)/", 1).cast("long").alias("part"), "read_id")


# --- counts and membership ----------------------------------------------------------------------------


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[a-zA-Z]+')) AS word FROM documents) GROUP BY word ORDER BY n DESC, word LIMIT 50")
def frequent_words(spark, sf):
    """The most frequent words of all texts, counted exactly among those that summaries can't rule out."""
    words = inputs.table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[a-zA-Z]+"), F.lit(0))).alias("word"))
    return heavy.most_frequent(words, "word", 50)


@query(f"WITH {CODED_SQL} SELECT read_id, cbc FROM coded WHERE cbc IN (SELECT cbc FROM sheet)")
def whitelist_filtered(spark, sf):
    """Reads whose barcode is listed: bits first, then the join."""
    return membership.members(inputs.coded(spark, sf), inputs.sheet(spark, sf), ["cbc"]).select("read_id", "cbc")


@query(f"WITH {ASSIGNED_SQL} SELECT read_id, e AS sample_name FROM exact")
def barcode_probed(spark, sf):
    """The exact sample of each read; reads whose barcodes no sample has stay where they are."""
    return demux.exact(inputs.coded(spark, sf), inputs.sheet(spark, sf), probe=True).select("read_id", "sample_name")


@query(
    """SELECT event_type, share::DOUBLE AS share, count(*) AS n, true AS within FROM events, (VALUES (0.1), (0.5), (0.9)) s(share)
    WHERE value IS NOT NULL GROUP BY ALL"""
)
def value_quantiles(spark, sf):
    """Quantiles from daily sketches brought together, and whether each estimate's rank is within two in a hundred of the wanted one."""
    events = inputs.table(spark, sf, "events").select("event_type", F.to_date("ts").alias("day"), "value")
    kept = quantiles.merged(quantiles.sketched(events, "value", ["day", "event_type"]), ["event_type"])
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("share"), quantiles.quantile(F.col("sketch"), s).alias("estimate")) for s in (0.1, 0.5, 0.9)]))
    found = kept.select("event_type", "n", each.alias("x")).select("event_type", "n", "x.*")
    errors = quantiles.rank_errors(events, found.drop("n"), "value", "event_type")
    within = (F.col("low") - 0.02 <= F.col("share")) & (F.col("share") <= F.col("high") + 0.02)
    return errors.join(found.select("event_type", "share", "n"), ["event_type", "share"]).select("event_type", "share", "n", within.alias("within"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def first_arrivals(spark, sf):
    """The first event of each user from a stream with keyed state; a user is forgotten long after the last one."""
    for key, value in stateful.STORE.items():
        spark.conf.set(key, value)
    out, there = _folder(spark, "first"), _folder(spark, "first-state")
    events = spark.readStream.schema(inputs.table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_id", "user_id", "event_type")
    first = stateful.first_occurrences(rows, "user_id", keep="100000 days")
    first.writeStream.format("parquet").option("checkpointLocation", there).option("path", out).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out).select("user_id", "event_id", "event_type")


# --- fits -----------------------------------------------------------------------------------------------

_SHARP_SQL = f"""{ROUNDED_SQL}, {TRUTH_SQL}, sharp AS (SELECT c.read_id, c.pos, c.label, t.label AS truth,
  pow(p * CASE WHEN c.label = t.label AND c.read_id % 3 <> 0 THEN 4 ELSE 1 END, 3) AS w FROM combined c JOIN truth t USING (read_id, pos)),
  calm AS (SELECT read_id, pos, label, truth, w / sum(w) OVER (PARTITION BY read_id, pos) AS p FROM sharp)"""


def _sharp(spark, sf):
    """Combined probabilities, those of the truth raised at two reads in three, then all made too sure."""
    combined = ensemble.average(inputs.predictions(spark, sf), _weights(spark)).withColumn("p", F.round("p", 12))
    truth = inputs.truth(spark, sf)
    both = combined.join(truth.withColumnRenamed("label", "truth"), ["read_id", "pos"])
    w = F.pow(F.col("p") * F.when((F.col("label") == F.col("truth")) & (F.col("read_id") % 3 != 0), 4).otherwise(1), F.lit(3))
    cells = both.select("read_id", "pos", "label", w.alias("p"))
    return ensemble.normalised(cells), truth


def _finer(name: str, source: str, step: float) -> str:
    """The last of a thousand inverse temperatures from ``lo`` on, ``step`` apart, whose derivative is below 0."""
    slope = "list_sum([v * exp(b * v) FOR v IN xs]) / list_sum([exp(b * v) FOR v IN xs]) - own"
    return f"{name} AS (SELECT max(b) AS lo FROM (SELECT b FROM (SELECT lo + {step!r} * i AS b FROM {source}, range(1000) r(i)), places GROUP BY b HAVING sum({slope}) < 0))"


@query(
    f"""WITH {_SHARP_SQL}, places AS (SELECT list(ln(p + 1e-10)) AS xs, max(CASE WHEN label = truth THEN ln(p + 1e-10) END) AS own FROM calm GROUP BY read_id, pos),
    l0 AS (SELECT 0.1::DOUBLE AS lo), {_finer('l1', 'l0', 0.0099)}, {_finer('l2', 'l1', 1e-5)}, {_finer('l3', 'l2', 1e-8)}
    SELECT round(1 / (lo + 5e-9), 5) AS temperature, round((SELECT avg(ln(list_sum([exp(lo * v) FOR v IN xs])) - lo * own) FROM places), 6) AS nll, true AS flat FROM l3"""
)
def temperature_fitted(spark, sf):
    """The likeliest temperature by Newton steps, and that no slope is left there."""
    found = calibrate.fit_temperature(*_sharp(spark, sf))
    rows = [(round(found.temperature, 5), round(found.nll, 6), abs(found.gradient) < 1e-6)]
    return spark.createDataFrame(rows, "temperature double, nll double, flat boolean")


_BMA_SQL = f"""{PRED_SQL}, {TRUTH_SQL}, l AS (SELECT model, sum(ln(p + 1e-10)) AS l, count(DISTINCT read_id) AS reads FROM pred JOIN truth USING (read_id, pos, label) GROUP BY model),
  z AS (SELECT model, (l - 4 / 2 * ln(reads)) / 50.0 + ln(1 / 3) AS x FROM l), e AS (SELECT model, exp(x - max(x) OVER ()) AS e FROM z),
  bma AS (SELECT model, e / sum(e) OVER () AS weight FROM e),
  t AS (SELECT sum(CASE model WHEN 'm0' THEN p END) AS a, sum(CASE model WHEN 'm1' THEN p END) AS b, sum(CASE model WHEN 'm2' THEN p END) AS c FROM pred JOIN truth USING (read_id, pos, label) GROUP BY read_id, pos),
  g AS (SELECT i / 10 AS x, j / 10 AS y, (10 - i - j) / 10 AS z FROM range(11) x(i), range(11) y(j) WHERE i + j <= 10),
  best AS (SELECT x, y, z FROM t, g GROUP BY x, y, z ORDER BY sum(ln(a * x + b * y + c * z + 1e-10)) DESC, x, y, z LIMIT 1)"""


@query(
    f"""WITH {_BMA_SQL} SELECT 'bma' AS method, model, {_r('weight')} AS weight FROM bma UNION ALL SELECT 'voting', model, {_r('1 / 3')} FROM bma
    UNION ALL SELECT 'weighted_average', unnest(['m0', 'm1', 'm2']), {_r('unnest([x, y, z])')} FROM best"""
)
def method_weights(spark, sf):
    """The models' weights by each way to choose them."""
    p, t = inputs.predictions(spark, sf), inputs.truth(spark, sf)
    parts = [combine.weights(p, t, m, temperature=50.0, parameters=dict.fromkeys(inputs.MODELS, 4)).select(F.lit(m).alias("method"), "model", "weight") for m in ("bma", "voting", "weighted_average")]
    return parts[0].union(parts[1]).union(parts[2])


@query(f"WITH {COMBINED_SQL}, {TRUTH_SQL} SELECT count(*) AS cells, count(DISTINCT (read_id, pos)) AS places, true AS adds_up FROM combined")
def stacked_shape(spark, sf):
    """Every place and label has a stacked probability, and those of a place add up to 1."""
    p, t = inputs.predictions(spark, sf), inputs.truth(spark, sf)
    out = combine.predict(p, p, t, "stacking", labels=list(range(inputs.CLASSES)))
    places = out.groupBy("read_id", "pos").agg(F.sum("p").alias("p"), F.count("*").alias("n"))
    return places.agg(F.sum("n").alias("cells"), F.count("*").alias("places"), F.bool_and(F.abs(F.col("p") - 1) < 1e-9).alias("adds_up"))



@query(
    f"""WITH {_SHARP_SQL}, e AS (SELECT read_id, pos, label, p / (sum(p) OVER (PARTITION BY read_id, pos) + 1e-10) AS p FROM calm),
    w AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY read_id, pos ORDER BY p DESC, label) = 1),
    h AS (SELECT read_id, pos, -sum(p * ln(p + 1e-10)) AS entropy FROM e GROUP BY ALL)
    SELECT read_id, pos, label, {_r('p')} AS p, {_r('entropy')} AS entropy FROM w JOIN h USING (read_id, pos)"""
)
def ensemble_path(spark, sf):
    """The whole path for one model that is given as it is: weight 1, no calibration, its labels and entropies."""
    sharp, truth = _sharp(spark, sf)
    given = sharp.select(F.lit("m").alias("model"), "read_id", "pos", "label", "p")
    return ensembles.combine_models(given, truth, given, EnsembleSettings(method="voting")).labels
