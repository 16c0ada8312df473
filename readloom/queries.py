"""Queries over the benchmark tables, one for each operator, with the same thing said in SQL where SQL can.

Whole numbers are long and doubles rounded to 9 digits, so that results of two engines can be compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.functions import scratch, seq
from readloom.operators import calibrate, choose, decode, demux, ensemble, evaluate, motif, runs, simulate
from readloom.plans import inputs
from readloom.plans.demultiplex import Demultiplexed, validate_fastq, write_validated
from readloom.plans.demultiplex import write as write_demultiplexed
from readloom.plans.settings import DemuxSettings
from readloom.schema import IUPAC
from readloom.sources import fasta, fastq, sinks, tables
from readloom.streaming import demux_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# The motif matrix, a row a position, probabilities of A, C, G and T.
MOTIF = (
    (0.944634482890082, 0.026079325376165, 0.007367199880516, 0.021918991853238),
    (0.010948997911672, 0.833559568052585, 0.007340128784079, 0.148151305251663),
    (0.009312858592557, 0.939596770176530, 0.030570179128221, 0.020520192102693),
    (0.014825926664539, 0.315593978345172, 0.657064885177785, 0.012515209812504),
    (0.032502630837710, 0.143717537372028, 0.812125929231274, 0.011653902558988),
    (0.165142125489160, 0.159843001981152, 0.660138392862026, 0.014876479667662),
)
MATRIX = [dict(zip("ACGT", row)) for row in MOTIF]
BOUNDS = (("click", 1, 2), ("error", 1, 1), ("purchase", 2, 3), ("signup", 1, 3), ("view", 1, 1))
WEIGHTS = (("m0", 0.5), ("m1", 0.3), ("m2", 0.2))
MOVES = [[-0.1 if a == b else -1.5 - 0.1 * b for b in range(4)] for a in range(4)]

PWM_SQL = "pwm(pos, base, prob) AS (VALUES " + ", ".join(
    f"({i}, '{b}', CAST({p!r} AS DOUBLE))" for i, row in enumerate(MOTIF) for b, p in zip("ACGT", row)
) + ")"
BOUNDS_SQL = "bounds(label, min_len, max_len) AS (VALUES " + ", ".join(map(str, BOUNDS)) + ")"
WEIGHTS_SQL = "weights(model, weight) AS (VALUES " + ", ".join(f"('{m}', CAST({w} AS DOUBLE))" for m, w in WEIGHTS) + ")"
READS_SQL = """reads AS (SELECT doc_id AS read_id, translate(md5(CAST(doc_id AS VARCHAR)) || md5(doc_id || '-1'),
  '0123456789abcdef', 'ACGTACGTACGTACGT') AS sequence FROM documents)"""
MOTIFS_SQL = READS_SQL + ", motifs AS (SELECT read_id, substr(sequence, 17, 6) AS motif FROM reads)"
PLACED_SQL = MOTIFS_SQL + """, placed AS (SELECT read_id, CAST(i - 1 AS BIGINT) AS pos, substr(motif, i, 1) AS base
  FROM (SELECT *, unnest(range(1, 7)) AS i FROM motifs))"""
FREQ_SQL = PLACED_SQL + """, freqs AS (SELECT pos, base, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY pos) AS freq
  FROM placed GROUP BY pos, base)"""
ODDS_SQL = PWM_SQL + """, odds AS (SELECT pos, base, ln(prob + 1e-10) - ln(0.25) AS o FROM pwm),
  ends AS (SELECT sum(lo) AS lo, sum(hi) AS hi FROM (SELECT min(o) AS lo, max(o) AS hi FROM odds GROUP BY pos))"""
STATES_SQL = """states AS (SELECT user_id AS read_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
  event_type AS label FROM events)"""
PAIRS_SQL = STATES_SQL + """, pairs AS (SELECT read_id, pos, label AS truth,
  coalesce(lag(label) OVER (PARTITION BY read_id ORDER BY pos), label) AS label FROM states)"""


def runs_sql(source: str, name: str = "runs") -> str:
    return f"""{name} AS (SELECT read_id, label, min(pos) AS "start", max(pos) + 1 AS "end", count(*) AS n FROM (
      SELECT *, sum(new) OVER (PARTITION BY read_id ORDER BY pos) AS run FROM (
        SELECT read_id, pos, label, CASE WHEN lag(label) OVER (PARTITION BY read_id ORDER BY pos) IS NOT DISTINCT FROM label
          AND pos > 0 THEN 0 ELSE 1 END AS new FROM {source})) GROUP BY read_id, run, label)"""


RUNS_SQL = STATES_SQL + ", " + runs_sql("states")
PRED_SQL = """pred AS (SELECT model, read_id, pos, label, w / sum(w) OVER (PARTITION BY model, read_id, pos) AS p FROM (
  SELECT model, doc_id AS read_id, i // 4 AS pos, i % 4 AS label, instr('0123456789abcdef', substr(md5(doc_id || '-' || model), CAST(i AS INTEGER) + 1, 1)) AS w
  FROM (SELECT *, unnest(range(32)) AS i FROM documents, (VALUES ('m0'), ('m1'), ('m2')) m(model))))"""
TRUTH_SQL = """truth AS (SELECT doc_id AS read_id, pos, (instr('0123456789abcdef', substr(md5(doc_id || '-t'), CAST(pos AS INTEGER) + 1, 1)) - 1) % 4 AS label
  FROM (SELECT *, unnest(range(8)) AS pos FROM documents))"""
COMBINED_SQL = PRED_SQL + ", " + WEIGHTS_SQL + """, sums AS (SELECT read_id, pos, label, sum(weight * p) AS x FROM pred JOIN weights USING (model) GROUP BY ALL),
  combined AS (SELECT read_id, pos, label, x / (sum(x) OVER (PARTITION BY read_id, pos) + 1e-10) AS p FROM sums)"""
# sums in another order differ in the last bits; rounded, ties and bins are the same in any order
ROUNDED_SQL = COMBINED_SQL.replace("x / (sum(x) OVER (PARTITION BY read_id, pos) + 1e-10) AS p", "round(x / (sum(x) OVER (PARTITION BY read_id, pos) + 1e-10), 12) AS p")
WINNERS_SQL = """won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY read_id, pos ORDER BY p DESC, label) AS k FROM combined) WHERE k = 1)"""
SHEET_SQL = """sheet AS (SELECT s_suppkey AS k, 'S' || s_suppkey AS sample_name, substr(h, 1, 8) AS cbc, substr(h, 9, 8) AS i5, substr(h, 17, 8) AS i7
  FROM (SELECT *, translate(md5(s_suppkey || '-s'), '0123456789abcdef', 'ACGTACGTACGTACGT') AS h FROM supplier))"""
CODED_SQL = SHEET_SQL + """, coded AS (SELECT c_custkey AS read_id,
    CASE c_custkey % 5 WHEN 2 THEN translate(substr(cbc, 1, 1), 'ACGT', 'CGTA') || substr(cbc, 2) WHEN 4 THEN substr(own, 1, 8) ELSE cbc END AS cbc,
    CASE c_custkey % 5 WHEN 3 THEN translate(substr(i5, 1, 1), 'ACGT', 'CGTA') || substr(i5, 2) WHEN 4 THEN substr(own, 9, 8) ELSE i5 END AS i5,
    CASE c_custkey % 5 WHEN 3 THEN translate(substr(i7, 1, 1), 'ACGT', 'CGTA') || substr(i7, 2) WHEN 4 THEN substr(own, 17, 8) ELSE i7 END AS i7,
    CASE WHEN c_custkey % 11 = 0 THEN 'invalid' WHEN c_custkey % 13 = 0 THEN 'ambiguous' ELSE 'valid' END AS classification
  FROM (SELECT *, translate(md5(c_custkey || '-c'), '0123456789abcdef', 'ACGTACGTACGTACGT') AS own FROM customer)
  JOIN sheet ON k = c_custkey % (SELECT count(*) FROM supplier) + (SELECT min(s_suppkey) FROM supplier))"""
ASSIGNED_SQL = CODED_SQL + """, exact AS (SELECT c.*, s.sample_name AS e FROM coded c LEFT JOIN (
    SELECT * FROM sheet QUALIFY row_number() OVER (PARTITION BY cbc, i5, i7 ORDER BY k DESC) = 1) s USING (cbc, i5, i7)),
  fuzzy AS (SELECT t.cbc, t.i5, t.i7, s.sample_name AS f, levenshtein(t.cbc, s.cbc) + levenshtein(t.i5, s.i5) + levenshtein(t.i7, s.i7) AS d
    FROM (SELECT DISTINCT cbc, i5, i7 FROM exact WHERE e IS NULL) t, sheet s WHERE d <= 2
    QUALIFY row_number() OVER (PARTITION BY t.cbc, t.i5, t.i7 ORDER BY d, s.k) = 1),
  assigned AS (SELECT read_id, cbc, i5, i7, classification, coalesce(e, f, 'undetermined') AS sample_name,
    CASE WHEN e IS NOT NULL THEN 'exact' WHEN f IS NOT NULL THEN 'corrected' ELSE 'none' END AS match,
    CAST(CASE WHEN e IS NOT NULL THEN 0 ELSE d END AS BIGINT) AS distance FROM exact LEFT JOIN fuzzy USING (cbc, i5, i7))"""


def tidy(df: DataFrame) -> DataFrame:
    """Whole numbers as long, doubles rounded to 9 digits (and no negative zero)."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("int", "smallint", "tinyint", "bigint") or kind.startswith("decimal"):
            c = c.cast("long")
        elif kind in ("double", "float"):
            c = F.round(c.cast("double"), 9) + F.lit(0.0)
        out.append(c.alias(name))
    return df.select(*out)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _r(x: str) -> str:
    return f"round({x}, 9) + 0.0"


# --- scalar functions ---------------------------------------------------------------------------------


@query(f"WITH {READS_SQL} SELECT read_id, reverse(translate(sequence, 'ACGT', 'TGCA')) AS rc FROM reads")
def reverse_complement(spark, sf):
    return inputs.reads(spark, sf).select("read_id", seq.reverse_complement(F.lower("sequence")).alias("rc"))


@query(f"WITH {READS_SQL} SELECT read_id, {_r("(length(sequence) - length(translate(sequence, 'GC', ''))) / length(sequence)")} AS gc FROM reads")
def gc_content(spark, sf):
    return inputs.reads(spark, sf).select("read_id", seq.gc_content(F.col("sequence")).alias("gc"))


_TAILED = "sequence || repeat('A', CAST(read_id % 25 AS INTEGER)) || CASE WHEN read_id % 3 = 0 THEN 'N' ELSE '' END || repeat('A', CAST(read_id % 7 AS INTEGER))"


@query(
    f"""WITH {READS_SQL}, tails AS (SELECT read_id, s, length(translate(regexp_extract(right(s, 2000), '[AN]*$'), 'N', '')) AS n
      FROM (SELECT read_id, {_TAILED} AS s FROM reads))
    SELECT read_id, CASE WHEN n >= 10 THEN left(s, length(s) - n) ELSE s END AS trimmed FROM tails"""
)
def polya_trim(spark, sf):
    k = F.col("read_id")
    tail = F.concat(
        "sequence", F.repeat(F.lit("A"), (k % 25).cast("int")), F.when(k % 3 == 0, "N").otherwise(""), F.repeat(F.lit("A"), (k % 7).cast("int"))
    )
    return inputs.reads(spark, sf).select("read_id", seq.trim_polya(tail).alias("trimmed"))


@query(f"WITH {MOTIFS_SQL} SELECT read_id, motif, regexp_matches(motif, '^AC[ACGT][CG][CG][ACG]$') AS matched FROM motifs")
def iupac_match(spark, sf):
    return inputs.motifs(spark, sf).select("read_id", "motif", seq.iupac_match(F.lower("motif"), "ACNSSV").alias("matched"))


@query(
    f"""WITH {MOTIFS_SQL} SELECT read_id, motif, list_aggregate(list_transform(string_split(motif, ''), lambda b: CAST(instr('ACGT', b) AS VARCHAR)),
      'string_agg', '') AS codes, motif AS back FROM motifs"""
)
def base_encode_decode(spark, sf):
    codes = seq.encode(F.col("motif"), "one_based")
    return inputs.motifs(spark, sf).select(
        "read_id", "motif", F.array_join(F.transform(codes, lambda x: x.cast("string")), "").alias("codes"), seq.decode(codes, "one_based").alias("back")
    )


@query(f"WITH {READS_SQL} SELECT read_id, substr(translate(sequence, 'ACGT', '1234') || repeat('0', 100), 1, CAST(40 + read_id % 50 AS INTEGER)) AS padded FROM reads")
def pad_truncate(spark, sf):
    codes = seq.pad(seq.encode(F.col("sequence"), "one_based"), 90)
    return inputs.reads(spark, sf).select("read_id", F.left(F.array_join(F.transform(codes, lambda x: x.cast("string")), ""), (40 + F.col("read_id") % 50).cast("int")).alias("padded"))


@query(
    f"""WITH {MOTIFS_SQL} SELECT read_id, list_aggregate(list_transform(string_split(motif, ''), lambda b: chr(CAST(33 + 10 * instr('ACGT', b) AS INTEGER))), 'string_agg', '') AS quality,
      {_r("list_sum(list_transform(string_split(motif, ''), lambda b: pow(10.0, -instr('ACGT', b))))")} AS errors FROM motifs"""
)
def phred(spark, sf):
    q = F.transform(seq.encode(F.col("motif"), "one_based"), lambda x: x * 10)
    text = seq.phred_encode(q)
    errors = F.aggregate(F.transform(seq.phred_decode(text), lambda x: seq.phred_error(x)), F.lit(0.0), lambda a, x: a + x)
    return inputs.motifs(spark, sf).select("read_id", text.alias("quality"), errors.alias("errors"))


@query(f"WITH {READS_SQL} SELECT read_id, i // 24 AS chunk, substr(sequence, CAST(i AS INTEGER) + 1, 24) AS part FROM (SELECT *, unnest(range(0, length(sequence), 24)) AS i FROM reads)")
def fixed_chunks(spark, sf):
    return inputs.reads(spark, sf).select("read_id", F.posexplode(seq.chunks(F.col("sequence"), 24)).alias("chunk", "part"))


@query(
    """SELECT doc_id AS read_id, CASE WHEN doc_id % 3 > 0 THEN substr(text, CAST(1 + doc_id % 5 AS INTEGER), CAST(20 + doc_id % 7 AS INTEGER) - CAST(doc_id % 5 AS INTEGER)) END AS cds FROM documents"""
)
def cds_extract(spark, sf):
    k = F.col("doc_id")
    header = F.when(k % 3 > 0, F.concat(F.lit("tx gene=1 CDS:"), (1 + k % 5).cast("string"), F.lit("-"), (20 + k % 7).cast("string"))).otherwise(F.lit("tx"))
    return inputs.table(spark, sf, "documents").select(k.alias("read_id"), seq.cds(header, F.col("text")).alias("cds"))


# --- runs ---------------------------------------------------------------------------------------------


@query(f'WITH {RUNS_SQL} SELECT read_id, label, "start", "end", n FROM runs')
def label_runs(spark, sf):
    return runs.long_runs(inputs.states(spark, sf))


@query(f"WITH {RUNS_SQL} SELECT label, count(*) AS runs, {_r('avg(n)')} AS mean, {_r('stddev_pop(n)')} AS std, min(n) AS shortest, max(n) AS longest FROM runs GROUP BY label")
def run_length_stats(spark, sf):
    found = runs.long_runs(inputs.states(spark, sf))
    return found.groupBy("label").agg(
        F.count("*").alias("runs"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"), F.min("n").alias("shortest"), F.max("n").alias("longest")
    )


@query(f"WITH {RUNS_SQL} SELECT label, n, count(*) AS runs FROM runs GROUP BY label, n")
def segment_distribution(spark, sf):
    return runs.long_runs(inputs.states(spark, sf)).groupBy("label", "n").agg(F.count("*").alias("runs"))


GHOST_SQL = STATES_SQL + """, ghosts AS (SELECT read_id, pos, CASE WHEN label <> 'error' THEN label ELSE coalesce(
  last_value(CASE WHEN label <> 'error' THEN label END IGNORE NULLS) OVER (PARTITION BY read_id ORDER BY pos ROWS UNBOUNDED PRECEDING), label) END AS label FROM states)"""


@query(f"WITH {GHOST_SQL} SELECT read_id, pos, label FROM ghosts")
def ghost_fill(spark, sf):
    return runs.ghost_fill(inputs.states(spark, sf), ["error"])


@query(f"""WITH {GHOST_SQL.replace("CASE WHEN label <> 'error' THEN label END", "CASE WHEN label NOT IN ('error', 'signup') THEN label END")}, {runs_sql("ghosts")} SELECT read_id, label, "start", "end" FROM runs WHERE label NOT IN ('error', 'signup')""")
def regions_fold(spark, sf):
    """The array form: one fold a read over its labels in order."""
    rows = inputs.states(spark, sf).groupBy("read_id").agg(F.sort_array(F.collect_list(F.struct("pos", "label")))["label"].alias("labels"))
    found = runs.regions(F.col("labels"), through=["error"], exclude=["signup"])
    return rows.select("read_id", F.explode(found).alias("r")).select("read_id", "r.*")


@query(f"WITH {STATES_SQL}, marked AS (SELECT read_id, pos, lag(label) OVER (PARTITION BY read_id ORDER BY pos) AS before, label FROM states) SELECT * FROM marked WHERE before <> label")
def label_boundaries(spark, sf):
    return runs.boundaries(inputs.states(spark, sf))


_LAYOUT_SQL = "layout(label, s, e) AS (VALUES " + ", ".join(map(str, inputs.LAYOUT)) + ")"


@query(f'WITH {READS_SQL}, {_LAYOUT_SQL} SELECT read_id, label, s AS "start", e AS "end", e - s AS length FROM reads, layout')
def annotation_tsv(spark, sf):
    found = demux.extract(inputs.reads(spark, sf))
    return sinks.annotation_rows(found)


@query(
    f"""WITH {READS_SQL}, {_LAYOUT_SQL} SELECT read_id, concat_ws(chr(9), CAST(read_id AS VARCHAR), 'readloom', label, CAST(s + 1 AS VARCHAR), CAST(e AS VARCHAR),
      '.', '+', '.', 'ID=' || label || '_0') AS value FROM reads, layout"""
)
def annotation_gff(spark, sf):
    return sinks.gff_rows(demux.extract(inputs.reads(spark, sf)), "readloom")


@query(f"WITH {READS_SQL} SELECT read_id, substr(sequence, 45, 8) AS cbc, substr(sequence, 53, 8) AS i5, substr(sequence, 1, 8) AS i7 FROM reads")
def barcode_slice(spark, sf):
    return demux.extract(inputs.reads(spark, sf)).select("read_id", "cbc", "i5", "i7")


@query(f"WITH {READS_SQL} SELECT read_id, left(sequence, 8) || substr(sequence, 17) AS lost, left(sequence, 16) || substr(sequence, 9) AS doubled, left(sequence, 48) AS short FROM reads")
def segment_surgery(spark, sf):
    reads = inputs.reads(spark, sf)
    forms = {"lost": runs.remove_segment(reads, "UMI"), "doubled": runs.duplicate_segment(reads, "UMI"), "short": runs.truncate(reads, 0.75)}
    out = None
    for name, df in forms.items():
        own = df.select("read_id", F.col("sequence").alias(name))
        out = own if out is None else out.join(own, "read_id")
    return out


# --- motifs -------------------------------------------------------------------------------------------


def _scored(spark, sf):
    return inputs.motifs(spark, sf).select("read_id", "motif", motif.score(F.col("motif"), MATRIX).alias("score"))


SCORED_SQL = PLACED_SQL + ", " + ODDS_SQL + """, scored AS (SELECT read_id, greatest(0, least(1, (sum(o) - any_value(lo)) / (any_value(hi) - any_value(lo)))) AS score
  FROM placed JOIN odds USING (pos, base), ends GROUP BY read_id)"""


@query(f"WITH {FREQ_SQL} SELECT pos, base, n, {_r('freq')} AS freq FROM freqs")
def position_frequency(spark, sf):
    return motif.frequencies(inputs.motifs(spark, sf), "motif")


@query(f"WITH {FREQ_SQL} SELECT pos, {_r('sum(-freq * ln(freq + 1e-10)) / ln(4)')} AS entropy FROM freqs GROUP BY pos")
def position_entropy(spark, sf):
    return motif.entropies(motif.frequencies(inputs.motifs(spark, sf), "motif"))


@query(
    f"""WITH {FREQ_SQL}, grid AS (SELECT pos, b.base FROM (SELECT DISTINCT pos FROM freqs), (VALUES ('A'), ('C'), ('G'), ('T')) b(base))
    SELECT pos, base, {_r('(coalesce(n, 0) + 1) / sum(coalesce(n, 0) + 1) OVER (PARTITION BY pos)')} AS prob FROM grid LEFT JOIN freqs USING (pos, base)"""
)
def pwm_estimate(spark, sf):
    return motif.estimate(inputs.motifs(spark, sf), "motif")


@query(f"WITH {SCORED_SQL} SELECT read_id, {_r('score')} AS score FROM scored")
def pwm_score(spark, sf):
    return _scored(spark, sf).select("read_id", "score")


@query(
    f"""WITH {READS_SQL}, {ODDS_SQL}, cells AS (SELECT read_id, CAST(i AS BIGINT) AS i, substr(sequence, CAST(i AS INTEGER) + 1, 6) AS motif, p AS pos, substr(sequence, CAST(i + p AS INTEGER) + 1, 1) AS base
      FROM (SELECT *, unnest(range(6)) AS p FROM (SELECT *, unnest(range(59)) AS i FROM reads))),
    scored AS (SELECT read_id, i, motif, greatest(0, least(1, (sum(o) - any_value(lo)) / (any_value(hi) - any_value(lo)))) AS score FROM cells JOIN odds USING (pos, base), ends GROUP BY ALL),
    best AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY round(score, 12) DESC, i) AS k FROM scored)
    SELECT read_id, {_r('score')} AS score, i AS pos, motif FROM best WHERE k = 1"""
)
def pwm_best_match(spark, sf):
    found = motif.best_match(F.col("sequence"), MATRIX)
    return inputs.reads(spark, sf).select("read_id", found.alias("m")).select("read_id", "m.score", "m.pos", "m.motif")


@query(
    f"""WITH {SCORED_SQL}, t AS (SELECT score, score >= 0.5 AS hit, read_id % 2 = 0 AS truth FROM scored), c AS (SELECT count_if(hit AND truth) AS tp, count_if(hit AND NOT truth) AS fp,
      count_if(NOT hit AND NOT truth) AS tn, count_if(NOT hit AND truth) AS fn, avg(score) FILTER (truth) AS true_mean, stddev_pop(score) FILTER (truth) AS true_std,
      avg(score) FILTER (NOT truth) AS false_mean, stddev_pop(score) FILTER (NOT truth) AS false_std FROM t),
    r AS (SELECT *, tp / (tp + fn) AS tpr, fp / (fp + tn) AS fpr, tn / (tn + fp) AS specificity, tp / (tp + fp) AS "precision" FROM c)
    SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn, {_r('true_mean')} AS true_mean, {_r('true_std')} AS true_std, {_r('false_mean')} AS false_mean,
      {_r('false_std')} AS false_std, {_r('tpr')} AS tpr, {_r('fpr')} AS fpr, {_r('specificity')} AS specificity, {_r('"precision"')} AS "precision",
      {_r('2 * "precision" * tpr / ("precision" + tpr)')} AS f1 FROM r"""
)
def pwm_classifier_metrics(spark, sf):
    return motif.classifier_metrics(_scored(spark, sf).withColumn("truth", F.col("read_id") % 2 == 0), 0.5)


@query(
    f"""WITH {PLACED_SQL}, {PWM_SQL}, h AS (SELECT pos, -sum(prob * ln(prob + 1e-10)) / ln(4) AS w FROM pwm GROUP BY pos)
    SELECT read_id, {_r('sum(ln(prob + 1e-10))')} AS log_likelihood, {_r('avg(prob)')} AS mean, {_r('min(prob)')} AS least, {_r('exp(sum(ln(prob)) / 6)')} AS geometric_mean,
      {_r('sum(prob * w) / 6')} AS weighted FROM placed JOIN pwm USING (pos, base) JOIN h USING (pos) GROUP BY read_id"""
)
def pwm_probabilities(spark, sf):
    return inputs.motifs(spark, sf).select("read_id", motif.probabilities(F.col("motif"), MATRIX).alias("x")).select("read_id", "x.*")


@query(
    f"""WITH {FREQ_SQL}, {PWM_SQL}, b AS (SELECT pos, coalesce(freq, 0) + 1e-10 AS p, prob + 1e-10 AS q FROM pwm LEFT JOIN freqs USING (pos, base)),
    s AS (SELECT pos, p / sum(p) OVER (PARTITION BY pos) AS p, q / sum(q) OVER (PARTITION BY pos) AS q FROM b)
    SELECT CAST(pos AS BIGINT) AS pos, {_r('sum(p * ln(p / q))')} AS kl FROM s GROUP BY pos"""
)
def kl_divergence(spark, sf):
    return motif.kl_divergence(motif.frequencies(inputs.motifs(spark, sf), "motif"), MATRIX)


@query(
    f"""WITH {MOTIFS_SQL} SELECT {_r('avg(hamming(a.motif, b.motif) / 6)')} AS mean_distance
    FROM motifs a JOIN motifs b ON a.read_id < b.read_id"""
)
def pairwise_hamming(spark, sf):
    return motif.mean_hamming(inputs.motifs(spark, sf), "motif")


@query(
    f"""WITH {FREQ_SQL}, e AS (SELECT pos, sum(-freq * ln(freq + 1e-10)) / ln(4) AS h FROM freqs GROUP BY pos)
    SELECT {_r('avg(h)')} AS mean_entropy, {_r('min(h)')} AS min_entropy, {_r('max(h)')} AS max_entropy,
      (SELECT {_r('avg(hamming(a.motif, b.motif) / 6)')} FROM motifs a JOIN motifs b ON a.read_id < b.read_id) AS mean_distance,
      (SELECT {_r('count(DISTINCT motif) / count(*)')} FROM motifs) AS uniqueness FROM e"""
)
def acc_diversity(spark, sf):
    return motif.diversity(inputs.motifs(spark, sf), "motif")


@query(f"WITH {MOTIFS_SQL} SELECT motif, count(*) AS n FROM motifs GROUP BY motif ORDER BY n DESC, motif LIMIT 20")
def top_motifs(spark, sf):
    return motif.top(inputs.motifs(spark, sf), 20, "motif")


@query(
    f"""WITH {SCORED_SQL}, s AS (SELECT round(score, 9) AS score, read_id % 2 = 0 AS grp FROM scored),
    d AS (SELECT score, count_if(NOT grp) AS a, count_if(grp) AS b FROM s GROUP BY score),
    c AS (SELECT abs(sum(a) OVER w / sum(a) OVER () - sum(b) OVER w / sum(b) OVER ()) AS gap, a, b FROM d WINDOW w AS (ORDER BY score ROWS UNBOUNDED PRECEDING))
    SELECT {_r('max(gap)')} AS ks, CAST(sum(a) AS BIGINT) AS n_a, CAST(sum(b) AS BIGINT) AS n_b FROM c"""
)
def ks_two_sample(spark, sf):
    rows = _scored(spark, sf).select(F.round("score", 9).alias("score"), (F.col("read_id") % 2 == 0).alias("grp"))
    return motif.ks_statistic(rows)


# --- demultiplexing -----------------------------------------------------------------------------------


@query(f"WITH {ASSIGNED_SQL} SELECT read_id, e AS sample_name FROM exact")
def barcode_exact(spark, sf):
    return demux.exact(inputs.coded(spark, sf), inputs.sheet(spark, sf)).select("read_id", "sample_name")


@query(f"WITH {ASSIGNED_SQL} SELECT cbc, i5, i7, f AS sample_name, CAST(d AS BIGINT) AS distance FROM fuzzy")
def barcode_fuzzy(spark, sf):
    reads, sheet = inputs.coded(spark, sf), inputs.sheet(spark, sf)
    missed = demux.exact(reads, sheet).filter("sample_name is null").select("cbc", "i5", "i7").distinct()
    return demux.nearest(missed, sheet)


@query(f"WITH {ASSIGNED_SQL} SELECT read_id, sample_name, match, distance FROM assigned")
def barcode_assign(spark, sf):
    return demux.assign(inputs.coded(spark, sf), inputs.sheet(spark, sf)).select("read_id", "sample_name", "match", "distance")


SUMMARY_SQL = f"""WITH {ASSIGNED_SQL} SELECT sample_name, count(*) AS total, count_if(classification = 'valid')::BIGINT AS valid, count_if(classification <> 'valid')::BIGINT AS invalid,
      count_if(classification = 'ambiguous')::BIGINT AS ambiguous, count_if(classification = 'valid' AND match = 'exact')::BIGINT AS exact,
      count_if(classification = 'valid' AND match = 'corrected')::BIGINT AS corrected, count_if(classification = 'valid' AND match = 'none')::BIGINT AS no_match,
      {_r("count_if(classification = 'valid') / count(*)")} AS valid_rate, {_r("count_if(classification = 'valid' AND match <> 'none') / count(*)")} AS assignment_rate
    FROM assigned GROUP BY ROLLUP (sample_name)"""


@query(SUMMARY_SQL)
def demux_summary(spark, sf):
    return demux.statistics(demux.assign(inputs.coded(spark, sf), inputs.sheet(spark, sf)))


@query(f"WITH {ASSIGNED_SQL} SELECT sample_name, count(*) AS n FROM assigned WHERE match <> 'none' GROUP BY sample_name ORDER BY n DESC, sample_name LIMIT 20")
def top_samples(spark, sf):
    found = demux.assign(inputs.coded(spark, sf), inputs.sheet(spark, sf)).filter("match <> 'none'")
    return found.groupBy("sample_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "sample_name").limit(20)


@query(
    f"""WITH {SHEET_SQL}, odd AS (SELECT 'S' || CAST(k % 7 AS VARCHAR) AS sample_name, CASE WHEN k % 10 = 0 THEN cbc || 'A' ELSE cbc END AS cbc,
      CASE WHEN k % 9 = 0 THEN left(i5, 7) ELSE i5 END AS i5, i7 FROM sheet)
    SELECT 'duplicate_name' AS rule, sample_name AS subject, count(*) AS n FROM odd GROUP BY sample_name HAVING count(*) > 1
    UNION ALL SELECT 'cbc_length', sample_name, 1 FROM odd WHERE length(cbc) NOT IN (6, 8, 10, 16) UNION ALL SELECT 'i5_length', sample_name, 1 FROM odd WHERE length(i5) <> 8"""
)
def sheet_checks(spark, sf):
    k = F.col("sheet_ordinal")
    odd = inputs.sheet(spark, sf).withColumns(
        {
            "sample_name": F.concat(F.lit("S"), (k % 7).cast("string")),
            "cbc": F.when(k % 10 == 0, F.concat("cbc", F.lit("A"))).otherwise(F.col("cbc")),
            "i5": F.when(k % 9 == 0, F.left("i5", F.lit(7))).otherwise(F.col("i5")),
        }
    )
    return demux.sheet_issues(odd)


_ARCH = {"click": "UMI", "error": "XX", "purchase": "ACC", "signup": "CBC", "view": "cDNA"}


def _kept_sql(orders: str) -> str:
    """The longest common subsequence of a word and an order of few letters: the longest subset that the word holds in order."""
    from itertools import combinations

    cases = []
    for n in range(len(orders), 0, -1):
        patterns = " OR ".join(f"regexp_matches(s, '{'.*'.join(c)}')" for c in combinations(orders, n))
        cases.append(f"WHEN {patterns} THEN {n}")
    return f"CASE {' '.join(cases)} ELSE 0 END"


@query(
    f"""WITH {RUNS_SQL}, w AS (SELECT read_id, string_agg(CASE label WHEN 'click' THEN 'U' WHEN 'purchase' THEN 'A' WHEN 'signup' THEN 'C' WHEN 'view' THEN 'D' ELSE 'X' END, '' ORDER BY "start") AS s FROM runs GROUP BY read_id),
    k AS (SELECT read_id, s, CASE WHEN {_kept_sql('UDC')} / 3 >= 0.6 THEN 'forward' WHEN {_kept_sql('CDU')} / 3 >= 0.6 THEN 'reverse' ELSE 'unknown' END AS orientation, {_kept_sql('UADC')} / 4 AS order_score FROM w),
    i AS (SELECT *, NOT contains(s, 'C') AS c, NOT contains(s, 'U') AS u, contains(s, 'X') AS x, orientation = 'unknown' AS o FROM k)
    SELECT read_id, CASE WHEN c OR u OR o THEN 'invalid' WHEN x THEN 'ambiguous' ELSE 'valid' END AS classification, orientation,
      concat_ws(';', CASE WHEN c THEN 'missing:CBC' END, CASE WHEN u THEN 'missing:UMI' END, CASE WHEN o THEN 'order' END, CASE WHEN x THEN 'unexpected:XX' END) AS issues, order_score FROM i"""
)
def architecture_validate(spark, sf):
    """Each user's runs, named as segments, held against an expected order (LCS fold)."""
    named = inputs.states(spark, sf).withColumn("label", seq.map_lookup(_ARCH, F.col("label"), "XX"))
    found = runs.long_runs(named).groupBy("read_id").agg(F.sort_array(F.collect_list(F.struct("start", "label")))["label"].alias("found"))
    checked = demux.validate(F.col("found"), expected=("UMI", "ACC", "cDNA", "CBC"), required=("UMI", "CBC"), optional=("ACC",), least=0.6)
    scored = demux.order_score(F.col("found"), ("UMI", "ACC", "cDNA", "CBC"))
    return found.select("read_id", checked.alias("v"), scored.alias("order_score")).select(
        "read_id", "v.classification", "v.orientation", F.array_join("v.issues", ";").alias("issues"), "order_score"
    )


@query(
    f"""WITH {STATES_SQL}, need(label) AS (VALUES ('click'), ('purchase'), ('signup'), ('view'), ('refund')), own AS (SELECT DISTINCT read_id, label FROM states)
    SELECT u.read_id, string_agg(need.label, ',' ORDER BY need.label) AS missing FROM (SELECT DISTINCT read_id FROM states) u, need
    WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.read_id = u.read_id AND own.label = need.label) GROUP BY u.read_id"""
)
def required_missing(spark, sf):
    need = F.array(*map(F.lit, ("click", "purchase", "signup", "view", "refund")))
    own = inputs.states(spark, sf).groupBy("read_id").agg(F.collect_set("label").alias("own"))
    return own.select("read_id", F.array_join(F.array_sort(F.array_except(need, "own")), ",").alias("missing"))


# --- evaluation ---------------------------------------------------------------------------------------


@query(f"WITH {STATES_SQL} SELECT label, count(*) AS n, {_r('count(*) / sum(count(*)) OVER ()')} AS share FROM states GROUP BY label")
def label_distribution(spark, sf):
    return evaluate.distribution(inputs.states(spark, sf), "label")


@query(
    f"""SELECT lang, {_r('avg(length(text))')} AS mean, {_r('stddev_pop(length(text))')} AS std, min(length(text)) AS min, max(length(text)) AS max,
      {_r('median(length(text))')} AS median, count(text) AS count FROM documents GROUP BY lang"""
)
def sequence_length_stats(spark, sf):
    rows = inputs.table(spark, sf, "documents").select("lang", F.length("text").alias("n"))
    return evaluate.length_statistics(rows, "n", ["lang"])


@query("SELECT CAST(length(text) // 100 * 100 AS VARCHAR) || '-' || CAST(length(text) // 100 * 100 + 100 AS VARCHAR) AS bin, count(*) AS n FROM documents GROUP BY bin")
def length_histogram(spark, sf):
    bins = inputs.table(spark, sf, "documents").select(seq.length_bin(F.length("text")).alias("bin"))
    return bins.groupBy("bin").agg(F.count("*").alias("n"))


@query(f"WITH {PAIRS_SQL} SELECT truth, label, count(*) AS n, {_r('count(*) / sum(count(*)) OVER (PARTITION BY truth)')} AS share FROM pairs GROUP BY truth, label")
def confusion_matrix(spark, sf):
    return evaluate.confusion(inputs.pairs(spark, sf), normalize=True)


CLASSES_SQL = PAIRS_SQL + """, classes AS (SELECT class, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (
  SELECT truth AS class, (truth = label)::INT AS tp, 0 AS fp, (truth <> label)::INT AS fn FROM pairs UNION ALL SELECT label, 0, (truth <> label)::INT, 0 FROM pairs) GROUP BY class),
  rated AS (SELECT *, tp + fn AS support, tp / (tp + fp) AS "precision", tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM classes)"""


@query(
    f"""WITH {CLASSES_SQL} SELECT class, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, support::BIGINT AS support, {_r('"precision"')} AS "precision",
      {_r('recall')} AS recall, {_r('f1')} AS f1 FROM rated"""
)
def per_label_scores(spark, sf):
    return evaluate.per_class(inputs.pairs(spark, sf))


@query(
    f"""WITH {CLASSES_SQL} SELECT {_r('sum(tp) / sum(support)')} AS accuracy, {_r('sum("precision" * support) / sum(support)')} AS "precision",
      {_r('sum(recall * support) / sum(support)')} AS recall, {_r('sum(f1 * support) / sum(support)')} AS f1 FROM rated"""
)
def weighted_prf(spark, sf):
    return evaluate.weighted_scores(evaluate.per_class(inputs.pairs(spark, sf)))


_FOUND_SQL = PAIRS_SQL + ", " + runs_sql("(SELECT read_id, pos, truth AS label FROM pairs)", "t") + ", " + runs_sql("(SELECT read_id, pos, label FROM pairs)", "f")


@query(
    f"""WITH {_FOUND_SQL} SELECT read_id, label, "start", "end" FROM t WHERE EXISTS (SELECT 1 FROM f WHERE f.read_id = t.read_id AND f.label = t.label
      AND abs(f."start" - t."start") <= 2 AND abs(f."end" - t."end") <= 2)"""
)
def boundary_accuracy(spark, sf):
    pairs = inputs.pairs(spark, sf)
    truth = runs.long_runs(pairs.select("read_id", "pos", F.col("truth").alias("label")))
    found = runs.long_runs(pairs.select("read_id", "pos", "label"))
    return evaluate.matched_runs(truth, found).select("read_id", "label", "start", "end")


@query(
    f"""WITH {PAIRS_SQL}, m AS (SELECT read_id, pos, truth <> lag(truth) OVER w AS t, label <> lag(label) OVER w AS f FROM pairs WINDOW w AS (PARTITION BY read_id ORDER BY pos))
    SELECT read_id, pos FROM m WHERE f AND EXISTS (SELECT 1 FROM m t WHERE t.t AND t.read_id = m.read_id AND abs(t.pos - m.pos) <= 3)"""
)
def boundary_precision(spark, sf):
    pairs = inputs.pairs(spark, sf)
    found, truth = (runs.boundaries(pairs.select("read_id", "pos", F.col(c).alias("label"))) for c in ("label", "truth"))
    return evaluate.matched_boundaries(found.select("read_id", "pos"), truth.select("read_id", "pos"))


def _bounds(spark):
    return spark.createDataFrame(list(BOUNDS), "label string, min_len int, max_len int")


@query(
    f"""WITH {RUNS_SQL}, {BOUNDS_SQL} SELECT label, CAST(min_len AS BIGINT) AS min_len, CAST(max_len AS BIGINT) AS max_len, count(n) AS runs, {_r('coalesce(avg((n BETWEEN min_len AND max_len)::INT), 0)')} AS satisfied,
      {_r('coalesce(avg((n = min_len)::INT), 0)')} AS exact, count_if(n NOT BETWEEN min_len AND max_len)::BIGINT AS violations, {_r('avg(n)')} AS mean, {_r('stddev_pop(n)')} AS std,
      min(n) AS shortest, max(n) AS longest FROM bounds LEFT JOIN runs USING (label) GROUP BY label, min_len, max_len"""
)
def constraint_satisfaction(spark, sf):
    return evaluate.satisfaction(runs.long_runs(inputs.states(spark, sf)), _bounds(spark))


@query(
    f"""WITH {RUNS_SQL}, {BOUNDS_SQL} SELECT read_id, {_r('2.0 * sum(pow(greatest(0, min_len - n), 2) + pow(greatest(0, n - max_len), 2))')} AS penalty
    FROM runs JOIN bounds USING (label) GROUP BY read_id"""
)
def length_penalty(spark, sf):
    return decode.length_penalty(runs.long_runs(inputs.states(spark, sf)), _bounds(spark), 2.0)


_ACCURACY_SQL = PAIRS_SQL + ", v AS (SELECT CASE WHEN read_id % 4 = 0 THEN 'valid' ELSE 'v' || read_id % 4 END AS variant, truth AS segment, avg((truth = label)::INT) AS accuracy FROM pairs GROUP BY ALL)"


def _accuracies(spark, sf, *by):
    variant = F.when(F.col("read_id") % 4 == 0, "valid").otherwise(F.concat(F.lit("v"), (F.col("read_id") % 4).cast("string")))
    rows = inputs.pairs(spark, sf).select(variant.alias("variant"), F.col("truth").alias("segment"), (F.col("truth") == F.col("label")).cast("double").alias("hit"))
    return rows.groupBy(*by).agg(F.avg("hit").alias("accuracy"))


@query(
    f"""WITH {PAIRS_SQL}, a AS (SELECT CASE WHEN read_id % 4 = 0 THEN 'valid' ELSE 'v' || read_id % 4 END AS variant, avg((truth = label)::INT) AS accuracy FROM pairs GROUP BY ALL),
    b AS (SELECT accuracy AS base FROM a WHERE variant = 'valid') SELECT variant, {_r('accuracy')} AS accuracy, {_r('base - accuracy')} AS degradation, {_r('accuracy / base')} AS ratio FROM a, b"""
)
def degradation(spark, sf):
    return evaluate.degradation(_accuracies(spark, sf, "variant"))


@query(f"WITH {_ACCURACY_SQL}, s AS (SELECT segment, var_samp(accuracy) AS x FROM v GROUP BY segment) SELECT arg_min(segment, x) AS most_robust, arg_max(segment, x) AS least_robust FROM s")
def robustness_extremes(spark, sf):
    return evaluate.robustness_extremes(_accuracies(spark, sf, "variant", "segment"))


@query(
    f"""WITH RECURSIVE o AS (SELECT user_id AS read_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, value FROM events),
    s AS (SELECT read_id, pos, value, value AS smoothed FROM o WHERE pos = 1 UNION ALL
      SELECT o.read_id, o.pos, o.value, 0.9 * s.smoothed + 0.1 * o.value FROM s JOIN o ON o.read_id = s.read_id AND o.pos = s.pos + 1)
    SELECT read_id, pos, {_r('value')} AS value, {_r('smoothed')} AS smoothed FROM s"""
)
def ema_smoothing(spark, sf):
    events = inputs.table(spark, sf, "events").select(F.col("user_id").alias("read_id"), "ts", "event_id", "value")
    return evaluate.smooth(events, "read_id", ["ts", "event_id"], "value", 0.9)


@query(f"WITH {STATES_SQL}, n AS (SELECT read_id, pos, row_number() OVER (PARTITION BY read_id ORDER BY pos) AS k, count(*) OVER (PARTITION BY read_id) AS c FROM states) SELECT read_id, pos FROM n WHERE k IN (1, c, (c + 1) // 2)")
def epoch_selection(spark, sf):
    own = Window.partitionBy("read_id")
    rows = inputs.states(spark, sf).select("read_id", "pos", F.row_number().over(own.orderBy("pos")).alias("k"), F.count("*").over(own).alias("c"))
    return rows.filter((F.col("k") == 1) | (F.col("k") == F.col("c")) | (F.col("k") == F.floor((F.col("c") + 1) / 2))).select("read_id", "pos")


# --- ensembles ----------------------------------------------------------------------------------------


def _weights(spark):
    return spark.createDataFrame(list(WEIGHTS), "model string, weight double")


@query(
    f"""WITH {PRED_SQL}, {TRUTH_SQL}, l AS (SELECT model, sum(ln(p + 1e-10)) AS log_likelihood, count(DISTINCT read_id) AS reads FROM pred JOIN truth USING (read_id, pos, label) GROUP BY model),
    z AS (SELECT model, log_likelihood - CASE model WHEN 'm0' THEN 10 WHEN 'm1' THEN 20 ELSE 40 END / 2 * ln(reads) AS evidence FROM l),
    x AS (SELECT model, evidence / 50.0 + ln(1 / 3) AS x FROM z), w AS (SELECT model, exp(x - max(x) OVER ()) AS w FROM x),
    n AS (SELECT model, CASE WHEN w / sum(w) OVER () < 0.001 THEN 0 ELSE w / sum(w) OVER () END AS w FROM w)
    SELECT model, {_r('w / sum(w) OVER ()')} AS weight FROM n"""
)
def bma_weights(spark, sf):
    found = ensemble.evidences(inputs.predictions(spark, sf), inputs.truth(spark, sf), {"m0": 10, "m1": 20, "m2": 40})
    priors = ensemble.log_priors(found)
    return ensemble.posterior_weights(found.join(priors, "model"), temperature=50.0, least=0.001)


@query(f"WITH {COMBINED_SQL} SELECT read_id, pos, label, {_r('p')} AS p FROM combined")
def prob_average(spark, sf):
    return ensemble.average(inputs.predictions(spark, sf), _weights(spark))


@query(
    f"""WITH {PRED_SQL}, {WEIGHTS_SQL}, s AS (SELECT read_id, pos, label, sum(weight * ln(p + 1e-10)) AS x FROM pred JOIN weights USING (model) GROUP BY ALL)
    SELECT read_id, pos, label, {_r('exp(x) / sum(exp(x)) OVER (PARTITION BY read_id, pos)')} AS p FROM s"""
)
def logit_average(spark, sf):
    return ensemble.logit_average(inputs.predictions(spark, sf), _weights(spark))


@query(
    f"""WITH {PRED_SQL}, {WEIGHTS_SQL}, r AS (SELECT model, read_id, pos, label, rank() OVER (PARTITION BY model, read_id, pos ORDER BY p) + (count(*) OVER (PARTITION BY model, read_id, pos, p) - 1) / 2 AS r FROM pred),
    s AS (SELECT read_id, pos, label, sum(weight * r) AS x FROM r JOIN weights USING (model) GROUP BY ALL) SELECT read_id, pos, label, {_r('x / sum(x) OVER (PARTITION BY read_id, pos)')} AS p FROM s"""
)
def rank_average(spark, sf):
    return ensemble.rank_average(inputs.predictions(spark, sf), _weights(spark))


@query(
    f"""WITH {PRED_SQL}, w AS (SELECT * FROM pred QUALIFY row_number() OVER (PARTITION BY model, read_id, pos ORDER BY p DESC, label) = 1),
    v AS (SELECT read_id, pos, label, count(*) AS votes FROM w GROUP BY ALL) SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY read_id, pos ORDER BY votes DESC, label) = 1"""
)
def majority_vote(spark, sf):
    return ensemble.majority_vote(inputs.predictions(spark, sf))


@query(
    f"""WITH {COMBINED_SQL}, h AS (SELECT read_id, pos, -sum(p * ln(p + 1e-10)) AS entropy FROM combined GROUP BY ALL),
    d AS (SELECT read_id, pos, avg(s) AS disagreement FROM (SELECT read_id, pos, label, stddev_pop(p) AS s FROM pred GROUP BY ALL) GROUP BY ALL),
    a AS (SELECT read_id, pos, avg(x) AS aleatoric FROM (SELECT model, read_id, pos, -sum(p * ln(p + 1e-10)) AS x FROM pred GROUP BY ALL) GROUP BY ALL)
    SELECT read_id, pos, {_r('entropy')} AS entropy, {_r('disagreement')} AS disagreement, {_r('aleatoric')} AS aleatoric, {_r('entropy - aleatoric')} AS epistemic
    FROM h JOIN d USING (read_id, pos) JOIN a USING (read_id, pos)"""
)
def entropy_uncertainty(spark, sf):
    p = inputs.predictions(spark, sf)
    return ensemble.uncertainty(p, ensemble.average(p, _weights(spark)))


_PAIR_SQL = "FROM pred a JOIN pred b ON a.read_id = b.read_id AND a.pos = b.pos AND a.label = b.label AND a.model < b.model GROUP BY a.model, b.model"


@query(
    f"""WITH {PRED_SQL}, w AS (SELECT * FROM pred QUALIFY row_number() OVER (PARTITION BY model, read_id, pos ORDER BY p DESC, label) = 1)
    SELECT {_r('avg(v)')} AS disagreement, (SELECT {_r('avg(v)')} FROM (SELECT sum(a.p * ln((a.p + 1e-10) / (b.p + 1e-10))) AS v {_PAIR_SQL})) AS kl,
      (SELECT {_r('1 - avg(v)')} FROM (SELECT corr(a.p, b.p) AS v {_PAIR_SQL})) AS correlation
    FROM (SELECT avg((a.label <> b.label)::INT) AS v FROM w a JOIN w b ON a.read_id = b.read_id AND a.pos = b.pos AND a.model < b.model GROUP BY a.model, b.model)"""
)
def ensemble_diversity(spark, sf):
    p = inputs.predictions(spark, sf)
    out = None
    for name in ("disagreement", "kl", "correlation"):
        one = ensemble.diversity(p, name).withColumnRenamed("diversity", name)
        out = one if out is None else out.crossJoin(one)  # one row each
    return out


@query(
    f"""WITH {ROUNDED_SQL}, {TRUTH_SQL}, {WINNERS_SQL}, c AS (SELECT won.p, (won.label = truth.label)::INT AS ok FROM won JOIN truth USING (read_id, pos)),
    b AS (SELECT ceil(p * 10) AS bin, count(*) AS n, avg(p) AS conf, avg(ok) AS acc FROM c GROUP BY bin)
    SELECT {_r('sum(abs(conf - acc) * n) / sum(n)')} AS ece, (SELECT {_r('sum(pow(c.p - (c.label = t.label)::INT, 2)) / count(DISTINCT (read_id, pos))')} FROM combined c JOIN truth t USING (read_id, pos)) AS brier FROM b"""
)
def ece_brier(spark, sf):
    combined, truth = ensemble.average(inputs.predictions(spark, sf), _weights(spark)), inputs.truth(spark, sf)
    combined = combined.withColumn("p", F.round("p", 12))
    chosen = ensemble.winners(combined).join(truth.withColumnRenamed("label", "truth"), ["read_id", "pos"])
    ece = ensemble.calibration(chosen.select("p", (F.col("label") == F.col("truth")).alias("correct")))
    return ece.crossJoin(ensemble.brier(combined, truth))  # one row each


@query(
    f"""WITH {PRED_SQL}, {TRUTH_SQL}, t AS (SELECT read_id, pos, sum(CASE model WHEN 'm0' THEN p END) AS a, sum(CASE model WHEN 'm1' THEN p END) AS b, sum(CASE model WHEN 'm2' THEN p END) AS c
      FROM pred JOIN truth USING (read_id, pos, label) GROUP BY ALL), g AS (SELECT i, j, 10 - i - j AS k FROM range(11) x(i), range(11) y(j) WHERE i + j <= 10)
    SELECT concat_ws(',', i, j, k) AS candidate, {_r('sum(ln((a * i + b * j + c * k) / 10 + 1e-10))')} AS log_likelihood FROM t, g GROUP BY i, j, k"""
)
def grid_weights(spark, sf):
    found = ensemble.candidate_likelihoods(inputs.predictions(spark, sf), inputs.truth(spark, sf), ensemble.weight_grid(list(inputs.MODELS)))
    candidate = F.concat_ws(",", *[F.round(F.col("weights")[i] * 10).cast("int").cast("string") for i in range(3)])
    return found.select(candidate.alias("candidate"), "log_likelihood")


@query(
    f"""WITH {COMBINED_SQL}, {TRUTH_SQL}, g AS (SELECT i, 0.1 * pow(100, i / 9) AS t FROM range(10) x(i)),
    s AS (SELECT i, t, read_id, pos, ln(sum(exp(ln(c.p + 1e-10) / t))) - sum(CASE WHEN c.label = truth.label THEN ln(c.p + 1e-10) / t ELSE 0 END) AS nll
      FROM combined c JOIN truth USING (read_id, pos), g GROUP BY ALL) SELECT {_r('t')} AS temperature, {_r('sum(nll)')} AS nll FROM s GROUP BY t"""
)
def temperature_grid(spark, sf):
    combined = ensemble.average(inputs.predictions(spark, sf), _weights(spark))
    return ensemble.temperatures(combined, inputs.truth(spark, sf), steps=10)


@query(
    f"""WITH {PRED_SQL}, w AS (SELECT * FROM pred QUALIFY row_number() OVER (PARTITION BY model, read_id, pos ORDER BY p DESC, label) = 1)
    SELECT a.model, bool_and(a.label = b.label) AS same FROM w a JOIN w b ON b.model = 'm0' AND a.read_id = b.read_id AND a.pos = b.pos GROUP BY a.model"""
)
def model_agreement(spark, sf):
    return ensemble.agreement(inputs.predictions(spark, sf), "m0")


@query()
def stacked(spark, sf):
    p, t = inputs.predictions(spark, sf), inputs.truth(spark, sf)
    return calibrate.stacked(p, calibrate.fit_stack(p, t, list(range(inputs.CLASSES))))


@query()
def bootstrap_intervals(spark, sf):
    return ensemble.intervals(inputs.predictions(spark, sf), _weights(spark))


# --- decoding -----------------------------------------------------------------------------------------


def _matrices(spark, sf):
    """(model, read_id, scores): each model's log-probabilities, places by labels; rounded, ties are ties in any engine."""
    rows = inputs.predictions(spark, sf)
    own = F.struct("label", F.round(F.log("p"), 9).alias("s"))
    places = rows.groupBy("model", "read_id", "pos").agg(F.sort_array(F.collect_list(own))["s"].alias("s"))
    return places.groupBy("model", "read_id").agg(F.sort_array(F.collect_list(F.struct("pos", "s")))["s"].alias("scores"))


def _path(df):
    return df.select("model", "read_id", F.array_join(F.transform("path", lambda x: x.cast("string")), "").alias("path"))


_SCORES_SQL = (
    "e AS (SELECT model, read_id, pos, label, round(ln(p), 9) AS s FROM pred), "
    "moves(a, b, w) AS (SELECT a, b, CASE WHEN a = b THEN -0.1::DOUBLE ELSE -1.5::DOUBLE - 0.1::DOUBLE * b END FROM range(4) x(a), range(4) y(b))"
)
RUN_BOUNDS = {0: (2, 3), 1: (1, 2)}


def _paths_sql(bounds: dict, name: str) -> str:
    """``name``: (model, read_id, path), the best path by states (label, length so far), of equal ones the lower label before."""
    low = "CASE label " + " ".join(f"WHEN {j} THEN {lo}" for j, (lo, _) in bounds.items()) + " ELSE 1 END" if bounds else "1"
    high = "CASE label " + " ".join(f"WHEN {j} THEN {hi}" for j, (_, hi) in bounds.items()) + " ELSE 1 END" if bounds else "1"
    free = f"b NOT IN ({', '.join(map(str, bounds))})" if bounds else "true"
    steps = [f"{name}0 AS (SELECT model, read_id, label, 1 AS n, s AS x, label::VARCHAR AS path FROM e WHERE pos = 0)"]
    for i in range(1, inputs.PLACES):
        steps.append(
            f"""{name}{i} AS (SELECT model, read_id, b AS label, n, m.v + s AS x, m.path || b AS path FROM (
              SELECT model, read_id, b, CASE WHEN label <> b OR {free} THEN 1 ELSE n + 1 END AS n,
                max({{'v': x + w, 'stay': {'label = b' if bounds else 'false'}, 'a': -label, 'n': -n, 'path': path}}) AS m
              FROM (SELECT *, {low} AS low, {high} AS high FROM {name}{i - 1}) JOIN moves ON a = label
              WHERE CASE WHEN label <> b THEN n >= low ELSE {free} OR n < high END GROUP BY ALL)
              JOIN e USING (model, read_id) WHERE e.pos = {i} AND e.label = b)"""
        )
    steps.append(
        f"{name} AS (SELECT model, read_id, max({{'x': x, 'a': -label, 'n': -n, 'path': path}}).path AS path FROM {name}{inputs.PLACES - 1} WHERE n >= {low} GROUP BY ALL)"
    )
    return ", ".join(steps)


@query(f"WITH {PRED_SQL}, {_SCORES_SQL}, {_paths_sql({}, 'free')} FROM free")
def viterbi_unconstrained(spark, sf):
    return _path(decode.decode(_matrices(spark, sf), MOVES))


@query(f"WITH {PRED_SQL}, {_SCORES_SQL}, {_paths_sql(RUN_BOUNDS, 'bound')} FROM bound")
def viterbi_constrained(spark, sf):
    return _path(decode.decode(_matrices(spark, sf), MOVES, RUN_BOUNDS, "constrained"))


@query(
    f"""WITH {PRED_SQL}, {_SCORES_SQL}, {_paths_sql({}, 'free')}, {_paths_sql(RUN_BOUNDS, 'bound')},
    d AS (SELECT model, read_id, hamming(free.path, bound.path) AS n FROM free JOIN bound USING (model, read_id))
    SELECT model, read_id, {_r(f'({inputs.PLACES} - n) / {inputs.PLACES}')} AS agreement, n AS changed FROM d"""
)
def decode_compare(spark, sf):
    free = decode.decode(_matrices(spark, sf), MOVES, out="free")
    both = decode.decode(free, MOVES, RUN_BOUNDS, "constrained", out="bound")
    share, changed = decode.agreement(F.col("free"), F.col("bound"))
    return both.select("model", "read_id", share.alias("agreement"), changed.alias("changed"))


@query(f"WITH {PRED_SQL} SELECT model, read_id, string_agg(CAST(label AS VARCHAR), '' ORDER BY pos) AS path FROM (SELECT * FROM pred QUALIFY row_number() OVER (PARTITION BY model, read_id, pos ORDER BY p DESC, label) = 1) GROUP BY ALL")
def argmax_decode(spark, sf):
    found = _matrices(spark, sf).select("model", "read_id", seq.argmax_decode(F.col("scores")).alias("path"))
    return _path(found)


@query(f"WITH {PRED_SQL}, b AS (SELECT model, read_id, pos, max(p) AS p FROM pred GROUP BY ALL) SELECT model, read_id, round(avg(p), 6) AS confidence FROM b GROUP BY ALL")
def read_confidence(spark, sf):
    sure = seq.confidence(F.col("scores"), F.size("scores"), "logits")
    return _matrices(spark, sf).select("model", "read_id", F.round(sure, 6).alias("confidence"))


# --- generation ---------------------------------------------------------------------------------------

LAYOUT = (
    simulate.Source("p7", "fixed", sequence="CAAGCAGAAGACGGCATACGAGAT"),
    simulate.Source("UMI", length=12),
    simulate.Source("ACC", "pwm", matrix=MATRIX),
    simulate.Source("cDNA", length=60),
    simulate.Source("polyA", "polya", mean=30, std=5, low=10, high=60),
    simulate.Source("CBC", length=16),
    simulate.Source("p5", "fixed", sequence="AATGATACGGCGACCACCGAGATC"),
)


def _simulated(spark, sf, error_rate=0.0):
    n = inputs.table(spark, sf, "orders").count()
    return simulate.generate(spark, n, LAYOUT, seed=42, error_rate=error_rate)


def _shown(reads):
    return reads.select("read_id", "sequence", F.array_join("labels", " ").alias("labels"), "is_invalid", "error_type")


@query()
def sim_reads(spark, sf):
    return _shown(_simulated(spark, sf))


@query()
def sim_errors(spark, sf):
    return _shown(_simulated(spark, sf, 0.05))


@query()
def corrupt_reads(spark, sf):
    return _shown(simulate.corrupt(_simulated(spark, sf), seed=7, fraction=0.5))


@query()
def sim_fragments(spark, sf):
    docs = inputs.reads(spark, sf).select(F.col("read_id").alias("id"), F.col("sequence").alias("seq"))
    rows = spark.range(inputs.table(spark, sf, "orders").count()).withColumnRenamed("id", "read_id")
    return simulate.fragments(rows, docs, 11, 20, 40).select("read_id", "transcript", "fragment")


# --- sets, order, samples -----------------------------------------------------------------------------


@query("SELECT lang, mode(n_chars // 1000 ORDER BY n_chars // 1000) AS thousands FROM documents GROUP BY lang")
def mode_length(spark, sf):
    rows = inputs.table(spark, sf, "documents").select("lang", F.floor(F.col("n_chars") / 1000).alias("k"))
    return rows.groupBy("lang").agg(F.mode("k", True).alias("thousands"))


@query(
    """SELECT doc_id AS read_id, source AS file FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)
    WHERE n <= 5 ORDER BY file, read_id LIMIT 60"""
)
def capped_per_file(spark, sf):
    rows = inputs.table(spark, sf, "documents").select(F.col("doc_id").alias("read_id"), F.col("source").alias("file"))
    return choose.capped(rows, 5, 60)


@query(f"WITH {READS_SQL} SELECT read_id, '1 3 4 5 7 9 10' AS codes FROM reads")
def label_encode(spark, sf):
    codes = seq.encode_labels(F.array_distinct("labels"))
    return inputs.reads(spark, sf).select("read_id", F.array_join(F.transform(codes, lambda x: x.cast("string")), " ").alias("codes"))


@query()
def robustness_variants(spark, sf):
    """How many reads of each corrupted form differ from the read they were made of."""
    reads = inputs.reads(spark, sf)
    forms = evaluate.variants(reads, ["UMI", "CBC"], seed=3).select("read_id", "variant", F.col("sequence").alias("s"))
    both = forms.join(reads.select("read_id", "sequence"), "read_id")
    return both.groupBy("variant").agg(F.count("*").alias("n"), F.count_if(F.col("s") != F.col("sequence")).alias("changed"))


@query("SELECT doc_id, md5(text) AS digest FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def dedupe_first(spark, sf):
    docs = inputs.table(spark, sf, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    return demux.first_of(docs, "digest", "doc_id")


@query(f"WITH {MOTIFS_SQL} SELECT left(motif, 3) AS motif FROM motifs WHERE read_id % 5 < 2 INTERSECT SELECT left(motif, 3) FROM motifs WHERE read_id % 5 >= 2")
def motif_overlap(spark, sf):
    rows = inputs.motifs(spark, sf).select("read_id", F.left("motif", F.lit(3)).alias("motif"))
    return rows.filter("read_id % 5 < 2").select("motif").intersect(rows.filter("read_id % 5 >= 2").select("motif"))


@query("SELECT doc_id AS read_id, CASE WHEN doc_id < CAST(floor((SELECT count(*) FROM documents) * 0.8) AS BIGINT) THEN 'train' ELSE 'val' END AS part FROM documents")
def train_val_split(spark, sf):
    docs = inputs.table(spark, sf, "documents").select(F.col("doc_id").alias("read_id"))
    train, val = choose.split(docs, docs.count(), 0.8)
    return train.withColumn("part", F.lit("train")).union(val.withColumn("part", F.lit("val")))


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id || '-7'), doc_id LIMIT 50")
def hash_sample(spark, sf):
    return choose.hash_sample(inputs.table(spark, sf, "documents").select("doc_id"), 50, 7, "doc_id")


@query("SELECT CAST(row_number() OVER (ORDER BY event_type) - 1 AS BIGINT) AS label_id, event_type AS label FROM (SELECT DISTINCT event_type FROM events)")
def label_vocabulary(spark, sf):
    labels = inputs.table(spark, sf, "events").select(F.col("event_type").alias("label")).distinct()
    return labels.select((F.row_number().over(Window.orderBy("label")) - 1).alias("label_id"), "label")  # a row a label


# --- chains, distances and matrices -------------------------------------------------------------------


def _chain_sql(combine: str) -> str:
    """The first model's places as a chain of tables v0 to v7 of (read_id, label, x), combined over the label before."""
    steps = [_SCORES_SQL, "v0 AS (SELECT model, read_id, label, s AS x FROM e WHERE pos = 0)"]
    steps += [
        f"v{i} AS (SELECT e.model, e.read_id, e.label, {combine.format(f'v{i - 1}.x + w')} + max(e.s) AS x FROM e JOIN v{i - 1} USING (model, read_id) "
        f"JOIN moves ON a = v{i - 1}.label AND b = e.label WHERE e.pos = {i} GROUP BY e.model, e.read_id, e.label)"
        for i in range(1, inputs.PLACES)
    ]
    return ", ".join(steps)


@query(f"WITH {PRED_SQL}, {_chain_sql('max({})')} SELECT model, read_id, {_r('max(x)')} AS score FROM v{inputs.PLACES - 1} GROUP BY ALL")
def viterbi_score(spark, sf):
    """The score of each read's best path, which no other path exceeds."""
    found = decode.decode(_matrices(spark, sf), MOVES)
    return found.select("model", "read_id", decode.path_score(F.col("scores"), F.col("path"), MOVES).alias("score"))


@query(
    f"""WITH {PRED_SQL}, {TRUTH_SQL}, {_chain_sql('ln(sum(exp({})))')}, z AS (SELECT model, read_id, ln(sum(exp(x))) AS z FROM v{inputs.PLACES - 1} GROUP BY ALL),
    t AS (SELECT model, read_id, pos, truth.label, lag(truth.label) OVER (PARTITION BY model, read_id ORDER BY pos) AS a, e.s FROM truth JOIN e USING (read_id, pos, label)),
    own AS (SELECT model, read_id, sum(s + coalesce(w, 0)) AS x FROM t LEFT JOIN moves ON t.a = moves.a AND t.label = moves.b GROUP BY ALL)
    SELECT model, read_id, {_r('z - x')} AS nll FROM z JOIN own USING (model, read_id)"""
)
def chain_nll(spark, sf):
    """Negative log-likelihood of the true labels under a linear chain."""
    true = inputs.truth(spark, sf).groupBy("read_id").agg(F.sort_array(F.collect_list(F.struct("pos", "label")))["label"].alias("path"))
    both = _matrices(spark, sf).join(true, "read_id")
    own = decode.path_score(F.col("scores"), F.col("path"), MOVES)
    return both.select("model", "read_id", (decode.log_partition(F.col("scores"), MOVES) - own).alias("nll"))


_ANCHOR = "ACCGGG"
_PARTS = sorted({"".join(c for i, c in enumerate(_ANCHOR) if mask >> i & 1) for mask in range(1 << len(_ANCHOR))})
_PARTS_SQL = "parts(part, re) AS (VALUES " + ", ".join(f"('{p}', '{'.*'.join(p)}')" for p in _PARTS) + ")"


@query(
    f"""WITH {MOTIFS_SQL}, {_PARTS_SQL} SELECT read_id, levenshtein(motif, '{_ANCHOR}') AS edits, hamming(motif, '{_ANCHOR}') AS differing,
    max(length(part)) AS common FROM motifs JOIN parts ON regexp_matches(motif, re) GROUP BY read_id, motif"""
)
def motif_distances(spark, sf):
    m, anchor = F.col("motif"), F.lit(_ANCHOR)
    common = seq.lcs_length(seq.letters(m), seq.letters(anchor))
    return inputs.motifs(spark, sf).select(
        "read_id", F.levenshtein(m, anchor).alias("edits"), seq.hamming(m, anchor).alias("differing"), common.alias("common")
    )


ESTIMATED_SQL = FREQ_SQL + """, grid AS (SELECT pos, b.base FROM (SELECT DISTINCT pos FROM freqs), (VALUES ('A'), ('C'), ('G'), ('T')) b(base)),
  cells AS (SELECT pos, base, coalesce(n, 0) + 1 AS x FROM grid LEFT JOIN freqs USING (pos, base)),
  pwm AS (SELECT pos, base, x / sum(x) OVER (PARTITION BY pos) AS prob FROM cells)"""


def _estimated(spark, sf) -> list[dict[str, float]]:
    """The matrix of the table's motifs: a row a position."""
    return motif.matrix(motif.estimate(inputs.motifs(spark, sf), "motif"))


@query(f"WITH {ESTIMATED_SQL} SELECT pos, base, {_r('ln(prob + 1e-10) - ln(0.25)')} AS prob FROM pwm")
def log_odds_table(spark, sf):
    return motif.table(spark, motif.log_odds(_estimated(spark, sf)))


@query(
    f"""WITH {ESTIMATED_SQL}, c AS (SELECT pos, string_agg(base, '' ORDER BY base) FILTER (prob >= 0.25) AS code FROM pwm GROUP BY pos)
    SELECT pos, base, {_r("(CASE WHEN contains(code, base) THEN 1.0::DOUBLE / length(code) ELSE 0 END + 0.1::DOUBLE) / 1.4::DOUBLE")} AS prob
    FROM c, (VALUES ('A'), ('C'), ('G'), ('T')) b(base)"""
)
def pattern_matrix(spark, sf):
    """The matrix of the pattern that the table's motifs have: at each place the code of all bases that are as frequent as chance."""
    codes = {bases: code for code, bases in IUPAC.items()}
    pattern = "".join(codes["".join(b for b in "ACGT" if p[b] >= 0.25)] for p in _estimated(spark, sf))
    return motif.table(spark, motif.from_pattern(pattern, 0.1))


@query(
    f"""WITH {ESTIMATED_SQL}, x AS (SELECT pos, base, exp(ln(prob + 1e-10) / 0.5) AS x FROM pwm), n AS (SELECT pos, base, x / sum(x) OVER (PARTITION BY pos) AS p FROM x),
    h AS (SELECT *, -sum(p * ln(p + 1e-10)) OVER (PARTITION BY pos) / ln(4) AS h FROM n),
    m AS (SELECT *, CASE WHEN h < 0.9995 THEN least(0.5, (0.9995 - h) / greatest(1e-10, 1 - h)) ELSE 0 END AS mix FROM h)
    SELECT pos, base, {_r('(1 - mix) * p + mix / 4')} AS prob FROM m"""
)
def tempered_matrix(spark, sf):
    return motif.table(spark, motif.tempered(_estimated(spark, sf), 0.5, 0.9995))


@query()
def motif_sampling(spark, sf):
    """A motif drawn from the matrix for each document, with a quality for each base."""
    rows = inputs.table(spark, sf, "documents").select("doc_id", motif.sample(MATRIX, 5, F.col("doc_id")).alias("motif"))
    quality = motif.sample_quality(F.col("motif"), MATRIX)
    return rows.select("doc_id", "motif", F.array_join(F.transform(quality, lambda q: q.cast("string")), " ").alias("quality"))


# --- more of ensembles and evaluation -----------------------------------------------------------------


@query(
    f"""WITH {PRED_SQL}, {WEIGHTS_SQL}, c AS (SELECT *, max(p) OVER (PARTITION BY model, read_id, pos) AS top FROM pred JOIN weights USING (model)),
    s AS (SELECT read_id, pos, label, sum(weight * top * p) AS x FROM c GROUP BY ALL) SELECT read_id, pos, label, {_r('x / (sum(x) OVER (PARTITION BY read_id, pos) + 1e-10)')} AS p FROM s"""
)
def confidence_average(spark, sf):
    return ensemble.average(inputs.predictions(spark, sf), _weights(spark), by_confidence=True)


@query(
    f"""WITH {COMBINED_SQL}, t AS (SELECT read_id, pos, label, exp(ln(p + 1e-10) / 1.7) AS x FROM combined)
    SELECT read_id, pos, label, {_r('x / sum(x) OVER (PARTITION BY read_id, pos)')} AS p FROM t"""
)
def temperature_calibrated(spark, sf):
    return ensemble.with_temperature(ensemble.average(inputs.predictions(spark, sf), _weights(spark)), 1.7)


def _hits(spark, sf):
    """(read_id, pos, p, hit): the combined winner's probability, and whether it is right."""
    won = ensemble.winners(ensemble.average(inputs.predictions(spark, sf), _weights(spark)))
    both = won.join(inputs.truth(spark, sf).withColumnRenamed("label", "truth"), ["read_id", "pos"])
    return both.select("read_id", "pos", "p", (F.col("label") == F.col("truth")).alias("hit"))


@query()
def platt_calibrated(spark, sf):
    rows = _hits(spark, sf)
    rows = rows.withColumn("label", F.lit(0))
    return calibrate.with_platt(rows, calibrate.fit_platt(rows)).select("read_id", "pos", "p")


@query()
def isotonic_calibrated(spark, sf):
    rows = scratch.kept(_hits(spark, sf).withColumn("label", F.lit(0)), "hits")
    return calibrate.with_isotonic(rows, calibrate.isotonic_blocks(rows)).select("read_id", "pos", "p")


_MODEL_SQL = f"""{PRED_SQL}, {TRUTH_SQL}, w AS (SELECT * FROM pred QUALIFY row_number() OVER (PARTITION BY model, read_id, pos ORDER BY p DESC, label) = 1),
  scores AS (SELECT model, avg((w.label = truth.label)::INT) AS accuracy, avg(p) AS confidence FROM w JOIN truth USING (read_id, pos) GROUP BY model)"""


def _model_scores(spark, sf):
    won = ensemble.winners(inputs.predictions(spark, sf), ("model", "read_id", "pos"))
    both = won.join(inputs.truth(spark, sf).withColumnRenamed("label", "truth"), ["read_id", "pos"])
    return both.groupBy("model").agg(F.avg((F.col("label") == F.col("truth")).cast("int")).alias("accuracy"), F.avg("p").alias("confidence"))


_KINDS_SQL = _MODEL_SQL + """, lost AS (SELECT model, avg(-ln(p + 1e-10)) AS loss, count_if(p > 0.5) AS k FROM pred JOIN truth USING (read_id, pos, label) GROUP BY model),
  m AS (SELECT model, CASE model WHEN 'm1' THEN 'b' ELSE 'a' END AS kind, accuracy, loss, k + 1 AS k FROM scores JOIN lost USING (model))"""


def _kinds(spark, sf):
    """(model, kind, accuracy, loss, parameters) of each model: its mean loss, and one more than the true labels it is sure of."""
    right = inputs.predictions(spark, sf).join(inputs.truth(spark, sf), ["read_id", "pos", "label"])
    lost = right.groupBy("model").agg(F.avg(-F.log(F.col("p") + 1e-10)).alias("loss"), (F.count_if(F.col("p") > 0.5) + 1).alias("parameters"))
    kind = F.when(F.col("model") == "m1", "b").otherwise("a").alias("kind")
    return _model_scores(spark, sf).join(lost, "model").select("model", kind, "accuracy", "loss", "parameters")


@query(
    f"""WITH {_KINDS_SQL}, v AS (SELECT model, greatest(pow(accuracy, 2.0) * CASE kind WHEN 'a' THEN 1.1 ELSE 1 END, 0.05) AS w FROM m)
    SELECT model, {_r('w / sum(w) OVER ()')} AS weight FROM v"""
)
def performance_weights(spark, sf):
    return ensemble.performance_weights(_kinds(spark, sf), "accuracy", 2.0, {"a": 0.1}, 0.05)


@query(f"WITH {_KINDS_SQL}, v AS (SELECT model, greatest(pow(max(loss) OVER () - loss, 2), 1e-6) AS w FROM m) SELECT model, {_r('w / sum(w) OVER ()')} AS weight FROM v")
def loss_weights(spark, sf):
    return ensemble.performance_weights(_kinds(spark, sf), "loss", 2.0, least=1e-6)


@query(
    f"""WITH {_KINDS_SQL} SELECT model, {_r('ln(1 / 3)')} AS uniform, {_r('ln(accuracy / sum(accuracy) OVER ())')} AS informative,
    {_r('ln((1.0::DOUBLE / k) / sum(1.0::DOUBLE / k) OVER ())')} AS adaptive FROM m"""
)
def model_priors(spark, sf):
    models = _kinds(spark, sf)
    given = {r["model"]: r["accuracy"] for r in models.collect()}  # a row a model
    out = models.select("model")
    for kind in ("uniform", "informative", "adaptive"):
        out = out.join(ensemble.log_priors(models, kind, given).withColumnRenamed("log_prior", kind), "model")
    return out


@query(f"WITH {_MODEL_SQL} SELECT model, {_r('accuracy')} AS accuracy, {_r('confidence')} AS confidence, row_number() OVER (ORDER BY accuracy DESC, model) AS rank FROM scores")
def model_ranking(spark, sf):
    return demux.ranked(_model_scores(spark, sf), [], [F.desc("accuracy"), F.col("model")])  # a row a model


@query(
    f"""WITH {_MODEL_SQL} SELECT 'accuracy' AS criterion, arg_max(model, accuracy) AS model, {_r('max(accuracy)')} AS value FROM scores
    UNION ALL SELECT 'confidence', arg_min(model, confidence), {_r('min(confidence)')} FROM scores"""
)
def best_models(spark, sf):
    return evaluate.best_models(_model_scores(spark, sf), {"accuracy": True, "confidence": False})


@query(
    f"""SELECT doc_id, {_r('2.5 - 2 * (doc_id % 10) / 10')} AS temperature, {_r('0.01::DOUBLE * least((doc_id % 20) / 10, 1)')} AS weight,
    concat(n_chars // 100 * 100, '-', n_chars // 100 * 100 + 100) AS bin FROM documents"""
)
def training_scalars(spark, sf):
    k = F.col("doc_id")
    return inputs.table(spark, sf, "documents").select(
        "doc_id",
        seq.temperature_from_threshold(k % 10 / 10).alias("temperature"),
        seq.ramped_weight(0.01, k % 20, 10).alias("weight"),
        seq.length_bin(F.col("n_chars")).alias("bin"),
    )


@query(
    f"""WITH c AS (SELECT lang, n_chars, count(*) AS n FROM documents GROUP BY ALL)
    SELECT lang, n_chars, {_r('sum(n) OVER (PARTITION BY lang ORDER BY n_chars) / sum(n) OVER (PARTITION BY lang)')} AS share FROM c"""
)
def length_distribution(spark, sf):
    """Cumulative share of each length; lengths are counted before they are put in order."""
    counts = inputs.table(spark, sf, "documents").groupBy("lang", "n_chars").agg(F.count("*").alias("n"))
    own = Window.partitionBy("lang")
    return counts.select("lang", "n_chars", (F.sum("n").over(own.orderBy("n_chars")) / F.sum("n").over(own)).alias("share"))


# --- sources, sinks and the sheet ---------------------------------------------------------------------

_LABELS = " ".join(name for name, start, end in inputs.LAYOUT for _ in range(end - start))


@query(f"WITH {READS_SQL} SELECT sequence || chr(9) || '{_LABELS}' AS value FROM reads")
def labelled_text(spark, sf):
    return sinks.labelled_rows(inputs.reads(spark, sf))


@query(f"""WITH {SHEET_SQL} SELECT '{{"sample_name":"' || sample_name || '","cbc":"' || cbc || '"}}' AS value FROM sheet""")
def sample_json(spark, sf):
    return sinks.json_rows(inputs.sheet(spark, sf).select("sample_name", "cbc"))


@query(
    f"""WITH {READS_SQL}, h AS (SELECT read_id % 10 = 0 AS bad, 20 + read_id % 40 AS n FROM reads ORDER BY read_id LIMIT 100)
    SELECT count(*) AS reads, count_if(bad) AS invalid, {_r('avg(n)')} AS mean_length, min(n) AS shortest, max(n) AS longest FROM h"""
)
def read_preview(spark, sf):
    k = F.col("read_id")
    cut = inputs.reads(spark, sf).select("read_id", F.substring("sequence", F.lit(1), (20 + k % 40).cast("int")).alias("sequence"), (k % 10 == 0).alias("is_invalid"))
    return sinks.preview(cut, 100)


def _entries(spark, sf):
    """Index entries of the documents' reads, some wrong: (name, length, line_bases, line_width)."""
    k = F.col("doc_id")
    return inputs.table(spark, sf, "documents").select(
        F.concat(F.lit("r"), (k % 190).cast("string")).alias("name"),
        F.when(k % 7 == 0, 0).otherwise(64).cast("long").alias("length"),
        F.lit(60).alias("line_bases"),
        F.when(k % 9 == 0, 60).otherwise(61).alias("line_width"),
    )


def _records(spark, sf):
    """(name, sequence) of all reads, some of them under a name that no index has."""
    first = F.when(F.col("read_id") % 11 == 0, "other").otherwise("r")
    return inputs.reads(spark, sf).select(F.concat(first, F.col("read_id").cast("string")).alias("name"), "sequence")


_ENTRIES_SQL = """entries AS (SELECT 'r' || doc_id % 190 AS name, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE 64 END AS length, 60 AS line_bases,
  CASE WHEN doc_id % 9 = 0 THEN 60 ELSE 61 END AS line_width FROM documents)"""


@query(
    f"""WITH {_ENTRIES_SQL} SELECT 'duplicate' AS rule, name, count(*) AS n FROM entries GROUP BY name HAVING count(*) > 1
    UNION ALL SELECT 'length', name, 1 FROM entries WHERE length <= 0 UNION ALL SELECT 'line_width', name, 1 FROM entries WHERE line_width <= line_bases"""
)
def index_issues(spark, sf):
    return fasta.index_issues(_entries(spark, sf))


@query(
    f"""WITH {_ENTRIES_SQL}, {READS_SQL}, own AS (SELECT CASE WHEN read_id % 11 = 0 THEN 'other' ELSE 'r' END || read_id AS name, length(sequence) AS found FROM reads)
    SELECT name, length, found FROM entries LEFT JOIN own USING (name) WHERE found IS NULL OR found <> length"""
)
def index_verified(spark, sf):
    records = _records(spark, sf)
    return fasta.verify_index(_entries(spark, sf), records)


@query(
    f"""WITH {READS_SQL}, wanted AS (SELECT o_orderkey, 'r' || o_custkey % 300 AS name FROM orders)
    SELECT o_orderkey, name, sequence FROM wanted LEFT JOIN (SELECT CASE WHEN read_id % 11 = 0 THEN 'other' ELSE 'r' END || read_id AS name, sequence FROM reads) USING (name)"""
)
def sequences_by_name(spark, sf):
    """A sequence for every name that is asked for, null where there is none."""
    records = _records(spark, sf)
    orders = inputs.table(spark, sf, "orders")
    return fasta.fetch(orders.select("o_orderkey", F.concat(F.lit("r"), (F.col("o_custkey") % 300).cast("string")).alias("name")), records)


@query(
    f"""WITH p AS (SELECT s_suppkey AS pos, base, CASE WHEN s_suppkey % 3 = 0 AND base = 'A' THEN 0.3::DOUBLE ELSE 0.25::DOUBLE END AS prob FROM supplier, (VALUES ('A'), ('C'), ('G'), ('T')) b(base))
    SELECT pos, {_r('sum(prob)')} AS total FROM p GROUP BY pos HAVING abs(sum(prob) - 1) > 1e-5"""
)
def matrix_issues(spark, sf):
    cells = inputs.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("pos"), F.explode(F.array(*map(F.lit, "ACGT"))).alias("base"))
    prob = F.when((F.col("pos") % 3 == 0) & (F.col("base") == "A"), 0.3).otherwise(0.25)
    return tables.pwm_issues(cells.withColumn("prob", prob))


@query(f"WITH {CODED_SQL} SELECT classification, count(*) AS n FROM coded WHERE cbc IN (SELECT cbc FROM sheet) GROUP BY classification")
def whitelist_members(spark, sf):
    known = inputs.sheet(spark, sf).select("cbc")
    return inputs.coded(spark, sf).join(known, "cbc", "left_semi").groupBy("classification").agg(F.count("*").alias("n"))


@query()
def whitelist_sampling(spark, sf):
    """A barcode of the sheet for each customer, drawn by hash."""
    rows = inputs.table(spark, sf, "customer").select(F.col("c_custkey").alias("read_id"))
    first = F.min("sheet_ordinal").over(Window.partitionBy())  # a row a sample
    known = inputs.sheet(spark, sf).select((F.col("sheet_ordinal") - first).alias("ordinal"), F.col("cbc").alias("seq"))
    return simulate.whitelisted(rows, known, 13, "cbc")


@query(
    """SELECT doc_id AS read_id, CASE WHEN (doc_id % 100) / 100 < 0.85 THEN 'invalid' ELSE 'valid' END AS classification,
    CASE WHEN (doc_id % 100) / 100 < 0.85 THEN 'short;low_confidence' ELSE 'short' END AS issues FROM documents"""
)
def confidence_threshold(spark, sf):
    given = F.struct(F.lit("valid").alias("classification"), F.lit("forward").alias("orientation"), F.array(F.lit("short")).alias("issues"))
    k = F.col("doc_id")
    rows = inputs.table(spark, sf, "documents").select(k.alias("read_id"), demux.threshold(given, k % 100 / 100).alias("v"))
    return rows.select("read_id", "v.classification", F.array_join("v.issues", ";").alias("issues"))


@query(
    """WITH i AS (SELECT event_type AS issue FROM events UNION ALL SELECT 'user ' || user_id % 5 FROM events)
    SELECT issue, count(*) AS n FROM i GROUP BY issue ORDER BY n DESC, issue LIMIT 4"""
)
def top_issues(spark, sf):
    flagged = F.array(F.col("event_type"), F.concat(F.lit("user "), (F.col("user_id") % 5).cast("string")))
    return demux.issues(inputs.table(spark, sf, "events").select(flagged.alias("issues")), 4)


@query(
    """WITH w AS (SELECT event_type AS sample_name, time_bucket(INTERVAL 5 MINUTE, ts::TIMESTAMP) AS w, count(*) AS reads FROM events GROUP BY ALL)
    SELECT sample_name, reads, count(*) AS windows FROM w GROUP BY ALL"""
)
def window_rates(spark, sf):
    """How many five-minute windows had so many reads; the same function serves arriving reads, with a watermark."""
    timed = inputs.table(spark, sf, "events").select("ts", F.col("event_type").alias("sample_name"))
    return demux_stream.late_rates(timed).groupBy("sample_name", "reads").agg(F.count("*").alias("windows"))


@query(f"WITH r AS (SELECT doc_id AS read_id, doc_id / (SELECT count(*) FROM documents) AS x FROM documents) SELECT read_id, {_r('0.5 + 1.5 * x')} AS rising, {_r('2.0 - 1.5 * x')} AS falling FROM r")
def diversity_schedule(spark, sf):
    docs = inputs.table(spark, sf, "documents").select(F.col("doc_id").alias("read_id"))
    n = docs.count()
    return docs.select("read_id", simulate.schedule(n, "increasing").alias("rising"), simulate.schedule(n, "decreasing").alias("falling"))


def _label_arrays(spark, sf):
    """(read_id, labels): each user's event types in order."""
    return inputs.states(spark, sf).groupBy("read_id").agg(F.sort_array(F.collect_list(F.struct("pos", "label")))["label"].alias("labels"))


@query(f"""WITH {RUNS_SQL} SELECT read_id, coalesce(string_agg(n, ' ' ORDER BY "start") FILTER (label = 'view'), '') AS lengths FROM runs GROUP BY read_id""")
def lengths_of_label(spark, sf):
    own = runs.lengths_of(runs.run_lengths(F.col("labels")), "view")
    return _label_arrays(spark, sf).select("read_id", F.array_join(F.transform(own, lambda n: n.cast("string")), " ").alias("lengths"))


@query(f"""WITH {RUNS_SQL} SELECT read_id, label, "start", "end" FROM runs QUALIFY row_number() OVER (PARTITION BY read_id, label ORDER BY "start" DESC) = 1""")
def last_run_of_label(spark, sf):
    found = _label_arrays(spark, sf).select("read_id", F.explode(runs.last_boundaries(runs.run_lengths(F.col("labels")))).alias("label", "at"))
    return found.select("read_id", "label", "at.start", "at.end")


# --- files, written and read again -----------------------------------------------------------------------


def _folder(spark, name: str) -> str:
    return scratch.place(spark, name)


def _with_quality(spark, sf):
    """Reads named by their number, with a quality line that may start with @ or +."""
    quality = F.translate("sequence", "ACGT", "+@IF")
    return inputs.reads(spark, sf).select(F.col("read_id").cast("string").alias("read_id"), "sequence", quality.alias("quality"))


@query(f"WITH {READS_SQL} SELECT read_id::VARCHAR AS read_id, sequence, translate(sequence, 'ACGT', '+@IF') AS quality FROM reads")
def fastq_roundtrip(spark, sf):
    """Reads written as FASTQ by all tasks and read again, in parts, from the shared store."""
    path = _folder(spark, "fastq")
    fastq.record_rows(_with_quality(spark, sf)).write.text(path)
    return fastq.read_split(spark, path).drop("file")


@query(f"WITH {READS_SQL} SELECT read_id::VARCHAR AS read_id, 'S' || read_id % 7 AS sample, sequence FROM reads")
def fastq_by_sample(spark, sf):
    """Reads in a folder for each sample, compressed; the sample is read from the folder's name."""
    path = _folder(spark, "samples")
    named = _with_quality(spark, sf).withColumn("sample_name", F.concat(F.lit("S"), (F.col("read_id").cast("long") % 7).cast("string")))
    fastq.write_by_sample(named, path)
    found = fastq.read_split(spark, f"{path}/*")
    return found.select("read_id", F.regexp_extract("file", "sample=([^/]*)/", 1).alias("sample"), "sequence")


@query(f"WITH {READS_SQL} SELECT 'r' || read_id AS name, 'r' || read_id || ' of a document' AS header, sequence FROM reads")
def fasta_roundtrip(spark, sf):
    path = _folder(spark, "fasta")
    fasta.write(inputs.reads(spark, sf).select(F.concat(F.lit("r"), F.col("read_id").cast("string")).alias("name"), F.lit("of a document").alias("note"), "sequence"), path, width=23)
    return fasta.read_split(spark, path).select("name", "header", "sequence")


@query(
    f"""WITH {READS_SQL}, n AS (SELECT 'r' || read_id AS name, regexp_replace(CASE WHEN read_id % 5 = 0 THEN lower(sequence) || 'xx' ELSE left(sequence, CAST(read_id % 60 AS INTEGER)) END, '', '') AS s FROM reads)
    SELECT name, regexp_replace(upper(s), '[^ACGT]', 'N', 'g') AS sequence FROM n WHERE length(s) BETWEEN 20 AND 64"""
)
def transcript_filter(spark, sf):
    k = F.col("read_id")
    cut = F.when(k % 5 == 0, F.concat(F.lower("sequence"), F.lit("xx"))).otherwise(F.left("sequence", (k % 60).cast("int")))
    records = inputs.reads(spark, sf).select(F.concat(F.lit("r"), k.cast("string")).alias("name"), cut.alias("sequence"))
    return fasta.transcripts(records, 20, 64)


@query(f"""WITH {READS_SQL} SELECT 'r' || read_id AS name, length(sequence) AS length, read_id * 65 AS "offset", 64 AS line_bases, 65 AS line_width FROM reads""")
def index_roundtrip(spark, sf):
    """An index written beside a FASTA file, found by the file's name, and read again."""
    path = _folder(spark, "index")
    rows = inputs.reads(spark, sf).select(
        F.concat(F.lit("r"), F.col("read_id").cast("string")).alias("name"), F.length("sequence").cast("long").alias("length"),
        (F.col("read_id") * 65).alias("offset"), F.lit(64).alias("line_bases"), F.lit(65).alias("line_width"),
    )
    fasta.write_index(rows, fasta.index_path(f"{path}.fa.gz"))
    return fasta.read_index(spark, fasta.index_path(f"{path}.fa.gz")).filter("corrupt is null").drop("corrupt")


@query(f"WITH {ESTIMATED_SQL} SELECT pos, base, {_r('prob')} AS prob FROM pwm")
def matrix_roundtrip(spark, sf):
    path = _folder(spark, "matrix")
    sinks.write_pwm(motif.estimate(inputs.motifs(spark, sf), "motif"), path)
    return tables.read_pwm(spark, path)


@query(
    """WITH p AS (SELECT 'm' || s_suppkey % 3 AS model_name, s_suppkey::VARCHAR AS sequence, s_suppkey % 5 + 1 AS f FROM supplier)
    SELECT model_name, sequence, round(f / sum(f) OVER (PARTITION BY model_name), 9) AS frequency FROM p"""
)
def priors_scan(spark, sf):
    path = _folder(spark, "priors")
    k = F.col("s_suppkey")
    line = F.concat_ws("\t", F.concat(F.lit("m"), (k % 3).cast("string")), k.cast("string"), (k % 5 + 1).cast("string"))
    inputs.table(spark, sf, "supplier").select(line.alias("value")).write.text(path)
    return tables.read_priors(spark, path)


@query(f"WITH {SHEET_SQL} SELECT CASE WHEN k % 2 = 0 THEN sample_name END AS name, cbc AS seq FROM sheet WHERE k % 3 <> 0")
def whitelist_scan(spark, sf):
    """Lines with and without a name, in either case, some with letters that are no code, Windows line ends."""
    path = _folder(spark, "whitelist")
    k = F.col("sheet_ordinal")
    code = F.when(k % 3 == 0, F.concat(F.lit("X!"), "cbc")).otherwise(F.lower("cbc"))
    line = F.concat(F.when(k % 2 == 0, F.concat("sample_name", F.lit("\t"))).otherwise(""), code, F.lit("\r"))
    inputs.sheet(spark, sf).select(line.alias("value")).write.text(path)
    return tables.read_whitelist(spark, path)


@query(f"WITH {SHEET_SQL} SELECT cbc AS barcode FROM sheet")
def barcode_scan(spark, sf):
    path = _folder(spark, "barcodes")
    inputs.sheet(spark, sf).select(F.concat(F.lit(" "), "cbc", F.lit("\r")).alias("value")).write.text(path)
    return tables.read_barcodes(spark, path)


@query(f"WITH {SHEET_SQL} SELECT sample_name, cbc, i5, i7 FROM sheet")
def sheet_scan(spark, sf):
    path = _folder(spark, "sheet")
    sheet = inputs.sheet(spark, sf).select("sample_name", F.lower("cbc").alias("cbc"), "i5", F.concat(F.lit(" "), "i7").alias("i7"))
    sheet.write.csv(path, header=True, ignoreLeadingWhiteSpace=False)
    return tables.read_samples(spark, path).drop("sheet_ordinal")


@query("SELECT n_chars::INTEGER AS n FROM documents")
def lengths_scan(spark, sf):
    path = _folder(spark, "lengths")
    lines = F.explode(F.array(F.col("n_chars").cast("string"), F.lit("not a number")))
    inputs.table(spark, sf, "documents").select(lines.alias("value")).write.text(path)
    return tables.read_lengths(spark, path)


@query(f"WITH {READS_SQL} SELECT sequence, length(sequence) AS labels, CASE WHEN read_id % 4 = 0 THEN 'loss' END AS error_type FROM reads")
def labelled_roundtrip(spark, sf):
    """Labelled reads as text with metadata, written and read again."""
    path = _folder(spark, "labelled")
    reads = inputs.reads(spark, sf).withColumn("error_type", F.when(F.col("read_id") % 4 == 0, "loss"))
    sinks.labelled_rows(reads, ["error_type"]).write.text(path)
    return tables.read_labelled(spark, path).select("sequence", F.size("labels").alias("labels"), F.try_element_at("metadata", F.lit("error_type")).alias("error_type"))


@query(f"WITH {READS_SQL} SELECT read_id, sequence, read_id % 4 = 0 AS is_invalid FROM reads")
def labelled_json(spark, sf):
    """Labelled reads as JSON, one an object a line, and the same wrapped in one object with its metadata."""
    path = _folder(spark, "json")
    reads = inputs.reads(spark, sf).select("read_id", "sequence", "labels", (F.col("read_id") % 4 == 0).alias("is_invalid"))
    sinks.write_reads(reads, path, "json")
    return tables.read_labelled_json(spark, path, "read_id long, sequence string, labels array<string>, is_invalid boolean").drop("labels")


@query(f"WITH {RUNS_SQL} SELECT read_id, count(*) AS segments, max(\"end\") AS last FROM runs GROUP BY read_id")
def annotation_json(spark, sf):
    """Segments of each read as JSON lines, compressed, read again."""
    path = _folder(spark, "annotations")
    found = runs.long_runs(inputs.states(spark, sf)).groupBy("read_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "label"))).alias("segments"))
    sinks.write_jsonl(found, path)
    back = spark.read.json(path, schema="read_id long, segments array<struct<start:long,end:long,label:string>>")
    return back.select("read_id", F.size("segments").cast("long").alias("segments"), F.array_max(F.transform("segments", lambda s: s["end"])).alias("last"))


# --- small functions and rules ---------------------------------------------------------------------------


@query(f"WITH {STATES_SQL}, v AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS k FROM (SELECT DISTINCT label FROM states)) SELECT read_id, pos, list_transform(range(5), lambda i: CASE WHEN i = k THEN 1 ELSE 0 END)::VARCHAR AS hot FROM states JOIN v USING (label)")
def one_hot(spark, sf):
    codes = seq.map_lookup({x: str(i) for i, x in enumerate(("click", "error", "purchase", "signup", "view"))}, F.col("label"), "-1").cast("int")
    hot = seq.one_hot(F.array(codes), 5)[0]
    return inputs.states(spark, sf).select("read_id", "pos", F.concat(F.lit("["), F.array_join(hot.cast("array<string>"), ", "), F.lit("]")).alias("hot"))


@query(f"WITH {SHEET_SQL} SELECT i7 || '+' || i5 || '+' || cbc AS barcode, sample_name FROM sheet")
def barcode_keys(spark, sf):
    return inputs.sheet(spark, sf).select(seq.barcode_key(F.col("i7"), F.col("i5"), F.col("cbc")).alias("barcode"), "sample_name")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'red' WHEN 'view' THEN 'blue' ELSE 'grey' END AS colour FROM events")
def colour_lookup(spark, sf):
    return inputs.table(spark, sf, "events").select("event_id", seq.map_lookup({"click": "red", "view": "blue"}, F.col("event_type"), "grey").alias("colour"))


@query(
    f"""WITH {READS_SQL}, r AS (SELECT read_id, CASE WHEN read_id % 6 = 0 THEN '' WHEN read_id % 6 = 1 THEN sequence || '-' ELSE sequence END AS s FROM reads)
    SELECT read_id, s <> '' AND regexp_full_match(s, '[ACGTN]*') AS valid FROM r"""
)
def sequence_validity(spark, sf):
    k = F.col("read_id")
    s = F.when(k % 6 == 0, "").when(k % 6 == 1, F.concat("sequence", F.lit("-"))).otherwise(F.col("sequence"))
    return inputs.reads(spark, sf).select("read_id", demux.valid_sequence(s).alias("valid"))


@query(f"WITH {READS_SQL} SELECT read_id FROM reads WHERE read_id % 4 <> 0 AND read_id % 3 <> 0")
def valid_reads(spark, sf):
    """Reads that aren't marked invalid and whose labels are as long as their sequence."""
    k = F.col("read_id")
    marked = inputs.reads(spark, sf).select(
        "read_id", "sequence", F.when(k % 3 == 0, F.slice("labels", 1, 10)).otherwise(F.col("labels")).alias("labels"), F.when(k % 4 == 0, True).alias("is_invalid")
    )
    return demux.valid_reads(marked).select("read_id")


@query(f"WITH {RUNS_SQL}, {BOUNDS_SQL} SELECT read_id, label, \"start\", n < min_len AS short, n > max_len AS long FROM runs JOIN bounds USING (label) WHERE n < min_len OR n > max_len")
def length_violations(spark, sf):
    found = runs.long_runs(inputs.states(spark, sf)).withColumn("n", F.col("end") - F.col("start"))
    return decode.length_violations(found, spark.createDataFrame(BOUNDS, "label string, min_len int, max_len int")).select("read_id", "label", "start", "short", "long")


@query("SELECT event_type AS error_type, count(*) AS n, count(*) / (SELECT count(*) FROM events) AS share FROM events WHERE event_type <> 'view' GROUP BY event_type")
def error_histogram(spark, sf):
    kinds = inputs.table(spark, sf, "events").select(F.when(F.col("event_type") != "view", F.col("event_type")).alias("error_type"))
    return evaluate.error_histogram(kinds)


@query(
    f"""WITH {PRED_SQL}, {WEIGHTS_SQL}, m AS (SELECT read_id, pos, label, sum(weight * p) / sum(weight) AS mean, sum(weight * p * p) / sum(weight) AS square FROM pred JOIN weights USING (model) GROUP BY ALL)
    SELECT read_id, pos, label, {_r('greatest(square - mean * mean, 0)')} AS variance FROM m"""
)
def posterior_variance(spark, sf):
    return ensemble.posterior_variance(inputs.predictions(spark, sf), _weights(spark))


@query(
    f"""WITH {ROUNDED_SQL} SELECT read_id, pos, max({{'p': p, 'a': -label}}).a * -1 AS label, round(max(p), 6) AS p, round(-sum(p * ln(p + 1e-10)), 6) AS entropy FROM combined GROUP BY ALL"""
)
def ensemble_predict(spark, sf):
    """Models combined, the winning label with its probability, and the entropy of the place, in one call."""
    found = ensemble.predict(inputs.predictions(spark, sf), _weights(spark))
    return found.select("read_id", "pos", "label", F.round("p", 6).alias("p"), F.round("entropy", 6).alias("entropy"))


# --- reports ---------------------------------------------------------------------------------------------


@query(
    f"""WITH {READS_SQL}, h AS (SELECT * FROM reads ORDER BY read_id LIMIT 100) SELECT 'error_type' AS kind, 'loss' AS name, count(*) AS n FROM h WHERE read_id % 4 = 0
    UNION ALL SELECT 'label', name, n * (SELECT count(*) FROM h) FROM (VALUES {', '.join(f"('{name}', {end - start})" for name, start, end in inputs.LAYOUT)}) l(name, n)"""
)
def preview_counts(spark, sf):
    """Error types and labels of the first hundred reads."""
    return sinks.preview_counts(inputs.reads(spark, sf).withColumn("error_type", F.when(F.col("read_id") % 4 == 0, "loss")), 100)


@query(
    f"""WITH {CLASSES_SQL}, w AS (SELECT sum(tp) / sum(support) AS accuracy, sum("precision" * support) / sum(support) AS "precision", sum(recall * support) / sum(support) AS recall, sum(f1 * support) / sum(support) AS f1 FROM rated)
    SELECT segment, metric, {_r('value')} AS value FROM (
      SELECT class AS segment, unnest(['precision', 'recall', 'f1', 'support']) AS metric, unnest(["precision", recall, f1, support::DOUBLE]) AS value FROM rated
      UNION ALL SELECT NULL, unnest(['accuracy', 'precision', 'recall', 'f1']), unnest([accuracy, "precision", recall, f1]) FROM w)"""
)
def evaluation_report(spark, sf):
    """Scores by segment and in all as rows, written as JSON lines and read again."""
    path = _folder(spark, "report")
    sinks.write_report(evaluate.report(inputs.pairs(spark, sf)), path)
    return spark.read.json(path, schema="segment string, metric string, value double")


@query(
    f"""WITH {PAIRS_SQL}, a AS (SELECT CASE WHEN read_id % 4 = 0 THEN 'valid' ELSE 'v' || read_id % 4 END AS variant, avg((truth = label)::INT) AS accuracy FROM pairs GROUP BY ALL),
    f AS (SELECT 'worst' AS rule, arg_min(variant, accuracy) AS name, min(accuracy) AS accuracy, 0.7::DOUBLE AS least FROM a
      UNION ALL SELECT 'variant', variant, accuracy, 0.8 FROM a WHERE variant = 'v2' UNION ALL SELECT 'group', 'v', avg(accuracy), 0.75 FROM a)
    SELECT rule, name, {_r('accuracy')} AS accuracy, {_r('least')} AS least FROM f WHERE accuracy < least"""
)
def robustness_report(spark, sf):
    return evaluate.robustness_findings(_accuracies(spark, sf, "variant"), 0.7, {"v2": 0.8}, {"v": 0.75})


@query(
    f"""WITH {PRED_SQL}, {WEIGHTS_SQL}, m AS (SELECT read_id, pos, label, sum(weight * p) / sum(weight) AS mean, sum(weight * p * p) / sum(weight) AS square FROM pred JOIN weights USING (model) GROUP BY ALL)
    SELECT 'weight' AS kind, model AS name, {_r('weight')} AS value FROM weights UNION ALL SELECT 'evidence', model, {_r('ln(weight)')} FROM weights
    UNION ALL SELECT 'variance', label::VARCHAR, round(sum(greatest(square - mean * mean, 0)), 6) FROM m GROUP BY label"""
)
def ensemble_results(spark, sf):
    """Weights, evidences and variances of an ensemble, written to one folder and read again."""
    path = _folder(spark, "ensemble")
    weights = _weights(spark)
    evidences = weights.select("model", F.log("weight").alias("evidence"))
    sinks.write_ensemble(weights, evidences, path, ensemble.posterior_variance(inputs.predictions(spark, sf), weights))
    own = spark.read.json(f"{path}/weights", schema="model string, weight double").select(F.lit("weight").alias("kind"), F.col("model").alias("name"), F.col("weight").alias("value"))
    seen = spark.read.json(f"{path}/evidences", schema="model string, evidence double").select(F.lit("evidence"), "model", "evidence")
    spread = spark.read.parquet(f"{path}/variance").groupBy("label").agg(F.round(F.sum("variance"), 6).alias("v")).select(F.lit("variance"), F.col("label").cast("string"), "v")
    return own.union(seen).union(spread)


@query(
    f"""WITH {READS_SQL} SELECT CASE WHEN read_id % 5 = 0 THEN 'invalid' ELSE 'valid' END AS kind, read_id::VARCHAR AS read_id, sequence, translate(sequence, 'ACGT', '+@IF') AS quality FROM reads"""
)
def fastq_validate(spark, sf):
    """Reads of FASTQ files joined with predicted labels, validated, written as valid and other reads, and read again."""
    path = _folder(spark, "validate")
    fastq.record_rows(_with_quality(spark, sf)).write.text(f"{path}/given")
    k = F.col("read_id")
    labels = F.when(k % 10 == 0, F.slice("labels", 1, 20)).otherwise(F.col("labels"))
    predicted = inputs.reads(spark, sf).filter(k % 10 != 5).select(k.cast("string").alias("read_id"), labels.alias("labels"))
    settings = DemuxSettings(expected=tuple(name for name, _, _ in inputs.LAYOUT), required=("CBC",), optional=())
    write_validated(validate_fastq(spark, f"{path}/given", predicted, settings), path, invalid=True)
    parts = [fastq.read_split(spark, f"{path}/{kind}").select(F.lit(kind).alias("kind"), "read_id", "sequence", "quality") for kind in ("valid", "invalid")]
    return parts[0].union(parts[1])


@query()
def isotonic_by_label(spark, sf):
    """Combined probabilities calibrated one label against the rest; tests hold it against pooled neighbours."""
    combined = ensemble.average(inputs.predictions(spark, sf), _weights(spark)).select("read_id", "pos", "label", F.round("p", 12).alias("p"))
    return calibrate.calibrate_labels(combined, inputs.truth(spark, sf))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'c' WHEN 'view' THEN 'V' WHEN 'signup' THEN 's' END AS source FROM events")
def folded_lookup(spark, sf):
    """Keys in other cases than the table's; a key that it lacks has no value, nor has one whose value is empty."""
    key = F.when(F.col("event_type") == "click", "CLICK").otherwise(F.initcap("event_type"))
    return inputs.table(spark, sf, "events").select("event_id", seq.folded_lookup({"click": "c", "VIEW": "V", "Signup": "s", "error": ""}, key).alias("source"))


@query(f"WITH {SHEET_SQL} SELECT sample_name AS model, cbc AS first, cbc || '>' || i5 AS parts, 2::BIGINT AS n FROM sheet")
def orders_scan(spark, sf):
    """Lists of segments written as text, read as lists; quotes of either kind."""
    path = _folder(spark, "orders")
    quote = F.when(F.col("sheet_ordinal") % 2 == 0, "'").otherwise('"')
    item = [F.concat(quote, c, quote) for c in ("cbc", "i5")]
    given = inputs.sheet(spark, sf).select(F.col("sample_name").alias("model"), F.concat(F.lit("["), item[0], F.lit(", "), item[1], F.lit("]")).alias("segments"))
    given.write.csv(path, sep="\t", header=True)
    back = tables.read_orders(spark, path, ["segments"])
    return back.select("model", F.get("segments", 0).alias("first"), F.array_join("segments", ">").alias("parts"), F.size("segments").cast("long").alias("n"))


@query(
    f"""WITH {PRED_SQL}, {TRUTH_SQL} SELECT model, count(*) AS cells, count_if(pred.label = truth.label)::BIGINT AS places, {_r("sum(CASE WHEN pred.label = truth.label THEN p END)")} AS p_true
    FROM pred JOIN truth USING (read_id, pos) GROUP BY model"""
)
def validation_scan(spark, sf):
    """Arrays of probabilities with true labels, written, read as predictions and truth, and joined again."""
    path = _folder(spark, "validation")
    listed = inputs.predictions(spark, sf).groupBy("model", "read_id", "pos").agg(F.sort_array(F.collect_list(F.struct("label", "p")))["p"].alias("probs"))
    listed.join(inputs.truth(spark, sf), ["read_id", "pos"]).write.parquet(path)
    predictions, truth = tables.read_validation(spark, path)
    right = F.col("label") == F.col("true")
    joined = predictions.join(truth.withColumnRenamed("label", "true"), ["read_id", "pos"])
    return joined.groupBy("model").agg(F.count("*").alias("cells"), F.count_if(right).alias("places"), F.sum(F.when(right, F.col("p"))).alias("p_true"))


def _written_demux(spark, sf):
    """A demultiplexing result in its files: annotations and statistics."""
    path = _folder(spark, "demultiplexed")
    found = demux.assign(inputs.coded(spark, sf), inputs.sheet(spark, sf))
    none = {c: F.lit(None).cast("string") for c in ("segments", "orientation", "issues")}
    write_demultiplexed(Demultiplexed(found.withColumns(none), demux.statistics(found), found.limit(0)), path)
    return path


@query(SUMMARY_SQL)
def statistics_sink(spark, sf):
    counts = ("total", "valid", "invalid", "ambiguous", "exact", "corrected", "no_match")
    schema = ", ".join(["sample_name string", *(f"{c} long" for c in counts), "valid_rate double", "assignment_rate double"])
    return spark.read.json(f"{_written_demux(spark, sf)}/statistics", schema=schema)


@query(f"WITH {ASSIGNED_SQL} SELECT read_id, classification, sample_name, match, distance FROM assigned")
def annotation_sink(spark, sf):
    schema = "read_id long, classification string, sample_name string, match string, distance long"
    return spark.read.json(f"{_written_demux(spark, sf)}/annotations", schema=schema)


@query(f"""WITH {MOTIFS_SQL} SELECT read_id, 6::BIGINT AS n, true AS allowed, translate(motif, 'CGT', '') AS kept FROM motifs""")
def iupac_resolved(spark, sf):
    """Three of four bases become codes; each is resolved to a base that it stands for, the fourth stays."""
    given = inputs.motifs(spark, sf).select("read_id", "motif", F.translate("motif", "CGT", "BKY").alias("codes"))
    found = given.select("*", seq.iupac_resolve(F.col("codes"), 7, F.col("read_id")).alias("resolved"))
    fits = F.zip_with(seq.letters(F.col("codes")), seq.letters(F.col("resolved")), lambda c, b: F.instr(F.element_at(F.create_map(*map(F.lit, ("A", "A", "B", "CGT", "K", "GT", "Y", "CT"))), c), b) > 0)
    kept = F.array_join(F.zip_with(seq.letters(F.col("codes")), seq.letters(F.col("resolved")), lambda c, b: F.when(c == "A", b).otherwise("")), "")
    return found.select("read_id", F.length("resolved").cast("long").alias("n"), F.forall(fits, lambda x: x).alias("allowed"), kept.alias("kept"))


@query(
    f"""WITH {SCORED_SQL} SELECT DISTINCT round(score, 9) AS score, count(*) OVER (PARTITION BY round(score, 9)) AS n, {_r("cume_dist() OVER (ORDER BY round(score, 9))")} AS share FROM scored"""
)
def cumulative_scores(spark, sf):
    return motif.cumulative(_scored(spark, sf).select(F.round("score", 9).alias("score")), "score")


@query(
    f"""WITH {SCORED_SQL}, {FREQ_SQL[len(PLACED_SQL) + 2:]}, e AS (SELECT pos, sum(-freq * ln(freq + 1e-10)) / ln(4) AS h FROM freqs GROUP BY pos),
    b AS (SELECT pos, coalesce(freq, 0) + 1e-10 AS p, prob + 1e-10 AS q FROM pwm LEFT JOIN freqs USING (pos, base)),
    s AS (SELECT p / sum(p) OVER (PARTITION BY pos) AS p, q / sum(q) OVER (PARTITION BY pos) AS q FROM b)
    SELECT count(*) AS n, 6.0::DOUBLE AS mean_length, 0.0::DOUBLE AS std_length, 6::BIGINT AS min_length, 6::BIGINT AS max_length, 6::BIGINT AS mode_length,
      {_r("avg(length(translate(motif, 'AT', '')) / 6)")} AS mean_gc, (SELECT {_r("avg(score)")} FROM scored) AS mean_score,
      (SELECT {_r("avg(h)")} FROM e) AS mean_entropy, (SELECT {_r("min(h)")} FROM e) AS min_entropy, (SELECT {_r("max(h)")} FROM e) AS max_entropy,
      (SELECT {_r("avg(d)")} FROM (SELECT 1 - sum(n * (n - 1)) / (sum(n) * (sum(n) - 1)) AS d FROM freqs GROUP BY pos)) AS mean_distance,
      {_r("count(DISTINCT motif) / count(*)")} AS uniqueness, (SELECT {_r("sum(p * ln(p / q))")} FROM s) AS kl
    FROM motifs"""
)
def motif_report(spark, sf):
    return motif.report(inputs.motifs(spark, sf), MATRIX, "motif")


def queries() -> dict[str, Query]:
    from readloom import scale_queries  # noqa: F401  adds to the register

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from readloom import scale_queries  # noqa: F401

    return dict(SQL)
