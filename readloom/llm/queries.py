"""The corpus operators applied to whole tables, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.llm import (
    aho_decontaminate,
    ef_trie_lm,
    histogram_shards,
    hyperdimensional,
    license_diagonals,
    merkle_fixity,
    packing,
    periodic_runs,
    scaled_sketch,
    simhash_vptree,
    target_resampling,
    token_trees,
    url_rules,
)
from readloom.llm.common import table, written

#: Pages of one archive file.
ARCHIVE_PAGES = 1_000


def replicas(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages as records of archive files (page_id, archive, offset, length, digest), and a replica with planted damage.

    By the digest of its page's id a record of the replica is altered, cut short, lost or joined by another.
    Payloads are digested where they are read; only digests and lengths are brought together, to add up offsets.
    """
    fate = F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 2)
    half = F.floor(F.length("html") / 2).cast("int")
    changed = F.when(fate.isin("00", "01"), F.concat(F.lit("#"), F.substring("html", F.lit(2), F.length("html")))).when(
        fate == "03", F.substring("html", F.lit(1), half)
    )
    records = pages.select(
        "page_id",
        F.floor(F.col("page_id") / ARCHIVE_PAGES).cast("string").alias("archive"),
        F.coalesce(F.octet_length("html"), F.lit(0)).cast("long").alias("length"),
        merkle_fixity.digest_of(F.col("html")).alias("digest"),
        fate.alias("fate"),
        F.when(fate.isin("00", "01", "03"), merkle_fixity.digest_of(changed)).alias("changed"),
    )
    along = Window.partitionBy("archive").orderBy("page_id", "digest")
    before = F.sum("length").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("length")
    records = written(records.withColumn("offset", before), "records")
    length = F.when(F.col("fate") == "03", F.floor(F.col("length") / 2)).otherwise(F.col("length"))
    kept = records.filter("fate <> '02'").select("archive", "offset", length.alias("length"), F.coalesce("changed", "digest").alias("digest"))
    stray = records.filter("fate = '04'").select("archive", F.col("offset") + 1, F.lit(5).cast("long"), F.sha2(F.lit(b"stray"), 256))
    return records.select("page_id", "archive", "offset", "length", "digest"), kept.union(stray)


def op1_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    primary, replica = replicas(table(spark, sf_dir, "pages"))
    return merkle_fixity.audit(primary, replica, keys=("page_id",), digest="digest")


OP1_SQL = """
WITH records AS (
  SELECT page_id, CAST(page_id // 1000 AS VARCHAR) AS archive, coalesce(strlen(html), 0) AS length, html AS payload,
    CAST(sum(coalesce(strlen(html), 0)) OVER (PARTITION BY page_id // 1000 ORDER BY page_id, coalesce(sha256(html), 'null')
      ROWS UNBOUNDED PRECEDING) - coalesce(strlen(html), 0) AS BIGINT) AS "offset",
    substr(md5(CAST(page_id AS VARCHAR)), 1, 2) AS fate
  FROM pages),
mine AS (
  SELECT archive, "offset", length, coalesce(sha256(payload), 'null') AS digest, page_id FROM records),
replica AS (
  SELECT archive, "offset", CASE WHEN fate = '03' THEN length // 2 ELSE length END AS length,
    CASE WHEN fate IN ('00', '01') THEN '#' || substr(payload, 2)
      WHEN fate = '03' THEN substr(payload, 1, length(payload) // 2) ELSE payload END AS payload
  FROM records WHERE fate <> '02'
  UNION ALL SELECT archive, "offset" + 1, 5, 'stray' FROM records WHERE fate = '04'),
own AS (SELECT archive, "offset", length, digest, count(*) AS n FROM mine GROUP BY ALL),
theirs AS (
  SELECT archive, "offset", length, coalesce(sha256(payload), 'null') AS digest, count(*) AS m FROM replica GROUP BY ALL),
odd AS (
  SELECT archive, "offset", length, digest, n, m, coalesce(n, 0) - coalesce(m, 0) AS over
  FROM own FULL JOIN theirs USING (archive, "offset", length, digest) WHERE coalesce(n, 0) <> coalesce(m, 0)),
lost AS (
  SELECT archive, "offset", length, digest, page_id FROM mine SEMI JOIN (FROM odd WHERE m IS NULL) o USING (archive, "offset", length, digest)
  UNION ALL SELECT archive, "offset", length, digest, NULL FROM odd, range(over) WHERE over > 0 AND m IS NOT NULL),
more AS (SELECT archive, "offset", length, digest FROM odd, range(-over) WHERE over < 0),
a1 AS (SELECT *, row_number() OVER (PARTITION BY archive, "offset", length ORDER BY digest, page_id) AS k FROM lost),
b1 AS (SELECT *, row_number() OVER (PARTITION BY archive, "offset", length ORDER BY digest) AS k FROM more),
paired AS (
  SELECT archive, "offset", a1.length AS length, b1.length AS replica_length, a1.digest AS digest, b1.digest AS replica_digest, page_id
  FROM a1 JOIN b1 USING (archive, "offset", length, k)),
a2 AS (
  SELECT *, row_number() OVER (PARTITION BY archive, "offset" ORDER BY length DESC, digest, page_id) AS j
  FROM a1 ANTI JOIN b1 USING (archive, "offset", length, k)),
b2 AS (
  SELECT *, row_number() OVER (PARTITION BY archive, "offset" ORDER BY length DESC, digest) AS j
  FROM b1 ANTI JOIN a1 USING (archive, "offset", length, k)),
sides AS (
  FROM paired UNION ALL BY NAME
  SELECT archive, "offset", a2.length AS length, b2.length AS replica_length, a2.digest AS digest, b2.digest AS replica_digest, page_id
  FROM a2 FULL JOIN b2 USING (archive, "offset", j))
SELECT archive, "offset", page_id, CAST(length AS BIGINT) AS length, CAST(replica_length AS BIGINT) AS replica_length, digest, replica_digest,
  CASE WHEN replica_digest IS NULL THEN 'missing' WHEN digest IS NULL THEN 'extra'
    WHEN length <> replica_length THEN 'resized' ELSE 'altered' END AS kind
FROM sides
"""


def op2_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_vptree.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


URL_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_rules.judge(pages, url_rules.rule_table(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = """
WITH split AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM split),
rules(verdict, host, path) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
best AS (
  SELECT page_id, p.host, p.path, r.host || r.path AS rule, verdict,
    row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS n
  FROM (SELECT DISTINCT * FROM parts) p JOIN rules r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN best b ON b.n = 1 AND p.page_id = b.page_id AND p.host = b.host AND p.path = b.path
"""


def op4_aho_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return aho_decontaminate.digest(aho_decontaminate.scan(docs, table(spark, sf_dir, "benchmark")))


OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
starts AS (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS g FROM starts),
places AS (SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k),
grams AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM places),
found AS (SELECT r, i, k, item FROM grams JOIN win USING (k, g)),
hit AS (SELECT DISTINCT r, unnest(range(i, i + k)) AS x FROM found),
hits AS (SELECT r, count(*) AS n FROM hit GROUP BY r),
stretches AS (SELECT r, min(x) AS a, max(x) AS b FROM (SELECT r, x, x - row_number() OVER (PARTITION BY r ORDER BY x) AS run FROM hit) GROUP BY r, run),
gaps AS (
  SELECT r, w, regexp_split_to_array(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS s FROM d WHERE r IN (SELECT r FROM hits)),
spans AS (
  SELECT r, string_agg(concat_ws(':', a - 1, b, list_sum([strlen(x) FOR x IN s[:a]]) + coalesce(list_sum([strlen(x) FOR x IN w[:a - 1]]), 0),
    list_sum([strlen(x) FOR x IN s[:b]]) + list_sum([strlen(x) FOR x IN w[:b]])), ',' ORDER BY a) AS spans
  FROM stretches JOIN gaps USING (r) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(t.n, 0) AS BIGINT) AS n_items, sha256(coalesce(t.list, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated,
  coalesce(spans, '') AS spans
FROM d LEFT JOIN hits h USING (r) LEFT JOIN items t USING (r) LEFT JOIN spans USING (r)
"""


def op5_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_diagonals.scan(table(spark, sf_dir, "documents")).drop("spans")


def _gram_values() -> str:
    rows = []
    templates = [*((t, label, True) for t, label in license_diagonals.PHRASES), *((t, label, False) for t, label in license_diagonals.NOTICES)]
    for i, (text, label, phrase) in enumerate(templates):
        words = [w.decode() for w in license_diagonals.words_of(text.encode())]
        rows += [f"({i}, '{label}', {phrase}, {len(words) - 1}, {n}, '{a} {b}')" for n, (a, b) in enumerate(zip(words, words[1:]))]
    return ", ".join(rows)


OP5_SQL = (
    r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t(template, label, phrase, grams, place, g) AS (VALUES """
    + _gram_values()
    + """),
places AS (SELECT r, i - 1 AS p, w[i] || ' ' || w[i + 1] AS g FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM d)),
votes AS (
  SELECT r, template, label, phrase, grams, p - place AS diagonal, count(*) AS votes, min(p) AS low, list(DISTINCT place) AS places
  FROM places JOIN t USING (g) GROUP BY ALL HAVING CASE WHEN phrase THEN count(*) = grams ELSE count(*) > 1 END),
dealt AS (
  SELECT *, CASE WHEN phrase THEN diagonal ELSE floor((diagonal + half * 16) / 32) END AS stretch
  FROM votes, (VALUES (0), (1)) h(half) WHERE NOT phrase OR half = 0),
rated AS (
  SELECT r, label, phrase, min(low) AS low, len(list_distinct(flatten(list(places)))) / grams AS coverage,
    phrase OR coverage >= 0.5 AS verified
  FROM dealt GROUP BY r, template, label, phrase, grams, half, stretch),
found AS (
  SELECT r, count_if(phrase) AS n_base, min(low) FILTER (phrase) AS first_word, max(low) FILTER (phrase) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (verified) AS labels,
    max(CASE WHEN phrase THEN 1.0 ELSE coverage END) AS score
  FROM rated GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN found USING (r)
"""
)


def op6_ef_trie_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ef_trie_lm.fit_score(table(spark, sf_dir, "documents"))


def op7_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled_sketch.neighbours(table(spark, sf_dir, "documents"))


def edits(text):
    """Three edits of each text: its middle replaced, a stretch of its first third taken out, its start changed."""
    n = F.coalesce(F.length(text), F.lit(0))

    def edit(start, removed, inserted):
        return F.struct(F.floor(start).cast("int").alias("start"), F.lit(removed).alias("removed"), inserted.alias("inserted"))

    return F.array(edit(n / 2, 3, F.substring(text, 1, 24)), edit(n / 3, 40, F.lit("")), edit(F.lit(0.0), 1, F.lit("New 2")))


def op8_token_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees are stored first; the edits are applied to what is stored."""
    trees = written(token_trees.count(table(spark, sf_dir, "documents")), "trees")
    found = token_trees.resume(trees.withColumn("edits", edits(F.col("text"))))
    sha = F.sha2(F.col("text").cast("binary"), 256).alias("edited_sha256")
    return found.select("doc_id", "n_tokens", "edited_tokens", "edited_chars", "recoded_chars", sha)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_hyperdimensional(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learnt = hyperdimensional.training_rows(docs)
    langs, prototypes = hyperdimensional.fit(docs.filter(learnt), "text", "lang")
    found = hyperdimensional.with_language(docs.select("doc_id", "text"), langs, prototypes)
    return found.select("doc_id", (~learnt).alias("held_out"), "lang_pred", "score")


def planted_repeats(text, id_):
    """Of one text in ten, by the CRC-32 of its id, words from some place on repeat with a period; both are the CRC's. Others stay."""
    h = F.crc32(id_.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))
    repeated = F.slice(F.concat(F.slice(words, F.lit(1), a), F.flatten(tail)), F.lit(1), n)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(repeated, " ")).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted_repeats(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic_runs.with_runs(docs)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed")
    return found.select(
        "doc_id",
        "n_runs",
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(-1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join("lines", "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _crc32_sql(digits: str) -> str:
    """CRC-32 in SQL of a column of hexadecimal digits, which fold, the lower of each byte first, through the 16 remainders of four bits."""
    steps = []
    for n in range(16):
        for _ in range(4):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        steps.append(n)
    values = f"[instr('123456789ABCDEF', substr({digits}, i - 1 + 2 * (i % 2), 1)) FOR i IN range(1, strlen({digits}) + 1)]"
    fold = f"list_reduce(list_prepend(4294967295, {values}), lambda c, d: xor(c >> 4, ({steps})[(xor(c, d) & 15) + 1]))"
    return f"xor({fold}, 4294967295)"


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP12_SQL = (
    r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all("""
    + _LOWER
    + r""", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all("""
    + _LOWER
    + r""", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
mine AS (SELECT r, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])) AS f FROM d),
theirs AS (SELECT unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])) AS f FROM b),
hashed AS MATERIALIZED (SELECT f, """
    + _crc32_sql("x")
    + """ % 10000 AS bucket FROM (SELECT f, hex(f) AS x FROM (SELECT DISTINCT f FROM mine UNION SELECT DISTINCT f FROM theirs))),
own AS (SELECT bucket, count(*) AS s FROM mine JOIN hashed USING (f) GROUP BY bucket),
wanted AS (SELECT bucket, count(*) AS t FROM theirs JOIN hashed USING (f) GROUP BY bucket),
sums AS (SELECT CAST((SELECT count(*) FROM mine) + 10000 AS DOUBLE) AS s_all, CAST((SELECT count(*) FROM theirs) + 10000 AS DOUBLE) AS t_all),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * s_all / ((s + 1.0::DOUBLE) * t_all))) AS BIGINT) AS gain
  FROM own LEFT JOIN wanted USING (bucket), sums),
weighed AS (
  SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM mine JOIN hashed USING (f) JOIN gain USING (bucket) GROUP BY r),
scored AS (
  SELECT r, doc_id, len(w) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features,
    coalesce((total - ((total % n) + n) % n) // n, 0) AS weight,
    CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS noise
  FROM d LEFT JOIN weighed USING (r)),
placed AS (
  SELECT r, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS place, count(*) OVER () AS n
  FROM scored WHERE n_words >= 20 AND doc_id IS NOT NULL)
SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(weight + noise AS BIGINT) AS score,
  CASE WHEN place <= 25 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (r)
"""
)


def op13_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = histogram_shards.shard(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP13_SQL = (
    """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 8 AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS own, md5(coalesce(text, '')) || own AS key FROM documents),
hashed AS (SELECT text, """
    + _crc32_sql("x")
    + """ AS crc FROM (SELECT text, hex(text) AS x FROM (SELECT DISTINCT text FROM d))),
summed AS (SELECT r, sum(size) OVER (ORDER BY key, r ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM d),
dealt AS (
  SELECT d.*, CAST(24 * before // total AS INTEGER) AS shard,
    CAST('0x' || substr(own, 1, 15) AS BIGINT) % CAST(ceil(count(*) OVER (PARTITION BY 24 * before // total) / 8192.0) AS BIGINT) AS deal
  FROM d JOIN summed USING (r))
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY deal, key, r) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM dealt JOIN hashed USING (text)
"""
)


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_merkle_fixity,
            op2_simhash_vptree,
            op3_url_rules,
            op4_aho_decontaminate,
            op5_license_diagonals,
            op6_ef_trie_lm,
            op7_scaled_sketch,
            op8_token_trees,
            op9_packing,
            op10_hyperdimensional,
            op11_periodic_runs,
            op12_target_resampling,
            op13_histogram_shards,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_merkle_fixity": OP1_SQL,
        "op3_url_rules": OP3_SQL,
        "op4_aho_decontaminate": OP4_SQL,
        "op5_license_diagonals": OP5_SQL,
        "op12_target_resampling": OP12_SQL,
        "op13_histogram_shards": OP13_SQL,
    }
