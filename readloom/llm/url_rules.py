"""URL filters (operator 3, native): a sort-merge range join of canonical URL keys with nested rules.

A rule's key is its host with the labels reversed, then its path (``com.example/en/``). Everything that
starts with the key is an interval of the sorted key space, and two rules' intervals are nested or
apart. A URL has one key for each of its host's suffixes (``com/x``, ``com.example/x``), so a rule
covers its host and all subdomains. Rules and URL keys are sorted together; sweeping over them, a
window carries the stack of rules that are open at the last rule's start, and at a URL key the rules
on the stack that don't reach it are popped. The innermost rule left is the longest one that fits.

Each distinct URL is judged once. Only suffixes that some rule has are swept, each on its own. A suffix that
holds more than ``SHARD`` URLs (a host or a top level with a third of all rows) is split by a hash of the URL, and
only that suffix's rules are copied to its parts; so the work is the same for five rules and for
millions. Built-in functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import free_name

#: URL keys of one host suffix that are swept together, about.
SHARD = 25_000
#: Host suffixes of rules (about 50 bytes each) that may be sent to every task; more are joined by shuffle.
SENT_SUFFIXES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.coalesce(F.when(at > 0, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.coalesce(F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def _reversed(labels: Column) -> Column:
    return F.array_join(F.reverse(labels), ".")


def rule_table(spark, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(rule, verdict) rows as a table; a rule is a host and a path that starts with ``/``."""
    if not rules:
        return spark.range(0).select(F.lit("").alias("rule"), F.lit("").alias("verdict"))
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for v, r in rules])
    return spark.range(1).select(F.inline(rows))


def _stacks(rules: DataFrame) -> DataFrame:
    """(key, host_key, stack): each rule's key and the rules around it, from the outermost to itself."""
    slash = F.instr("rule", "/")
    host = F.translate(F.substring("rule", F.lit(1), slash - 1), UPPER, LOWER)
    path = F.substring("rule", slash, F.length("rule"))
    keyed = rules.select("rule", "verdict", _reversed(F.split(host, r"\.")).alias("host_key"), path.alias("path"))
    keyed = keyed.filter("rule is not null").withColumn("key", F.concat("host_key", "path"))
    # of rules with one key, the verdict that sorts first (allow before block) stays
    keyed = keyed.groupBy("key").agg(F.min(F.struct("verdict", "rule", "host_key", "path")).alias("r")).select("key", "r.*")
    outer = keyed.select(F.col("key").alias("outer_key"), "rule", "verdict")
    prefixes = keyed.select(
        "key",
        "host_key",
        F.explode(F.transform(F.sequence(F.length("host_key"), F.length("key")), lambda n: F.substring("key", F.lit(1), n))).alias("outer_key"),
    )
    around = prefixes.join(outer, "outer_key").groupBy("key", "host_key")
    entry = F.struct(F.length("outer_key").alias("n"), F.col("outer_key").alias("key"), "rule", "verdict")
    return around.agg(F.sort_array(F.collect_list(entry)).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", shard: int = SHARD) -> DataFrame:
    """``pages`` and four columns: host, path, rule (null if none fits) and verdict.

    The longest fitting rule wins, by the characters of host and path together; on equal length the
    one with the longer host. Of two verdicts for one rule, allow wins. A rule without ``/`` is refused, as it
    would have no end to its host; a null rule is none. A URL without a rule gets ``default``, as does a
    null URL or one without ``://`` (empty host and path). Repeated URLs are judged once and keep their
    rows; columns of ``pages`` named like the four new ones give way, all others stay, whatever their
    names; empty pages give no rows, empty rules the default everywhere.
    """
    slash = F.instr("rule", "/")
    labels = F.max(F.size(F.split(F.substring_index("rule", "/", 1), r"\.")))
    endless, most, n_rules = rules.agg(F.min(F.when(slash == 0, F.col("rule"))), labels, F.count("*")).first()
    if endless is not None:
        raise ValueError(f"a rule is a host, a slash and the start of a path: {endless!r}")
    stacks = _stacks(rules)

    pages = pages.drop("host", "path", "rule", "verdict")
    own = free_name("_url", pages.columns)
    urls = pages.select(F.col(url_col).alias("_url")).filter(F.col("_url").isNotNull()).distinct()
    urls = urls.withColumn("_host", host_of(F.col("_url"))).withColumn("_path", path_of(F.col("_url")))
    parts = F.reverse(F.split("_host", r"\."))
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(most or 1))), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    keys = urls.select("_url", "_path", F.explode(suffixes).alias("host_key"))

    def small(side: DataFrame) -> DataFrame:  # a rule has one suffix, so a hot one isn't shuffled for the few there are
        return F.broadcast(side) if n_rules <= SENT_SUFFIXES else side

    keys = keys.join(small(stacks.select("host_key").distinct()), "host_key", "left_semi")
    splits = keys.groupBy("host_key").agg(F.ceil(F.count("*") / shard).cast("int").alias("splits"))
    keys = keys.join(small(splits), "host_key").select(
        "host_key",
        F.pmod(F.xxhash64("_url"), F.col("splits")).cast("int").alias("split"),
        F.concat("host_key", "_path").alias("key"),
        F.lit(1).alias("kind"),
        "_url",
        F.lit(None).alias("stack"),
    )
    opened = stacks.join(splits, "host_key").select(
        "host_key", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("split"), "key", F.lit(0).alias("kind"), F.lit(None).alias("_url"), "stack"
    )

    sweep = Window.partitionBy("host_key", "split").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = opened.union(keys).withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).filter("kind = 1")
    left = F.filter("stack", lambda r: F.startswith("key", r["key"]))
    fits = swept.filter(F.size(left) > 0).select("_url", F.try_element_at(left, F.lit(-1)).alias("r"), F.length("host_key").alias("h"))
    best = fits.groupBy("_url").agg(F.max(F.struct(F.col("r.n").alias("n"), "h", "r")).alias("best"))
    judged = best.select(F.col("_url").alias(own), F.col("best.r.rule").alias("rule"), F.col("best.r.verdict").alias("verdict"))

    out = pages.join(judged, pages[url_col] == judged[own], "left").drop(own)
    return out.select(
        *[c for c in out.columns if c not in ("rule", "verdict")],
        host_of(F.col(url_col)).alias("host"),
        path_of(F.col(url_col)).alias("path"),
        "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"),
    )
