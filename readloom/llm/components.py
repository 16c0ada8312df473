"""Connected components of an edge table by alternating large-star and small-star steps.

Both steps are a grouped minimum (combined map-side) joined back to the edges. The minima of hubs are
broadcast, so a hub's edges stay where they are: a hub has more than one edge in ``MOST_HUBS``, hence there
can't be more hubs than that. No neighbour list is ever gathered. Each round is
written to the shared folder, which cuts the lineage and survives lost executors. The number of
rounds is logarithmic in the longest chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import written


#: Hubs whose minima may be broadcast (16 bytes each), and the least number of edges of one.
MOST_HUBS, LEAST_HUB = 100_000, 256


def _stars(edges: DataFrame, partners: Column, n: int) -> DataFrame:
    """(u, v, m) for edges u-v, at most 2 * n of them; m: the least of u and all its v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hub = F.col("n") > max(LEAST_HUB, 2 * n // MOST_HUBS)
    hubs = least.filter(hub).select("u", F.col("m").alias("hub"))
    marked = edges.join(F.broadcast(hubs), "u", "left")
    others = marked.filter("hub is null").drop("hub").join(least.filter(~hub).select("u", "m"), "u")
    stars = others.union(marked.filter("hub is not null").select("u", "v", "hub"))
    return stars.select("u", "v", F.least("u", "m").alias("m")).filter(partners)


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _stars(both, F.col("v") > F.col("u"), n).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    stars = _stars(down, F.lit(True), n)
    kept = stars.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.union(stars.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges``; root: the least node of its component.

    ``edges`` has two long columns, in any order, with repeats and loops allowed; rows with a null
    end are ignored. A node whose only edge is a loop doesn't appear. Empty edges give no rows.
    """
    a, b = edges.columns[:2]
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct()
    now = written(now, "edges")
    before = None
    for _ in range(most_rounds):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == before or not seen[0]:
            break
        before = seen
        now = written(_small_star(_large_star(now, seen[0]), seen[0]), "edges", replaces=now)
    else:
        raise RuntimeError(f"components didn't settle within {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
