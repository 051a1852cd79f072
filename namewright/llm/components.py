"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is two grouped minima and equi-joins over the links; nothing is gathered on the driver but a count and a checksum
a round. A node with very many links is pre-aggregated before its minimum is shuffled, and the join back to its links is
one that adaptive execution may split. Rounds needed grow with the logarithm of a component's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, stage_table


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(low.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """links: u, v (of one type, not null). Returns (node, root) for every node of a link except the roots themselves;
    the root is the smallest node of the component. Links to itself and repeated links are harmless."""
    e = stage_table(links.select("u", "v").where("u <> v").distinct(), "links")
    mark = None
    while True:
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("x")).first()
        if now["n"] == 0 or now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark, old = now, e
        e = stage_table(_small_star(_large_star(e)), "links", like=old)
        drop_staged(old)
