"""Connected components of a link table, by alternating large and small stars.

Every node ends up linked to the smallest node of its component. A round is two aggregations
and two joins; rounds grow with the logarithm of the number of nodes, and links between a hub and
its neighbours need one or two. Hubs are split by Spark's skew join. Nothing reaches the driver
but a count and a sum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.session import materialize


def _print(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of (u, v) that is not the smallest of its component; nulls and loops are left out."""
    links = materialize(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links"
    )
    before = None
    while (now := _print(links)) != before:
        before = now
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("w")), F.struct(F.col("v").alias("u"), F.col("m").alias("w")))).alias("e"))
        links = materialize(small.select("e.u", F.col("e.w").alias("v")).where("u <> v").distinct(), "small")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
