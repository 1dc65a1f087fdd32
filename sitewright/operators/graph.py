"""Breadth-first discovery over the link graph."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Edges of one source that a task may hold before the source is split.
EDGES_PER_TASK = 100_000
#: Larger tables of nodes are shuffled, not broadcast: each level passes what it broadcasts through the driver.
BROADCAST_ROWS = 20_000


def _joined_by(nodes: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(nodes) if rows <= BROADCAST_ROWS else nodes.hint("merge")


def bfs_depth(
    seeds: DataFrame,
    links: DataFrame,
    max_depth: int | None,
    also: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Least number of hops from a seed: ``(node, depth)``, up to ``max_depth``,
    or until a level brings nothing new.

    ``also`` may name further nodes, as ``(node)``, that a level leads to without an
    edge of its own.

    ``seeds(node)``, ``links(src, dst)``. Edges are written once to the shared folder,
    each with the number of shares its source is dealt into, so a source with very
    many links is split in proportion; each level is written there before the next
    one starts, and its number of rows decides the join.
    """
    distinct = materialize(links.select("src", "dst"), "edges")
    hot = (
        distinct.groupBy("src")
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > EDGES_PER_TASK)
        .select("src", F.ceil(F.col("_n") / EDGES_PER_TASK).cast("int").alias("_shares"))
    )
    hot = materialize(hot, "hubs")
    one = F.lit(1)
    edges = (
        distinct.join(hot, "src", "left")
        .withColumn("_salt", F.pmod(F.xxhash64("dst"), F.coalesce("_shares", one)).cast("int"))
        .select("src", "_salt", "dst")
    )
    edges = materialize(edges, "edges")
    level = materialize(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "bfs")
    seen, rows = level, level.count()
    known = rows
    for depth in range(1, max_depth + 1) if max_depth is not None else count(1):
        reach = (
            level.select(F.col("node").alias("src"))
            .join(hot, "src", "left")
            .select("src", F.explode(F.sequence(F.lit(0), F.coalesce("_shares", one) - 1)).alias("_salt"))
        )
        nodes = edges.join(_joined_by(reach, rows), ["src", "_salt"]).select(F.col("dst").alias("node"))
        if also is not None:
            nodes = nodes.unionByName(also(level))
        found = (
            nodes.distinct()
            .join(_joined_by(seen.select("node"), known), "node", "left_anti")
            .withColumn("depth", F.lit(depth))
        )
        level = materialize(found, "bfs")
        rows = level.count()
        if not rows:
            break
        known += rows
        seen = seen.unionByName(level)
    return seen
