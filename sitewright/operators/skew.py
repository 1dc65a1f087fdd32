"""Building blocks that hold when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, shuffle_partitions, will_broadcast

#: Rows of one key that a task may hold before the key is split.
HOT_ROWS = 500_000


#: Rows of one side that a task of a shuffled join sorts, about.
ROWS_PER_TASK = 200_000


def join_parts(df: DataFrame) -> int:
    """Partitions for joins of the stored table ``df``: as many as its rows need, so that a task's memory does not grow with it."""
    return max(shuffle_partitions(df.sparkSession), -(-df.count() // ROWS_PER_TASK))


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(_hot_key, _shares)``: keys of ``hot_rows`` rows or more, and into how many shares they go.

    All of them, however many: at most one for every ``hot_rows`` rows. The list is
    written once, so its real size decides how it is joined.
    """
    hot = (
        df.groupBy(F.col(key).alias("_hot_key"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") >= hot_rows)
        .select("_hot_key", (F.floor(F.col("_n") / hot_rows) + 1).cast("int").alias("_shares"))
    )
    return materialize(hot, "hot")


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    how: str,
    salt_on: list[str],
    hot_rows: int = HOT_ROWS,
    parts: int | None = None,
) -> DataFrame:
    """Join ``left`` to ``right`` (unique on its key), splitting hot left keys.

    Rows of a hot key are dealt by a hash of ``salt_on`` over shares of about
    ``hot_rows`` rows; only the matching right rows are repeated, once per share. A
    right side small enough for Spark to broadcast needs none of it. Column names of
    the two sides must differ. With ``parts`` the join is always a shuffled one, of so many partitions: sizes of
    compressed files say little of what a broadcast table needs in memory.
    """
    if parts is None and will_broadcast(right):
        return left.join(right, F.col(left_key) == F.col(right_key), how)
    hot = hot_keys(left, left_key, hot_rows)
    one = F.lit(1)
    left_salted = (
        left.join(hot, F.col(left_key) == F.col("_hot_key"), "left")
        .withColumn("_ls", F.pmod(F.xxhash64(*salt_on), F.coalesce("_shares", one)).cast("int"))
        .drop("_hot_key", "_shares")
    )
    right_salted = (
        right.join(hot, F.col(right_key) == F.col("_hot_key"), "left")
        .withColumn("_rs", F.explode(F.sequence(F.lit(0), F.coalesce("_shares", one) - 1)))
        .drop("_hot_key", "_shares")
    )
    on = (F.col(left_key) == F.col(right_key)) & (F.col("_ls") == F.col("_rs"))
    if parts is not None:
        left_salted = left_salted.repartition(parts, left_key, "_ls")
        right_salted = right_salted.repartition(parts, right_key, "_rs").hint("merge")
    joined = left_salted.join(right_salted, on, how)
    return joined.drop("_ls", "_rs")


def ranked(
    df: DataFrame, order: list[Column], group: list[str] | None = None, name: str = "rn"
) -> DataFrame:
    """Exact row numbers, from 1, without gathering a group in one task.

    Rows are range-partitioned by group and order, so a large group spans several
    partitions; the placement is written out, and each partition adds the number of
    rows that lie before it. ``order`` must end in a unique key.
    """
    group = group or []
    spark = df.sparkSession
    keys = [F.col(c).asc() for c in group] + order
    placed = materialize(
        df.repartitionByRange(shuffle_partitions(spark), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id() - F.shiftleft(F.col("_pid").cast("long"), 33)),
        "ranked",
    )
    if not group:
        # One row per partition: the window below sees a bounded table.
        sizes = placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
        before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
        return (
            placed.join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.col("_off") + F.col("_pos") + 1)
            .drop("_pid", "_pos", "_off")
        )
    in_part = Window.partitionBy("_pid", *group).orderBy("_pos")
    numbered = placed.withColumn("_rn", F.row_number().over(in_part))
    # Only the first group of a partition can have begun in an earlier one: at most
    # two rows per partition take part in the carried-over counts.
    key = F.struct(*group)
    counts = placed.groupBy("_pid", *group).agg(F.count(F.lit(1)).alias("_n"))
    first = placed.groupBy("_pid").agg(F.min_by(key, "_pos").alias("_key"))
    spanning = counts.join(F.broadcast(first.select("_key").distinct()), key == F.col("_key"))
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = spanning.select(
        "_pid", *group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")
    ).filter(F.col("_off") > 0)
    return (
        numbered.join(F.broadcast(carried), ["_pid", *group], "left")
        .withColumn(name, F.col("_rn") + F.coalesce(F.col("_off"), F.lit(0)))
        .drop("_pid", "_pos", "_rn", "_off")
    )
