"""Structured Streaming over arriving fetch-log files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import classify as C
from ..functions import url as U
from ..operators.registry import apply_results, latest_result, pending_rows


def read_events(spark: SparkSession, folder: str, files: str, schema, per_batch: int | None = None) -> DataFrame:
    """New files of a folder as a stream, ``per_batch`` of them at a time or all there are."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    return (reader if per_batch is None else reader.option("maxFilesPerTrigger", per_batch)).parquet(folder)


class BatchStore:
    """Micro-batches reduced to small tables, each under its batch number.

    A replayed batch overwrites itself; what the stream has come to is read from the
    stored tables, so the last rows to arrive count as soon as their batch is written.
    ``fold`` merges what is stored into one table and removes its batches, so that what is kept
    grows with the result and not with the number of batches.
    """

    SCHEMA = ""

    def __init__(self, spark: SparkSession, folder: str, name: str):
        self.spark = spark
        self.path = f"{folder}/{name}"
        self.folds = f"{folder}/{name}-folds"
        self.offsets = f"{folder}/{name}-offsets"

    def reduce(self, batch: DataFrame) -> DataFrame:
        raise NotImplementedError

    def merge(self, stored: DataFrame) -> DataFrame:
        """Rows of many batches as those of one."""
        raise NotImplementedError

    def _files(self, path: str):
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()), jpath

    def _numbers(self, pattern: str) -> list[int]:
        fs, jpath = self._files(pattern)
        return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in fs.globStatus(jpath) or [])

    def folded(self) -> int:
        """The last batch of the newest complete fold; -1 for none."""
        return max(self._numbers(f"{self.folds}/fold=*/_SUCCESS"), default=-1)

    def stored(self) -> DataFrame:
        """Rows of the newest fold and of the batches after it."""
        last = self.folded()
        waiting = [n for n in self._numbers(f"{self.path}/batch_id=*/_SUCCESS") if n > last]
        paths = [f"{self.path}/batch_id={n}" for n in waiting]
        if last >= 0:
            paths.append(f"{self.folds}/fold={last}")
        return self.spark.read.schema(self.SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], self.SCHEMA)

    def fold(self) -> int:
        """Merge all complete batches into a new fold; returns the number of the last one.

        The fold counts from the moment it is complete; until then its batches do. What it
        replaces is removed afterwards, so a fold that breaks off loses nothing. A stream whose batches are folded must not
        be running, for its next batch could be the replay of a folded one.
        """
        batches = self._numbers(f"{self.path}/batch_id=*/_SUCCESS")
        before = self.folded()
        last = max([before, *batches])
        if last > before:
            self.merge(self.stored()).write.mode("overwrite").parquet(f"{self.folds}/fold={last}")
        for old in [f"{self.path}/batch_id={n}" for n in batches if n <= last] + [
            f"{self.folds}/fold={n}" for n in self._numbers(f"{self.folds}/fold=*/_SUCCESS") if n < last
        ]:
            fs, jpath = self._files(old)
            fs.delete(jpath, True)
        return last

    def write_batch(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id > self.folded():  # a replay of what is folded is there already
            self.reduce(batch).write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")

    def start(self, rows: DataFrame) -> StreamingQuery:
        return (
            rows.writeStream.foreachBatch(self.write_batch)
            .option("checkpointLocation", self.offsets)
            .trigger(availableNow=True)
            .start()
        )


class ProgressStream(BatchStore):
    """Per window: fetches and how many succeeded, over all batches, late rows included."""

    SCHEMA = "window_start timestamp, crawled bigint, succeeded bigint"

    def __init__(self, spark: SparkSession, folder: str, width: str = "1 hour"):
        super().__init__(spark, folder, "progress")
        self.width = width

    def reduce(self, batch: DataFrame) -> DataFrame:
        ok = C.crawl_status("status_code", "error_message") == "success"
        return (
            batch.groupBy(F.window("fetched_at", self.width).alias("w"))
            .agg(F.count(F.lit(1)).alias("crawled"), F.count_if(ok).alias("succeeded"))
            .select(F.col("w.start").alias("window_start"), "crawled", "succeeded")
        )

    def merge(self, stored: DataFrame) -> DataFrame:
        sums = [F.sum(c).alias(c) for c in ("crawled", "succeeded")]
        return stored.groupBy("window_start").agg(*sums)

    def windows(self) -> DataFrame:
        """A batch has a row per window at most, so this sums few rows."""
        rate = F.col("succeeded") / F.col("crawled") * 100
        return self.merge(self.stored()).withColumn("success_rate", rate)


class FirstSeenStream(BatchStore):
    """Each normalised URL once, with its earliest fetch, however it is spread over batches."""

    SCHEMA = "url string, first_seen timestamp"

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, folder, "urls")

    def reduce(self, batch: DataFrame) -> DataFrame:
        seen = F.min("fetched_at").cast("timestamp").alias("first_seen")
        return batch.groupBy(U.url_normalize("url").alias("url")).agg(seen)

    def merge(self, stored: DataFrame) -> DataFrame:
        return stored.groupBy("url").agg(F.min("first_seen").alias("first_seen"))

    def urls(self) -> DataFrame:
        return self.merge(self.stored())


def closed_windows(log: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Per window fetches and successes, once no row of it can come any more: for append mode.

    ``log`` is a stream. The state holds the windows that are open within ``delay`` and is dropped with them;
    rows later than that, by the times of the batches before, are left out.
    """
    ok = C.crawl_status("status_code", "error_message") == "success"
    timed = log.withColumn("fetched_at", F.col("fetched_at").cast("timestamp")).withWatermark("fetched_at", delay)
    return (
        timed.groupBy(F.window("fetched_at", width).alias("w"))
        .agg(F.count(F.lit(1)).alias("crawled"), F.count_if(ok).alias("succeeded"))
        .select(F.col("w.start").alias("window_start"), "crawled", "succeeded")
    )


def recent_urls(log: DataFrame, delay: str) -> DataFrame:
    """Each normalised URL once within ``delay``; the state forgets a URL that long after it was seen."""
    timed = log.withColumn("fetched_at", F.col("fetched_at").cast("timestamp")).withWatermark("fetched_at", delay)
    return timed.select(U.url_normalize("url").alias("url"), "fetched_at").dropDuplicatesWithinWatermark(["url"])


def run_to_files(rows: DataFrame, folder: str) -> StreamingQuery:
    """Append a stream's rows to Parquet files below ``folder``, all that is there now."""
    return (
        rows.writeStream.format("parquet")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/offsets")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


class RegistryStream:
    """Registry upkeep from a stream of fetch results.

    A micro-batch is reduced to one row per URL and stored under its batch number;
    a replayed batch overwrites itself. The registry is the base table merged with
    those rows when read, so a batch costs its own size, not that of the registry.
    ``compact`` folds the rows into a new base.
    """

    LOG = (
        "url string, attempt_id bigint, fetched_at timestamp, status_code int, "
        "content_type string, error_message string, is_dynamic boolean, "
        "response_time double, first_seen timestamp"
    )

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.log_path = f"{folder}/results"
        self.marker = f"{folder}/folded"
        self.offsets = f"{folder}/offsets"

    def write_batch(self, batch: DataFrame, batch_id: int) -> None:
        normalized = batch.withColumn("url", U.url_normalize("url")).withColumn(
            "fetched_at", F.col("fetched_at").cast("timestamp")
        )
        rest = [c for c in normalized.columns if c != "url"]
        latest = normalized.groupBy("url").agg(
            F.max_by(F.struct(*rest), F.struct("fetched_at", "attempt_id")).alias("_row"),
            F.min("fetched_at").alias("first_seen"),
        )
        latest.select("url", *(F.col("_row")[c].alias(c) for c in rest), "first_seen").write.mode(
            "overwrite"
        ).parquet(f"{self.log_path}/batch_id={batch_id}")

    def start(self, crawl_log: DataFrame) -> StreamingQuery:
        return (
            crawl_log.writeStream.foreachBatch(self.write_batch)
            .option("checkpointLocation", self.offsets)
            .trigger(availableNow=True)
            .start()
        )

    def folded(self) -> int:
        """Number of the last batch that ``compact`` has folded in; -1 for none."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.marker)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return -1
        return self.spark.read.schema("batch_id bigint").parquet(self.marker).first().batch_id

    def results(self) -> DataFrame:
        """What has arrived since the last ``compact``."""
        log = self.spark.read.schema(self.LOG + ", batch_id bigint").parquet(self.log_path)
        return log.filter(F.col("batch_id") > self.folded())

    def registry(self, base: DataFrame) -> DataFrame:
        """``base`` with unknown URLs added and every URL's latest result applied.

        A result counts only if it is newer than the fetch that the base knows.
        """
        log = self.results()
        per_url = log.groupBy("url").agg(
            F.max_by(
                F.struct(
                    "attempt_id", "fetched_at", "status_code", "content_type",
                    "error_message", "is_dynamic", "response_time",
                ),
                F.struct("fetched_at", "attempt_id"),
            ).alias("_row"),
            F.min("first_seen").alias("added_at"),
        )
        flat = per_url.select("url", "_row.*", "added_at")
        fresh = flat.join(base.select("url"), "url", "left_anti").select(
            "url",
            "added_at",
            "is_dynamic",
            F.lit(0).alias("depth"),
            F.lit(None).cast("string").alias("parent_url"),
        )
        last = base.select("url", F.col("last_crawled").alias("_last"))
        newer = flat.join(last, "url", "left").filter(
            F.col("_last").isNull() | (F.col("fetched_at") > F.col("_last"))
        )
        return apply_results(base.unionByName(pending_rows(fresh)), newer)

    def compact(self, base: DataFrame, path: str) -> DataFrame:
        """Write the merged registry to a new path, retire its batches, and return it."""
        merged = self.registry(base)
        last = self.results().agg(F.max("batch_id").alias("batch_id"))
        merged.write.mode("error").parquet(path)
        if last.first().batch_id is not None:
            last.coalesce(1).write.mode("overwrite").parquet(self.marker)
        return self.spark.read.schema(merged.schema).parquet(path)


class PatternStream:
    """First URL of each pattern over a stream: later ones are likely duplicates.

    A micro-batch is reduced to one URL per pattern and compared with the patterns
    of earlier batches; a replayed batch overwrites itself.
    """

    FIRSTS = "pattern string, url string, batch_id bigint"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.path = f"{folder}/patterns"
        self.offsets = f"{folder}/pattern-offsets"

    def firsts(self) -> DataFrame:
        return self.spark.read.schema(self.FIRSTS).parquet(self.path)

    def write_batch(self, batch: DataFrame, batch_id: int) -> None:
        fresh = batch.groupBy(C.url_pattern("url").alias("pattern")).agg(F.min("url").alias("url"))
        if batch_id > 0:
            known = self.firsts().filter(F.col("batch_id") < batch_id).select("pattern")
            fresh = fresh.join(known, "pattern", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")

    def start(self, urls: DataFrame) -> StreamingQuery:
        return (
            urls.writeStream.foreachBatch(self.write_batch)
            .option("checkpointLocation", self.offsets)
            .trigger(availableNow=True)
            .start()
        )


def registry_of_batch(crawl_log: DataFrame, base: DataFrame) -> DataFrame:
    """The end state of ``RegistryStream`` computed in one batch."""
    log = crawl_log.withColumn("url", U.url_normalize("url"))
    latest = latest_result(log)
    seen = log.groupBy("url").agg(F.min("fetched_at").cast("timestamp").alias("added_at"))
    fresh = latest.join(seen, "url").join(base.select("url"), "url", "left_anti").select(
        "url",
        "added_at",
        "is_dynamic",
        F.lit(0).alias("depth"),
        F.lit(None).cast("string").alias("parent_url"),
    )
    return apply_results(base.unionByName(pending_rows(fresh)), latest)
