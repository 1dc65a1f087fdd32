"""Crawl statistics: one pass each, partial aggregates before any shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C


def crawl_stats(registry: DataFrame) -> DataFrame:
    status = F.col("crawl_status")
    success = status == "success"
    counts = registry.agg(
        F.count(F.lit(1)).alias("total_urls_discovered"),
        F.count_if(success).alias("successful_crawls"),
        F.count_if(status == "error").alias("failed_crawls"),
        F.count_if(status == "skipped").alias("skipped_urls"),
        F.count_if(success & F.col("is_dynamic")).alias("dynamic_pages_crawled"),
        F.count_if(success & ~F.col("is_dynamic")).alias("static_pages_crawled"),
    )
    return counts.withColumn(
        "total_urls_crawled",
        F.col("successful_crawls") + F.col("failed_crawls") + F.col("skipped_urls"),
    )


def status_counts(registry: DataFrame) -> DataFrame:
    return registry.groupBy("crawl_status").agg(F.count(F.lit(1)).alias("urls"))


def dynamic_counts(registry: DataFrame) -> DataFrame:
    return (
        registry.filter(F.col("crawl_status") == "success")
        .groupBy("is_dynamic")
        .agg(F.count(F.lit(1)).alias("urls"))
    )


def queue_size(frontier: DataFrame) -> DataFrame:
    return frontier.agg(
        F.count_if(~F.col("is_processing")).alias("queue_size"),
        F.count(F.lit(1)).alias("pending"),
    )


def rates(registry: DataFrame) -> DataFrame:
    """``success_rate``: of crawled; ``coverage_rate``: crawled of discovered."""
    s = crawl_stats(registry)
    return s.select(
        C.success_rate(F.col("successful_crawls"), F.col("total_urls_crawled")).alias("success_rate"),
        C.coverage_rate(F.col("total_urls_crawled"), F.col("total_urls_discovered")).alias(
            "coverage_rate"
        ),
    )


def throughput(crawl_log: DataFrame) -> DataFrame:
    seconds = (
        F.unix_micros(F.max("fetched_at").cast("timestamp"))
        - F.unix_micros(F.min("fetched_at").cast("timestamp"))
    ) / F.lit(1_000_000.0)
    return crawl_log.agg(
        F.count(F.lit(1)).alias("crawled"), seconds.alias("seconds")
    ).withColumn(
        "urls_per_second",
        F.when(F.col("seconds") > 0, F.col("crawled") / F.col("seconds")).otherwise(F.lit(0.0)),
    )


def final_stats(discovered: DataFrame, results: DataFrame) -> DataFrame:
    """Totals over distinct URLs: one row per side, put side by side."""
    d = discovered.select("url").distinct()
    found = d.agg(
        F.count(F.lit(1)).alias("total_discovered"),
        F.count_if(C.is_job_related("url")).alias("job_related_urls"),
        F.count_if(C.is_browse_jobs("url")).alias("browse_jobs_urls"),
    )
    failed = F.coalesce(F.col("error_message"), F.lit("")) != ""
    micros = F.unix_micros(F.col("fetched_at").cast("timestamp"))
    per_url = results.groupBy("url").agg(
        F.max(failed).alias("failed"), F.min(micros).alias("first"), F.max(micros).alias("last")
    )
    totals = per_url.agg(
        F.struct(
            F.count(F.lit(1)).alias("crawled"),
            F.count_if("failed").alias("failed"),
            ((F.max("last") - F.min("first")) / F.lit(1_000_000.0)).alias("seconds"),
        ).alias("t")
    ).scalar()
    return (
        found.withColumn("t", totals)
        .select(
            "total_discovered",
            F.col("t.crawled").alias("total_crawled"),
            F.col("t.failed").alias("total_failed"),
            "job_related_urls",
            "browse_jobs_urls",
            C.coverage_rate(F.col("t.crawled"), F.col("total_discovered")).alias("success_rate"),
            F.col("t.seconds").alias("total_time"),
            (F.col("t.crawled") / F.greatest("t.seconds", F.lit(1.0))).alias("urls_per_second"),
        )
    )


def depth_breakdown(registry: DataFrame) -> DataFrame:
    """Per depth: URLs, how many were fetched, and the seconds between first and last fetch."""
    last, first = F.max("last_crawled"), F.min("last_crawled")
    return registry.groupBy("depth").agg(
        F.count(F.lit(1)).alias("urls"),
        F.count("last_crawled").alias("crawled"),
        (
            (F.unix_micros(last.cast("timestamp")) - F.unix_micros(first.cast("timestamp")))
            / F.lit(1_000_000.0)
        ).alias("seconds"),
    )


def pattern_counts(urls: DataFrame) -> DataFrame:
    return urls.groupBy(C.url_pattern("url").alias("pattern")).agg(
        F.count(F.lit(1)).alias("urls")
    )
