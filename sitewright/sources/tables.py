"""Schemas of the stored tables and their scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import is_html

PAGES = "page_id bigint, url string, html string"
CRAWL_LOG = (
    "attempt_id bigint, url string, fetched_at timestamp, status_code int, "
    "content_type string, error_message string, is_dynamic boolean, response_time double"
)
URL_REGISTRY = (
    "url string, discovered_at timestamp, last_crawled timestamp, status_code int, "
    "content_type string, is_dynamic boolean, depth int, parent_url string, "
    "crawl_status string, error_message string, response_time double, updated_at timestamp"
)
FRONTIER = "url string, priority int, added_at timestamp, is_processing boolean"
CRAWL_STATUSES = ("pending", "crawling", "success", "error", "skipped")


def scan(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table with its declared types."""
    return spark.read.schema(schema).parquet(path)


def scan_pages(fetched: DataFrame, body_limit: int | None = None) -> DataFrame:
    """Pages with a body where the content type is HTML, an empty one elsewhere.

    Bodies are kept whole; ``body_limit`` cuts them to that many characters.
    """
    body = F.col("html") if body_limit is None else F.substring("html", 1, body_limit)
    return fetched.select(
        "page_id", "url", F.when(is_html("content_type"), body).otherwise("").alias("html")
    )


def empty_table(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def reset_registry(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Registry and frontier without rows, to overwrite the stored ones with."""
    return empty_table(spark, URL_REGISTRY), empty_table(spark, FRONTIER)


def export_registry_rows(registry: DataFrame) -> DataFrame:
    """Rows of the debugging export; a missing or zero status prints ``N/A``."""
    code = F.coalesce(F.nullif(F.col("status_code"), F.lit(0)).cast("string"), F.lit("N/A"))
    return registry.select(
        F.col("url").alias("URL"),
        F.col("crawl_status").alias("Status"),
        code.alias("HTTP Code"),
        F.col("depth").alias("Depth"),
        F.col("is_dynamic").cast("int").alias("Dynamic"),
    ).orderBy("Depth", "URL")


def export_registry_tsv(registry: DataFrame, path: str) -> None:
    export_registry_rows(registry).write.mode("overwrite").csv(path, sep="\t", header=True)
