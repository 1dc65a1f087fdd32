"""Row filters over candidates, registries and fetch logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import url as U
from ..rules import Rules, STANDARD
from .skew import HOT_ROWS, lookup_join


def filter_candidates(links: DataFrame, rules: Rules = STANDARD) -> DataFrame:
    """Links on an own host, not skipped, not to the page itself."""
    return links.filter(
        U.is_target_domain("dst_url", rules)
        & ~U.should_skip_url("dst_url", rules)
        & (F.col("dst_url") != U.normalize("src_url", rules))
    )


def valid_urls(registry: DataFrame) -> DataFrame:
    return registry.filter(
        (F.col("crawl_status") == "success") & F.col("status_code").between(200, 399)
    )


def valid_urls_final(results: DataFrame) -> DataFrame:
    return results.filter(
        (F.col("status_code") == 200) & (F.coalesce("error_message", F.lit("")) == "")
    )


def route(urls: DataFrame, rules: Rules = STANDARD, dynamic_enabled: bool = True) -> DataFrame:
    """Tag each URL with the way it is to be fetched; one pass, no split."""
    dynamic = U.is_dynamic_url("url", rules) & F.lit(dynamic_enabled)
    return urls.withColumn("route", F.when(dynamic, "dynamic").otherwise("static"))


def links_in_corpus(links: DataFrame, pages: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Links whose target page is in the corpus; a much-linked page may be hot."""
    known = pages.select(U.url_normalize("url").alias("_page_url")).distinct()
    return lookup_join(
        links, known, "dst_url", "_page_url", "left_semi", ["src_url"], hot_rows
    )
