"""Fetch and retry plans, and the short list of pages to render."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import url as U
from ..functions.classify import is_browse_jobs
from ..rules import FINAL, Rules
from .skew import ranked


def fetch_schedule(frontier: DataFrame, delay: float) -> DataFrame:
    """Planned start per URL: ``delay`` seconds apart within a host.

    Hosts are ranked without gathering one in a task: a host may own a third of
    the frontier.
    """
    hosts = frontier.withColumn("host", U.url_domain("url"))
    order = [F.desc("priority"), F.asc("added_at"), F.asc("url")]
    return ranked(hosts, order, ["host"]).select(
        "url", "host", ((F.col("rn") - 1) * F.lit(delay)).alias("start_after")
    )


def retry_schedule(
    crawl_log: DataFrame, delay: float = 1.0, backoff: float = 2.0, max_retries: int = 3
) -> DataFrame:
    """Wait after each failed attempt; none once the retries are used up."""
    failures = crawl_log.filter(
        F.col("error_message").isNotNull() & (F.col("error_message") != "")
    ).select("url", "attempt_id", "fetched_at")
    numbered = ranked(failures, [F.asc("fetched_at"), F.asc("attempt_id")], ["url"], "failure_no")
    gave_up = F.col("failure_no") > max_retries
    return numbered.select(
        "attempt_id",
        "url",
        "failure_no",
        F.when(
            ~gave_up, F.lit(delay) * F.pow(F.lit(backoff), (F.col("failure_no") - 1).cast("double"))
        ).alias("wait"),
        gave_up.alias("gave_up"),
    )


RENDER_QUOTA = {"base": 1, "category": 3, "location": 3, "other": 5}

def topk_per_class(
    discovered: DataFrame, rules: Rules = FINAL, below: int | None = None
) -> DataFrame:
    """The few dynamic URLs worth rendering, by class and quota, in URL order.

    With ``below``, only while fewer URLs than that are known. Spark cuts each class to its quota before the shuffle (WindowGroupLimit).
    """
    browse = is_browse_jobs("url")
    category = F.contains("url", F.lit("category="))
    location = F.contains("url", F.lit("location="))
    cls = (
        F.when(~browse, "other")
        .when(F.col("url").endswith("/browse-jobs"), "base")
        .when(category & ~location, "category")
        .when(location & ~category, "location")
    )
    picked = discovered.filter(U.is_dynamic_url("url", rules)).select(
        "url", cls.alias("render_class")
    )
    if below is not None:
        known = discovered.agg(F.count(F.lit(1)).alias("n")).scalar()
        picked = picked.filter(known < below)
    by_class = Window.partitionBy("render_class").orderBy("url")
    quota = F.lit(0)
    for name, k in RENDER_QUOTA.items():
        quota = F.when(F.col("render_class") == name, k).otherwise(quota)
    return (
        picked.filter(F.col("render_class").isNotNull())
        .withColumn("rn", F.row_number().over(by_class))
        .filter(F.col("rn") <= max(RENDER_QUOTA.values()))
        .filter(F.col("rn") <= quota)
    )
