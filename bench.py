"""Headline timings. Prints one JSON line.

Each query is run once to warm up on the smallest data and then timed once on
``$BENCH_SF_DIR`` with its whole result written to Spark's no-op sink.
``sitemap_50k`` builds, numbers and writes a sitemap of 50,000 URLs generated from
the origins of the corpus: the one figure the published baseline can be held to.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sitewright.operators import generate as G  # noqa: E402
from sitewright.operators import sitemap as S  # noqa: E402
from sitewright.plans.derived import Inputs  # noqa: E402
from sitewright.plans.queries import BASE, all_queries, dimensions_of, now, origins_of  # noqa: E402
from sitewright.session import local_session, work_path  # noqa: E402
from sitewright.sources import sitemap_files as X  # noqa: E402

HEADLINE = (
    "extract_links", "extract_links_fast", "extract_links_final", "extract_links_rendered",
    "links_script", "links_pagination", "page_metadata", "page_text", "url_normalize",
    "classify_url_type", "registry_add", "registry_mark_crawled", "process_results",
    "latest_result", "new_urls", "parent_lineage", "links_in_corpus", "robots_allowed",
    "fetch_schedule", "retry_schedule", "pattern_first", "topk_per_class", "chunk_sitemaps",
    "build_sitemap", "write_sitemap", "validate_sitemap", "gen_all", "union_strategies",
    "discovery_by_strategy", "bfs_depth", "crawl_stats", "final_stats", "snapshot_delta",
    "stream_registry", "stream_progress",
)
WARM_UP = "/root/testdata/sf0.001"
SITEMAP_ROWS = 50_000


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def sitemap_50k(spark: SparkSession, sf_dir: str) -> str:
    """Registry rows to sitemap, index and robots files, 50,000 URLs."""
    t = Inputs(spark, sf_dir)
    urls = G.candidates(origins_of(t), dimensions_of(t), G.all_paths).select("url")
    more = urls.select(F.concat("url", F.lit("-2")).alias("url"))
    third = urls.select(F.concat("url", F.lit("-3")).alias("url"))
    registry = (
        urls.union(more)
        .union(third)
        .limit(SITEMAP_ROWS)
        .withColumn("last_crawled", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    )
    out = work_path(spark, "bench-site")
    X.write_site(S.build_entries(registry), out, BASE, now())
    return out


def check_site(spark: SparkSession, out: str, sf_dir: str) -> None:
    """What was timed must be whole: every file valid, and all rows in them."""
    report = X.validate_sitemaps(spark, f"{out}/sitemap*.xml").collect()
    assert report and all(r.valid for r in report), report
    rows = sum(r.urls for r in report if r.kind == "urlset")
    assert rows == SITEMAP_ROWS or sf_dir == WARM_UP, rows


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "sitewright-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    runs = {name: (lambda d, q=queries[name]: drain(q(spark, d))) for name in HEADLINE}
    runs["sitemap_50k"] = lambda d: sitemap_50k(spark, d)
    timings = {}
    for name, run in runs.items():
        run(WARM_UP if os.path.isdir(WARM_UP) else sf_dir)
        start = time.perf_counter()
        out = run(sf_dir)
        timings[name] = round(time.perf_counter() - start, 3)
        if out is not None:
            check_site(spark, out, sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
