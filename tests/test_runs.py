from datetime import datetime

from pyspark.sql import functions as F

from sitewright.operators import generate as G
from sitewright.plans import runs
from sitewright.sources import tables
from sitewright.streaming import jobs

SITE = "https://www.example.com"
GRAPH = {
    "/": ["/a", "/b", "/x.pdf"],
    "/a": ["/", "/c", "/jobs"],
    "/b": ["/c", "/lost"],
    "/c": ["/d/"],
    "/d": ["/e"],
    "/jobs": ["/browse-jobs"],
    "/broken": ["/never"],
}
CODES = {"/b": (404, None), "/c": (0, "timeout")}


def corpus(spark):
    pages = [
        (i, SITE + p, "".join(f"<a href='{h}'>x</a>" for h in links))
        for i, (p, links) in enumerate(GRAPH.items())
    ]
    log = [
        (i, SITE + p, datetime(2024, 1, 1, 0, i), *(CODES.get(p, (200, None))[:1]), "text/html",
         CODES.get(p, (200, None))[1], False, 0.1)
        for i, p in enumerate(GRAPH)
    ]
    return spark.createDataFrame(pages, tables.PAGES), spark.createDataFrame(log, tables.CRAWL_LOG)


def seeds(spark):
    return spark.createDataFrame([(SITE + "/",)], "url string")


def test_crawl_by_levels(spark, tmp_path):
    pages, log = corpus(spark)
    state = runs.crawl(seeds(spark), runs.results_of(pages, log), "2024-01-01", path=str(tmp_path / "crawl"))
    got = {r.url.replace(SITE, ""): (r.depth, r.crawl_status) for r in state.registry.collect()}
    assert got == {
        "/": (0, "success"), "/a": (1, "success"), "/b": (1, "error"), "/c": (2, "error"),
        "/jobs": (2, "success"), "/lost": (2, "pending"), "/d": (3, "success"),
        "/browse-jobs": (3, "pending"), "/e": (4, "pending")}
    waiting = sorted(r.url.replace(SITE, "") for r in state.frontier.collect())
    assert waiting == ["/browse-jobs", "/e", "/lost"]
    report = runs.publish(state, str(tmp_path / "site"), F.lit("2024-06-01").cast("timestamp")).collect()
    assert [(r.file, r.urls, r.valid) for r in report] == [("sitemap.xml", 4, True)]


def test_depth_limit(spark):
    from dataclasses import replace

    from sitewright.rules import STANDARD

    pages, log = corpus(spark)
    results = runs.results_of(pages, log)
    state = runs.crawl(seeds(spark), results, "2024-01-01", replace(STANDARD, max_depth=1))
    assert {r.url.replace(SITE, "") for r in state.registry.collect()} == {"/", "/a", "/b"}


def test_final_run(spark):
    pages, log = corpus(spark)
    d = G.literal_dimensions(spark, ["leeds"], ["banking"])
    run = runs.crawl_final(pages, log, seeds(spark), d)
    depth = {r.url.replace(SITE, ""): r.depth for r in run.discovered.collect()}
    # /c failed, so /d stays unknown; template URLs come with the first page.
    assert depth["/a"] == 1 and depth["/c"] == 1 + 1 and "/d" not in depth
    assert depth["/banking-jobs-in-leeds"] == 1 and depth["/jobs-in-leeds"] == 1
    assert {r.url.replace(SITE, "") for r in run.results.collect()} == {"/", "/a", "/b", "/c", "/jobs"}
    stats = run.stats().first()
    assert stats.total_crawled == 5 and stats.total_failed == 1
    assert stats.total_discovered == len(depth)
    picked = {r.url.replace(SITE, "") for r in run.to_render.collect()}
    assert "/browse-jobs" in picked and len(picked) <= 12
    rendered = run.results.limit(0).select(
        *run.results.columns, F.array().cast("array<string>").alias("discovered_urls"))
    row = [(99, SITE + "/browse-jobs", datetime(2024, 1, 2), 200, "text/html", None, True, 0.5,
            [SITE + "/new", SITE + "/a"]),
           (98, SITE + "/about", datetime(2024, 1, 2), 200, "text/html", None, True, 0.5, [SITE + "/no"])]
    extra = spark.createDataFrame(row, tables.CRAWL_LOG + ", discovered_urls array<string>")
    assert set(rendered.columns) == set(extra.columns)
    more = run.with_rendered(extra)
    known = {r.url.replace(SITE, "") for r in more.discovered.collect()}
    assert known - set(depth) == {"/new"}
    assert SITE + "/browse-jobs" in {r.url for r in more.results.collect()}
    assert SITE + "/about" not in {r.url for r in more.results.collect()}
    locs = {r["loc"] for r in more.entries(F.lit("2024-06-01").cast("timestamp")).collect()}
    assert locs == {SITE + p for p in ("/", "/a", "/jobs", "/browse-jobs")}


def test_pattern_stream_keeps_the_first_batch(spark, tmp_path):
    job = jobs.PatternStream(spark, str(tmp_path))

    def urls(*paths):
        return spark.createDataFrame([(SITE + p,) for p in paths], "url string")

    job.write_batch(urls("/b?2", "/b?1", "/browse-jobs?category=z"), 0)
    job.write_batch(urls("/b?0", "/c", "/browse-jobs?category=a"), 1)
    job.write_batch(urls("/b?0", "/c", "/browse-jobs?category=a"), 1)
    got = sorted((r.pattern, r.url.replace(SITE, ""), r.batch_id) for r in job.firsts().collect())
    assert got == [("/b", "/b?1", 0), ("/c", "/c", 1), ("browse-jobs-category", "/browse-jobs?category=z", 0)]
