from datetime import datetime

from pyspark.sql import functions as F

from sitewright.functions import classify as C
from sitewright.functions import html as H
from sitewright.rules import FAST

SITE = "https://www.example.com"
TYPES = {
    "": ("homepage", 1.0, "daily"),
    "/": ("homepage", 1.0, "daily"),
    "/jobs": ("job_listing", 0.8, "daily"),
    "/jobs/123": ("individual_job", 0.6, "daily"),
    "/jobs-in-london": ("location_page", 0.7, "weekly"),
    "/company/abc": ("company_page", 0.7, "weekly"),
    "/news/x": ("blog_post", 0.5, "monthly"),
    "/sector/x": ("main_category", 0.9, "daily"),
    "/banking-jobs-in-x": ("default", 0.5, "weekly"),
    "/about": ("default", 0.5, "weekly"),
}


def rows(spark, values, *columns, schema="i int, x string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], schema)
    return [tuple(r) for r in df.orderBy("i").select(*columns).collect()]


def test_type_priority_changefreq(spark):
    got = rows(
        spark, [SITE + p for p in TYPES],
        C.classify_url_type("x"), C.url_priority("x"), C.url_changefreq("x"),
    )
    assert got == list(TYPES.values())


def test_final_and_fast_priorities(spark):
    urls = [SITE + "/", SITE + "/Browse-Jobs?x", SITE + "/job/1", SITE + "/about"]
    assert rows(spark, urls, C.url_priority_final("x", SITE), C.url_changefreq_final("x")) == [
        (1.0, "weekly"), (0.9, "daily"), (0.8, "daily"), (0.5, "weekly")]
    assert rows(spark, urls, C.url_priority_fast("x", FAST)) == [(0.5,)] * 4


def test_url_pattern(spark):
    urls = [SITE + p for p in (
        "/browse-jobs?category=a&location=b", "/browse-jobs?category=a&location=",
        "/browse-jobs?location=b", "/browse-jobs?x=1", "/a/b?q", "/BROWSE-JOBS?category=x")]
    assert [r[0] for r in rows(spark, urls, C.url_pattern("x"))] == [
        "browse-jobs-category-location", "browse-jobs-category", "browse-jobs-location",
        "browse-jobs-base", "/a/b", "browse-jobs-category"]


def test_frontier_priority(spark):
    got = spark.range(13).orderBy("id").select(C.frontier_priority("id")).collect()
    assert [r[0] for r in got] == [100, 90, 80, 70, 60, 50, 40, 30, 20, 10, 0, 0, 0]


def test_crawl_status(spark):
    df = spark.createDataFrame(
        [(200, None), (301, ""), (404, None), (200, "bad"), (0, "timeout"), (400, None)],
        "c int, e string",
    )
    assert [r[0] for r in df.select(C.crawl_status("c", "e")).collect()] == [
        "success", "success", "error", "error", "error", "error"]


def test_content_types(spark):
    values = ["text/html; charset=utf-8", " TEXT/HTML ", "", None, "application/xhtml+xml", "image/png"]
    assert rows(spark, values, C.content_type_main("x"), C.is_html("x"), C.is_html_final("x")) == [
        ("text/html", True, True), ("text/html", True, False), ("unknown", False, False),
        ("unknown", False, False), ("application/xhtml+xml", True, False), ("image/png", False, False)]


def test_clean_text(spark):
    values = ["  a \n\t b\x00c ", "", None, " x y"]
    assert [r[0] for r in rows(spark, values, H.clean_text("x"))] == ["a bc", "", "", "x y"]


def test_lastmod(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 2, 3, 4, 5),), (None,)], "t timestamp_ntz")
    assert [r[0] for r in df.select(C.iso_lastmod("t")).collect()] == ["2024-01-02T03:04:05+00:00", None]


def test_rates(spark):
    one = spark.range(1)
    assert one.select(C.success_rate(F.lit(70), F.lit(80))).first()[0] == 87.5
    assert one.select(C.success_rate(F.lit(0), F.lit(0))).first()[0] == 0.0
    assert one.select(C.coverage_rate(F.lit(80), F.lit(100))).first()[0] == 80.0
