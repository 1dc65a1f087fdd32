from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sitewright.operators import filters, registry as R, stats
from sitewright.operators.registry import CrawlState
from sitewright.sources import tables

SITE = "https://www.example.com"
AT = "2024-01-01 00:00:00"
FOUND = "url string, parent_url string, depth int, is_dynamic boolean, priority int, pos bigint"
LOG = "attempt_id bigint, url string, fetched_at timestamp, status_code int, content_type string, error_message string, is_dynamic boolean, response_time double"


@pytest.fixture
def empty(spark):
    return CrawlState(*tables.reset_registry(spark))


def found(spark, *rows):
    data = [(SITE + u, p, d, dyn, pr, i) for i, (u, p, d, dyn, pr) in enumerate(rows)]
    return spark.createDataFrame(data, FOUND).withColumn("added_at", F.lit(AT).cast("timestamp"))


def log(spark, *rows):
    data = [
        (i, SITE + u, datetime(2024, 1, 1, 0, i), code, "text/html", err, False, 0.1)
        for i, (u, code, err) in enumerate(rows)
    ]
    return spark.createDataFrame(data, LOG)


BATCH = [("/test1", None, 1, False, 10), ("/test2", None, 1, True, 20), ("/test3", None, 2, False, 5)]


def test_batch_added_once(spark, empty):
    batch = found(spark, *BATCH)
    state = R.registry_add(empty, batch)
    assert state.registry.count() == 3 and state.frontier.count() == 3
    assert R.new_urls(batch, state.registry).count() == 0


def test_single_add_normalizes(spark, empty):
    state = R.registry_add(empty, found(spark, ("/test/", None, 1, False, 0)))
    again = found(spark, ("/test#x", None, 1, False, 0))
    assert R.new_urls(again, state.registry).count() == 0
    assert [r.url for r in state.registry.collect()] == [SITE + "/test"]


def test_priority_order(spark, empty):
    state = R.registry_add(empty, found(spark, *BATCH))
    assert [r.url for r in R.next_urls(state.frontier, 2).collect()] == [SITE + "/test2", SITE + "/test1"]


def test_marked_leaves_queue(spark, empty):
    state = R.registry_add(empty, found(spark, ("/test", None, 0, False, 0)))
    state = R.mark_crawled(state, log(spark, ("/test", 200, None)))
    assert state.frontier.count() == 0
    row = state.registry.first()
    assert (row.crawl_status, row.status_code, row.content_type) == ("success", 200, "text/html")


def test_statistics(spark, empty):
    state = R.registry_add(empty, found(spark, *BATCH[:2]))
    state = R.mark_crawled(state, log(spark, ("/test1", 200, None), ("/test2", 404, None)))
    s = stats.crawl_stats(state.registry).first()
    assert (s.total_urls_discovered, s.total_urls_crawled, s.successful_crawls, s.failed_crawls) == (2, 2, 1, 1)
    assert s.static_pages_crawled == 1 and s.dynamic_pages_crawled == 0


def test_valid_urls(spark, empty):
    rows = [(u, None, 0, False, 0) for u in ("/valid1", "/valid2", "/invalid")]
    state = R.registry_add(empty, found(spark, *rows))
    state = R.mark_crawled(
        state, log(spark, ("/valid1", 200, None), ("/valid2", 301, None), ("/invalid", 404, None)))
    assert sorted(r.url[-6:] for r in filters.valid_urls(state.registry).collect()) == ["valid1", "valid2"]


def test_queue_size_claim_clear(spark, empty):
    assert stats.queue_size(empty.frontier).first().queue_size == 0
    state = R.registry_add(empty, found(spark, *BATCH[:2]))
    claimed = R.claim(state.frontier, 1)
    assert stats.queue_size(claimed).first().queue_size == 1
    assert [r.url for r in R.next_urls(claimed, 5).collect()] == [SITE + "/test1"]
    assert stats.queue_size(R.clear_processing(claimed)).first().queue_size == 2


def test_latest_attempt_wins(spark, empty):
    state = R.registry_add(empty, found(spark, ("/a", None, 0, False, 0)))
    state = R.mark_crawled(state, log(spark, ("/a", 500, "boom"), ("/a/", 200, ""), ("/other", 200, None)))
    row = state.registry.collect()
    assert len(row) == 1 and row[0].crawl_status == "success" and row[0].error_message == ""


def test_skipped(spark, empty):
    state = R.registry_add(empty, found(spark, *BATCH[:2]))
    skip = spark.createDataFrame([(SITE + "/test1", "robots", AT)], "url string, reason string, at string")
    state = R.mark_skipped(state, skip)
    got = {r.url[-5:]: (r.crawl_status, r.error_message) for r in state.registry.collect()}
    assert got == {"test1": ("skipped", "robots"), "test2": ("pending", None)}
    assert state.frontier.count() == 1


def test_export(spark, empty, tmp_path):
    state = R.registry_add(empty, found(spark, ("/test1", None, 1, False, 0), ("/test2", None, 2, True, 0), ("/t3", None, 3, True, 0)))
    state = R.mark_crawled(state, log(spark, ("/test1", 200, None), ("/test2", 404, None), ("/t3", 0, "x")))
    tables.export_registry_tsv(state.registry, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    lines = [x for x in text.splitlines() if not x.startswith("URL")]
    assert lines == [
        f"{SITE}/test1\tsuccess\t200\t1\t0", f"{SITE}/test2\terror\t404\t2\t1", f"{SITE}/t3\terror\tN/A\t3\t1"]


def test_reset(spark, empty):
    assert empty.registry.count() == 0
    assert [f.name for f in empty.registry.schema] == [c.split()[0] for c in tables.URL_REGISTRY.split(", ")]


def test_dedupe_first(spark):
    urls = ["/page1", "/page2", "/page1", "/page1/"]
    rows = [(i, SITE + u) for i, u in enumerate(urls)] + [(9, "invalid-url")]
    got = R.dedupe_first(spark.createDataFrame(rows, "pos int, url string"))
    assert sorted((r.pos, r.url) for r in got.collect()) == [(0, SITE + "/page1"), (1, SITE + "/page2")]


def results(spark, *rows):
    return spark.createDataFrame(
        [(i, SITE + u, datetime(2024, 1, 1, 1, i), c, "text/html", e, False, 0.1, d,
          [x if x.startswith("http") else SITE + x for x in found]) for i, (u, c, e, d, found) in enumerate(rows)],
        LOG + ", depth int, discovered_urls array<string>")


def test_process_results(spark, empty, tmp_path):
    state = R.registry_add(empty, found(spark, ("/page1", None, 0, False, 100), ("/error", None, 0, False, 100)))
    round1 = results(
        spark, ("/page1", 200, None, 0, ["/page2", "/page3", "/x.pdf", "https://external.com/y", "/page1"]),
        ("/error", 404, "Not found", 0, []))
    state = R.process_results(state, round1).write(str(tmp_path / "v1"))
    s = stats.crawl_stats(state.registry).first()
    assert (s.successful_crawls, s.failed_crawls, s.total_urls_crawled, s.total_urls_discovered) == (1, 1, 2, 4)
    children = {r.url: r for r in state.registry.filter("crawl_status = 'pending'").collect()}
    assert set(children) == {SITE + "/page2", SITE + "/page3"}
    assert all(c.depth == 1 and c.parent_url == SITE + "/page1" for c in children.values())
    assert {r.priority for r in state.frontier.collect()} == {100}
    deep = results(spark, ("/page2", 200, None, 5, ["/page9"]))
    assert R.process_results(state, deep).registry.count() == 4


def test_first_parent_and_replace(spark):
    rows = [("u", 2, AT, "p1"), ("u", 1, "2024-01-02", "p3"), ("u", 1, "2024-01-02", "p2"), ("v", 0, AT, None)]
    df = spark.createDataFrame(rows, "url string, depth int, discovered_at string, parent_url string")
    got = {r.url: (r.depth, r.parent_url) for r in R.first_parent(df).collect()}
    assert got == {"u": (1, "p2"), "v": (0, None)}
    old = spark.createDataFrame([("a", 1), ("b", 1)], "url string, n int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "url string, n int")
    assert sorted(map(tuple, R.replace_results(old, new).collect())) == [("a", 1), ("b", 2), ("c", 2)]


def test_pattern_first(spark):
    urls = [SITE + p for p in ("/browse-jobs?category=b", "/browse-jobs?category=a", "/x?1", "/x?2", "/y")]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    kept = {r.url for r in R.pattern_first(df).filter("NOT is_duplicate").collect()}
    assert kept == {SITE + "/browse-jobs?category=a", SITE + "/x?1", SITE + "/y"}


def test_parent_lineage_with_hot_parent(spark, empty, no_broadcast):
    rows = [("/", None, 0, False, 0)] + [(f"/c{i}", SITE + "/", 1, False, 0) for i in range(40)]
    rows += [("/d", SITE + "/c1", 3, False, 0), ("/e", SITE + "/gone", 1, False, 0)]
    registry = R.registry_add(empty, found(spark, *rows)).registry
    plain = sorted(map(tuple, R.parent_lineage(registry).collect()), key=str)
    split = sorted(map(tuple, R.parent_lineage(registry, hot_rows=5).collect()), key=str)
    assert plain == split and len(plain) == 43
    got = {r[0].rsplit("/", 1)[1]: r[5] for r in plain}
    assert got["c7"] is True and got["d"] is False and got["e"] is None
