import glob
import os
from datetime import datetime, timedelta

import __spark_entry__ as entry_point
from compare import connect, differences

from sitewright.operators import registry as R
from sitewright.sources import tables
from sitewright.streaming import jobs

SITE = "https://www.example.com"
LOG = tables.CRAWL_LOG


def write_logs(spark, folder, batches):
    """One parquet file per batch, so that each can be its own micro-batch."""
    n = 0
    known = set()
    for k, rows in enumerate(batches):
        data = []
        for url, minute, code in rows:
            at = datetime(2024, 1, 1) + timedelta(minutes=minute)
            data.append((n, SITE + url, at, code, "text/html", None if code else "timeout", False, 0.1))
            n += 1
        spark.createDataFrame(data, LOG).coalesce(1).write.mode("append").parquet(folder)
        # The file source takes files in order of age.
        fresh = set(glob.glob(folder + "/part-*")) - known
        for path in fresh:
            os.utime(path, (1_700_000_000 + 60 * k,) * 2)
        known |= fresh


BATCHES = [
    [("/a", 0, 500), ("/b/", 1, 200), ("/known", 2, 200), ("/a", 3, 200)],
    [("/b#x", 10, 404), ("/c", 11, 0), ("/a", 5, 404)],
    [("/a", 90, 301), ("/d?b=1&a=2", 200, 200)],
]


def stream(spark, folder):
    return (
        spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(folder)
    )


def base(spark):
    empty = R.CrawlState(*tables.reset_registry(spark))
    known = spark.createDataFrame([(SITE + "/known",), (SITE + "/idle",)], "url string")
    return R.registry_add(empty, R.seed_batch(known, "2023-12-01 00:00:00")).registry


def test_stream_ends_where_the_batch_does(spark, tmp_path):
    folder = str(tmp_path / "log")
    write_logs(spark, folder, BATCHES)
    job = jobs.RegistryStream(spark, str(tmp_path / "state"))
    job.start(stream(spark, folder)).awaitTermination()
    got = sorted(map(tuple, job.registry(base(spark)).collect()))
    want = sorted(map(tuple, jobs.registry_of_batch(spark.read.schema(LOG).parquet(folder), base(spark)).collect()))
    assert got == want and len(got) == 6
    state = {r[0].replace(SITE, ""): (r[8], r[3]) for r in got}
    assert state["/a"] == ("success", 301) and state["/b"] == ("error", 404)
    assert state["/c"] == ("error", 0) and state["/idle"] == ("pending", None)
    assert state["/d?a=2&b=1"] == ("success", 200)
    assert job.results().select("batch_id").distinct().count() == 3


def test_replayed_batch_changes_nothing(spark, tmp_path):
    folder = str(tmp_path / "log")
    write_logs(spark, folder, BATCHES[:1])
    log = spark.read.schema(LOG).parquet(folder)
    job = jobs.RegistryStream(spark, str(tmp_path / "state"))
    job.write_batch(log, 0)
    once = sorted(map(tuple, job.registry(base(spark)).collect()))
    job.write_batch(log, 0)
    assert sorted(map(tuple, job.registry(base(spark)).collect())) == once
    compacted = job.compact(base(spark), str(tmp_path / "v2"))
    assert sorted(map(tuple, compacted.collect())) == once
    assert job.results().count() == 0  # folded batches are not applied again
    job.write_batch(log.filter("fetched_at < TIMESTAMP '2024-01-01 00:01:00'"), 1)
    assert sorted(map(tuple, job.registry(compacted).collect())) == once  # older results change nothing


def test_first_seen(spark, tmp_path):
    folder = str(tmp_path / "log")
    write_logs(spark, folder, BATCHES)
    job = jobs.FirstSeenStream(spark, str(tmp_path / "state"))
    job.start(stream(spark, folder)).awaitTermination()
    got = {r.url.replace(SITE, ""): r.first_seen for r in job.urls().collect()}
    assert sorted(got) == ["/a", "/b", "/c", "/d?a=2&b=1", "/known"]
    assert got["/a"] == datetime(2024, 1, 1) and got["/b"] == datetime(2024, 1, 1, 0, 1)
    assert job._numbers(f"{job.path}/batch_id=*/_SUCCESS") == [0, 1, 2]


def test_folding_keeps_the_result_and_removes_batches(spark, tmp_path):
    folder = str(tmp_path / "log")
    write_logs(spark, folder, BATCHES[:2])
    for kind, result in ((jobs.FirstSeenStream, "urls"), (jobs.ProgressStream, "windows")):
        job = kind(spark, str(tmp_path / kind.__name__))
        assert job.fold() == -1 and getattr(job, result)().count() == 0
        job.start(stream(spark, folder)).awaitTermination()
        before = sorted(map(tuple, getattr(job, result)().collect()))
        assert job.fold() == 1 == job.folded() and job.fold() == 1
        assert job._numbers(f"{job.path}/batch_id=*/_SUCCESS") == []
        assert sorted(map(tuple, getattr(job, result)().collect())) == before
        job.write_batch(spark.read.schema(LOG).parquet(folder), 1)  # a replay of a folded batch
        assert sorted(map(tuple, getattr(job, result)().collect())) == before
    write_logs(spark, folder, [BATCHES[2]])
    job.start(stream(spark, folder)).awaitTermination()
    assert job.folded() == 1 and job.fold() == 2
    assert job._numbers(f"{job.folds}/fold=*/_SUCCESS") == [2]
    assert sum(r.crawled for r in job.windows().collect()) == sum(map(len, BATCHES))


def test_closed_windows_forget(spark, tmp_path):
    folder = str(tmp_path / "log")
    write_logs(spark, folder, [[("/a", 1, 200), ("/b", 2, 500)], [("/c", 61, 200), ("/a", 62, 0)], [("/d", 400, 200)], [("/late", 3, 200)], [("/later", 4, 200), ("/e", 401, 200)]])
    done = jobs.run_to_files(jobs.closed_windows(stream(spark, folder)), str(tmp_path / "out"))
    done.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out/rows")).orderBy("window_start").collect()
    assert [(r.window_start.hour, r.crawled, r.succeeded) for r in rows] == [(0, 3, 2), (1, 2, 1)]  # lateness counts from the batch before
    assert done.lastProgress["stateOperators"][0]["numRowsTotal"] == 1  # the open window
    seen = jobs.run_to_files(jobs.recent_urls(stream(spark, folder), "30 days"), str(tmp_path / "urls"))
    seen.awaitTermination()
    got = [r.url.replace(SITE, "") for r in spark.read.parquet(str(tmp_path / "urls/rows")).collect()]
    assert sorted(got) == ["/a", "/b", "/c", "/d", "/e", "/late", "/later"]


def test_progress_counts_every_window_and_late_rows(spark, tmp_path):
    folder = str(tmp_path / "log")
    write_logs(spark, folder, [[("/a", 1, 200), ("/b", 2, 500)], [("/c", 200, 200)], [("/e", 201, 0)],
                               [("/late", 3, 200), ("/d", 400, 200)]])
    job = jobs.ProgressStream(spark, str(tmp_path / "state"))
    job.start(stream(spark, folder)).awaitTermination()
    got = job.windows().orderBy("window_start").collect()
    assert [(r.window_start.hour, r.crawled, r.succeeded) for r in got] == [(0, 3, 2), (3, 2, 1), (6, 1, 1)]
    assert got[1].success_rate == 50.0


def test_closed_windows_of_a_log_in_many_files(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    for path in glob.glob(f"{sf}/*.parquet"):
        if not path.endswith("/pages.parquet"):
            os.symlink(path, tmp_path / os.path.basename(path))
    spark.read.parquet(f"{sf}/pages.parquet").repartition(6).write.parquet(str(tmp_path / "pages.parquet"))
    got = entry_point.queries()["stream_progress_closed"](spark, str(tmp_path))
    assert differences(got, connect(sf).execute(entry_point.oracle_sql()["stream_progress_closed"]).df()) == []
