import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sitewright.operators import keyed, registry as R, sites
from sitewright.rules import FAST, STANDARD
from sitewright.functions import url as U
from sitewright.sources import tables

SITE = "https://www.example.com"
RESULTS = (
    "attempt_id bigint, url string, fetched_at timestamp, status_code int, content_type string, error_message string, "
    "is_dynamic boolean, response_time double, depth int, discovered_urls array<string>"
)


def results(spark, rng, n):
    rows = []
    for i in range(n):
        found = [f"{SITE}/p{rng.randrange(60)}" for _ in range(rng.randrange(5))]
        at = datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(1000))
        rows.append((i, f"{SITE}/p{rng.randrange(40)}", at, rng.choice([200, 404, 0]), "text/html", None, False, 0.5, rng.randrange(6), found))
    return spark.createDataFrame(rows, RESULTS)


def seeded(spark):
    bases = spark.createDataFrame([(f"{SITE}/p{i}",) for i in range(30)], "url string")
    return R.registry_add(R.CrawlState(*tables.reset_registry(spark)), R.seed_batch(bases, "2023-12-01 00:00:00"))


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_rounds_equal_whole_tables(spark, tmp_path):
    rng = random.Random(4)
    state = seeded(spark).write(str(tmp_path / "v0"))
    own = keyed.KeyedState.of(state, str(tmp_path / "keyed"), 4)
    for k in range(3):
        found = results(spark, rng, 12)
        state = R.process_results(state, found).write(str(tmp_path / f"v{k + 1}"))
        keyed.process_results(own, found)
        now = own.current()
        assert rows_of(now.registry) == rows_of(state.registry)
        assert rows_of(now.frontier) == rows_of(state.frontier)
        if k == 1:
            own.registry.compact()
            assert rows_of(own.registry.current()) == rows_of(state.registry) and own.registry.rounds == 0
    own.registry.drop()
    own.frontier.drop()


def test_rounds_write_changed_rows_and_leave_the_base_unshuffled(spark, no_broadcast):
    base = spark.range(2000).select(F.concat(F.lit("u"), "id").alias("url"), F.col("id").alias("n"))
    table = keyed.KeyedTable(base, buckets=4)
    table.change(base.filter("n < 7").withColumn("n", -F.col("n") - 1), gone=base.filter("n = 9"))
    table.change(base.filter("n = 3"), gone=base.filter("n = 4"))
    assert table.changes().count() == 10
    current = table.current()
    plan = current._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    got = {r.url: r.n for r in current.collect()}
    assert len(got) == 1998 and "u9" not in got and "u4" not in got
    assert got["u3"] == 3 and got["u5"] == -6 and got["u1999"] == 1999
    asked = keyed.touched(current, base.filter("n in (3, 4, 1000)"))
    assert "Exchange hashpartitioning(url" in asked._jdf.queryExecution().executedPlan().toString()  # of what is asked for
    assert sorted(r.url for r in asked.collect()) == ["u1000", "u3"]
    table.change(spark.createDataFrame([("new", 5)], "url string, n bigint"))
    table.compact()
    assert table.current().count() == 1999 and table.changes() is None
    table.drop()


def test_many_sites_in_one_plan(spark):
    hosts = spark.range(10_000).select(
        F.concat(F.when(F.col("id") % 2 == 0, "www.").otherwise("m."), F.lit("s"), F.floor(F.col("id") / 2), F.lit(".com")).alias("host"),
        F.concat(F.lit("s"), F.floor(F.col("id") / 2)).alias("site"),
        F.when(F.floor(F.col("id") / 2) % 2 == 0, "standard").otherwise("fast").alias("rules"),
    )
    links = spark.createDataFrame(
        [("https://www.s0.com/", "https://m.s0.com/a"), ("https://www.s0.com/", "https://www.s1.com/a"), ("https://www.s0.com/", "https://www.s0.com/"),
         ("https://M.s1.com/x", "https://m.S1.com/privacy"), ("https://m.s1.com/x", "https://www.s1.com/login"), ("https://m.s2.com/", "https://www.s2.com/login"),
         ("https://www.s4999.com/", "https://m.s4999.com/q?page=2"), ("https://nobody.com/", "https://www.s0.com/b"), ("https://www.s0.com/", None)],
        "src_url string, dst_url string")
    for hot_rows in (500_000, 2):
        out = sites.filter_candidates(links, hosts, hot_rows=hot_rows)
        got = {(r.src_url, r.dst_url) for r in out.collect()}
        want = set()
        for src, dst in map(tuple, links.collect()):
            if dst is None or "nobody" in src:
                continue
            name = lambda u: u.split("/")[2].lower().split(".")[1]
            rules = STANDARD if int(name(dst)[1:]) % 2 == 0 else FAST
            row = spark.createDataFrame([(src, dst)], "s string, d string").select(U.should_skip_url("d", rules), F.col("d") == U.normalize("s", rules)).first()
            if name(src) == name(dst) and not any(row):
                want.add((src, dst))
        assert got == want and len(got) >= 2
    plan = sites.filter_candidates(links, hosts)._jdf.queryExecution().executedPlan().toString()
    assert "s4999" not in plan and len(plan) < 100_000
    routed = {r.url: (r.site, r.rules, r.route) for r in sites.route(links.selectExpr("dst_url AS url"), hosts).collect()}
    assert routed["https://www.s1.com/a"][:2] == ("s1", "fast") and "https://www.s0.com/b" in routed
