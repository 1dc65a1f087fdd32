"""Ranks, salted joins, graph levels and schedules against brute force, with hot keys."""

import random
from collections import Counter, defaultdict
from functools import partial

import pytest
from pyspark.sql import functions as F

from sitewright.operators import generate as G
from sitewright.operators import graph, schedule, skew
from sitewright.operators.registry import batch_frontier
from sitewright.session import clear_work, materialize, shared_dir


def skewed(n, seed=5):
    """A third of the rows belong to one key."""
    rng = random.Random(seed)
    return [("hot" if i % 3 == 0 else f"k{rng.randint(0, n // 4)}", rng.randint(0, 9), i) for i in range(n)]


def test_rank_within_groups(spark):
    rows = skewed(900)
    df = spark.createDataFrame(rows, "g string, p int, id int").repartition(7)
    got = {r.id: r.rn for r in skew.ranked(df, [F.desc("p"), F.asc("id")], ["g"]).collect()}
    groups = defaultdict(list)
    for g, p, i in rows:
        groups[g].append((-p, i))
    want = {i: k + 1 for v in groups.values() for k, (_, i) in enumerate(sorted(v))}
    assert got == want


def test_global_rank(spark):
    rows = skewed(500)
    df = spark.createDataFrame(rows, "g string, p int, id int").repartition(5)
    got = {r.id: r.rn for r in skew.ranked(df, [F.asc("g"), F.asc("id")]).collect()}
    assert got == {i: k + 1 for k, (_, i) in enumerate(sorted((g, i) for g, _, i in rows))}


def test_rank_of_nothing(spark):
    df = spark.createDataFrame([], "g string, id int")
    assert skew.ranked(df, [F.asc("id")], ["g"]).count() == 0
    assert skew.ranked(df, [F.asc("id")]).count() == 0


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("hot_rows", [20, 10**6])
def test_lookup_join(spark, how, hot_rows, no_broadcast):
    rows = skewed(300)
    left = spark.createDataFrame(rows, "g string, p int, id int")
    keys = sorted({g for g, _, _ in rows})[::2] + ["hot", "unused"]
    right = spark.createDataFrame([(k, len(k)) for k in sorted(set(keys))], "k string, n int")
    got = skew.lookup_join(left, right, "g", "k", how, ["id"], hot_rows)
    plain = left.join(right, F.col("g") == F.col("k"), how)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, plain.collect()))


def test_every_hot_key_is_split_by_its_size(spark):
    df = spark.range(6000).select(F.when(F.col("id") < 2000, -1).otherwise(F.col("id") % 2000).alias("k"))
    shares = {r[0]: r[1] for r in skew.hot_keys(df, "k", 2).collect()}
    assert len(shares) == 2001 and shares[-1] == 1001 and shares[7] == 2


def test_bfs_against_brute_force(spark):
    rng = random.Random(11)
    edges = [(0, d) for d in range(1, 200)] + [(rng.randint(0, 400), rng.randint(0, 600)) for _ in range(900)]
    links = spark.createDataFrame(edges, "src int, dst int")
    seeds = spark.createDataFrame([(0,), (399,)], "node int")
    depth = {0: 0, 399: 0}
    level = [0, 399]
    for d in range(1, 5):
        level = sorted({t for s, t in edges if s in set(level)} - set(depth))
        depth.update({t: d for t in level})
    got = {r.node: r.depth for r in graph.bfs_depth(seeds, links, 4).collect()}
    assert got == depth


def test_bfs_stops_when_nothing_is_new(spark):
    links = spark.createDataFrame([(1, 2), (2, 1)], "src int, dst int")
    seeds = spark.createDataFrame([(1,), (1,)], "node int")
    assert sorted(map(tuple, graph.bfs_depth(seeds, links, 50).collect())) == [(1, 0), (2, 1)]


def frontier(spark, n=120):
    rows = [
        (f"http://{'hot' if i % 3 == 0 else 'h' + str(i % 7)}.com/{i}", i % 4, f"2024-01-01 00:{i % 60:02d}:00", False)
        for i in range(n)
    ]
    return rows, spark.createDataFrame(rows, "url string, priority int, added_at string, is_processing boolean")


def test_fetch_schedule(spark):
    rows, df = frontier(spark)
    hosts = defaultdict(list)
    for u, p, a, _ in rows:
        hosts[u.split("/")[2]].append((-p, a, u))
    want = {u: k * 2.0 for v in hosts.values() for k, (_, _, u) in enumerate(sorted(v))}
    assert {r.url: r.start_after for r in schedule.fetch_schedule(df, 2.0).collect()} == want


def test_batches(spark):
    rows, df = frontier(spark)
    ordered = sorted((-p, a, u) for u, p, a, _ in rows)
    got = {r.url: r.batch_no for r in batch_frontier(df, 7).collect()}
    assert got == {u: k // 7 for k, (_, _, u) in enumerate(ordered)}


def test_retry_schedule(spark):
    rows = [(i, "u", f"2024-01-01 00:0{i}:00", "x" if i != 2 else None) for i in range(7)]
    df = spark.createDataFrame(rows, "attempt_id int, url string, fetched_at string, error_message string")
    got = {r.attempt_id: (r.failure_no, r.wait, r.gave_up) for r in schedule.retry_schedule(df).collect()}
    assert got == {0: (1, 1.0, False), 1: (2, 2.0, False), 3: (3, 4.0, False), 4: (4, None, True),
                   5: (5, None, True), 6: (6, None, True)}


def test_topk_per_class(spark):
    base = "https://www.example.com"
    urls = [base + "/browse-jobs"] + [f"{base}/browse-jobs?category={i}" for i in range(6)]
    urls += [f"{base}/browse-jobs?location={i}" for i in range(2)] + [f"{base}/jobs-in-{i}" for i in range(9)]
    urls += [base + "/browse-jobs?category=1&location=2", base + "/about"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    picked = schedule.topk_per_class(df)
    assert Counter(r.render_class for r in picked.collect()) == {"base": 1, "category": 3, "location": 2, "other": 5}
    assert schedule.topk_per_class(df, below=5).count() == 0
    many = df.union(spark.range(3000).select(F.concat(F.lit(base + "/about?x="), "id")))
    assert Counter(r.render_class for r in schedule.topk_per_class(many).collect())["category"] == 3
    assert "WindowGroupLimit" in picked._jdf.queryExecution().executedPlan().toString()


def test_generators(spark):
    origins = spark.createDataFrame([("https://a.com",), ("http://b.com",)], "origin string")
    locations = [f"l{i}" for i in range(53)]
    categories = [f"c{i}" for i in range(40)]
    d = G.literal_dimensions(spark, locations, categories)
    counts = {
        "location": (G.location_paths, 265), "category": (G.category_paths, 200),
        "type_level": (G.type_level_paths, 21 + 24), "combo": (G.combo_paths, 53 * 40 * 3),
        "first": (partial(G.combo_paths, n=15), 675), "salary": (G.salary_paths, 14), "all": (partial(G.all_paths, n=15), 1199),
    }
    for name, (paths, n) in counts.items():
        got = G.candidates(origins, d, paths).groupBy("origin").count().collect()
        assert {r["count"] for r in got} == {n} and len(got) == 2, name
    urls = {r.url for r in G.candidates(origins, d, partial(G.all_paths, n=15)).collect()}
    assert "https://a.com/c14-jobs-in-l14" in urls and "https://a.com/c15-jobs-in-l14" not in urls
    patterns = {r.url for r in G.candidates(origins, d, G.pattern_paths).collect()}
    assert "http://b.com/jobs/c9/l9" in patterns and "http://b.com/jobs/c39/l52" in patterns
    assert not any("{" in u for u in patterns)


def test_large_dimensions_are_paired_by_equality(spark, no_broadcast):
    origins = spark.createDataFrame([("https://a.com",)], "origin string")
    big = spark.range(50_000).select(F.col("id").alias("pos"), F.concat(F.lit("v"), "id").alias("value"))
    d = G.table_dimensions(G.dimension(big, "pos", "value"), G.value_rows(spark, ["c"]))
    found = G.candidates(origins, d, G.location_paths)
    assert found.count() == found.select("url").distinct().count() == 250_000
    plan = G.paired(origins, big)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "(_bucket#" in plan
    pairs = G.fill_pairs(("/{location}/{category}",), big.limit(300), G.value_rows(spark, [f"c{i}" for i in range(200)]))
    assert pairs.distinct().count() == 60_000


def test_discovery_counts(spark):
    def urls(*names):
        return spark.createDataFrame([(n,) for n in names], "url string")

    s = {"a": urls("x", "y", "x"), "b": urls("y", "z"), "c": urls()}
    got = {r.strategy: r.urls for r in G.discovery_by_strategy(s).collect()}
    assert got == {"a": 2, "b": 2, "c": 0, "all": 3}
    assert sorted(r.url for r in G.union_strategies(s).collect()) == ["x", "y", "z"]


def test_api_candidates(spark):
    rows = [("https://a.com/api/jobs", 200, "application/json"), ("https://a.com/api/search", 404, "application/json"),
            ("https://a.com/other", 200, "application/json"), ("https://a.com/ajax/jobs", 200, "text/html")]
    probes = spark.createDataFrame(rows, "url string, status_code int, content_type string")
    d = G.literal_dimensions(spark, [f"l{i}" for i in range(9)], ["c0"])
    assert G.api_candidates(probes, d).count() == 11
    got = sorted(r.url for r in G.api_candidates(probes, d, n=5).collect())
    assert got == sorted(["https://a.com/api/jobs", "https://a.com/api/jobs?category=c0"]
                         + [f"https://a.com/api/jobs?location=l{i}" for i in range(5)])


def test_shared_dir_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == named.rstrip("/") if named else shared_dir(spark)


def test_small_sides_are_left_to_spark(spark):
    left = spark.createDataFrame(skewed(30), "g string, p int, id int")
    right = materialize(spark.createDataFrame([("hot", 1)], "k string, n int"), "test")
    plan = skew.lookup_join(left, right, "g", "k", "left", ["id"])
    assert "TakeOrdered" not in plan._jdf.queryExecution().executedPlan().toString()


def test_clear_work_removes_what_was_written(spark):
    df = materialize(spark.range(5), "test")
    path = df.inputFiles()[0]
    clear_work(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path).count()


def test_levels_pass_the_driver_only_while_small(spark, monkeypatch):
    monkeypatch.setattr(graph, "BROADCAST_ROWS", 1, raising=False)
    plans, real = [], graph.materialize

    def noted(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return real(df, label)

    monkeypatch.setattr(graph, "materialize", noted)
    links = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a")], "src string, dst string")
    got = graph.bfs_depth(spark.createDataFrame([("a",)], "node string"), links, None)
    assert sorted(map(tuple, got.collect())) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    levels = [p for label, p in plans if label == "bfs"]
    assert "SortMergeJoin" not in levels[1]
    assert all("LeftAnti" in p and "SortMergeJoin" in p and "BroadcastHashJoin [node" not in p for p in levels[2:])
