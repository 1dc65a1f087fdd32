import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewright.llm import token_output, topk
from sitewright.llm.token_output import Feistel


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rank", F.lit(1)).withColumn("v", F.lit("x"))


def plain_top(rows, k, is_query):
    held = []
    for i, e, _ in rows:
        if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e):
            held.append((i, np.floor(64 * np.array(e, np.float32).astype(float)).astype(int)))
    out = []
    for q in sorted({i for i, _ in held if is_query(i)}):
        own = min((tuple(v) for i, v in held if i == q))
        scored = sorted((-int(np.dot(own, v)), i) for i, v in held if i != q and len(v) == len(own))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("block,group", [(64, 7), (10_000, 1000)])
def test_top_k_equals_all_products(spark, block, group):
    choose = np.random.default_rng(3)
    rows = [(i, [float(x) for x in choose.normal(0, 0.2, 16)], 0) for i in range(600)]
    rows += [(i, [0.25] * 16, 1) for i in range(700, 900)]  # many ties
    rows += [(910, None, 0), (911, [1.0, None] + [0.0] * 14, 0), (912, [float("nan")] * 16, 0), (913, [float("inf")] * 16, 0), (None, [0.1] * 16, 0),
             (914, [], 0), (920, [0.5] * 8, 0), (940, [0.5] * 8, 0), (20, [0.9] * 16, 0), (21, [0.3] * 16, 0), (21, [0.3] * 16, 0), (960, [0.0] * 16, 0), (980, [-9.0] * 16, 0)]
    got = topk.search(topk.scaled(vectors(spark, rows), 64), F.col("vec_id") % 20 == 0, 20, block, group)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == sorted(plain_top(rows, 20, lambda i: i % 20 == 0))


def test_top_k_with_few_or_no_rows(spark):
    few = [(20, [0.5, 0.5], 0), (21, [0.5, 0.25], 0), (22, [0.5, 0.25], 0)]
    got = topk.search(topk.scaled(vectors(spark, few), 64), F.col("vec_id") % 20 == 0, 20).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in got] == [(1, 21, 1536), (2, 22, 1536)]
    assert topk.search(topk.scaled(vectors(spark, []), 64), F.col("vec_id") % 20 == 0, 20).count() == 0
    assert topk.search(topk.scaled(vectors(spark, few), 64), F.lit(False), 20).count() == 0


@pytest.mark.parametrize("largest", [90, 255, 2**20, 2**27, 2**34])
def test_large_components_give_the_same_top_k(largest):
    choose = np.random.default_rng(11)
    data = choose.integers(-largest, largest, (500, 128)) * 64
    index = topk.Index(np.arange(500), data)
    for query in data[:5]:
        exact = data.astype(object) @ query.astype(object)
        order = sorted(range(1, 500), key=lambda i: (-exact[i], i))[:20]
        kept = [i for i in order if abs(exact[i]) < 2**63]
        if len(kept) == len(order):
            ids, scores = index.top(query, 0, 20)
            assert list(ids) == order and list(scores) == [exact[i] for i in order]
        else:
            with pytest.raises(OverflowError):
                index.top(query, 0, 20)


def test_components_of_large_vectors_are_whole_in_spark(spark):
    rows = [(i, [float(255 + (i * 7 + j) % 50) * 2**20 for j in range(64)], 0) for i in range(60)]
    got = topk.search(topk.scaled(vectors(spark, rows), 64), F.col("vec_id") % 20 == 0, 20)
    values = {i: [int(64 * x) for x in e] for i, e, _ in rows}
    few = [(i, [x * 2.0**-10 for x in e], 0) for i, e, _ in rows]
    with pytest.raises(Exception):  # scores beyond a long
        got.collect()
    got = topk.search(topk.scaled(vectors(spark, few), 64), F.col("vec_id") % 20 == 0, 20).collect()
    want = []
    for q in (0, 20, 40):
        scored = sorted((-sum(a * b for a, b in zip(values[q], values[i])) >> 20, i) for i in values if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:20])]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


def test_processing_stops_on_proof():
    choose = np.random.default_rng(5)
    data = np.floor(64 * choose.normal(0, 0.05, (4000, 32))).astype(np.int64)
    data[:30] += np.array([40] * 4 + [0] * 28)
    index = topk.Index(np.arange(4000), data)
    query = np.array([50] * 4 + [0] * 28)
    ids, scores = index.top(query, -1, 10)
    exact = data @ query
    order = np.lexsort((np.arange(4000), -exact))[:10]
    assert list(ids) == list(order) and list(scores) == list(exact[order])


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 50, 1000, 4097])
def test_slots_are_a_permutation_in_python_and_in_spark(spark, n):
    own = Feistel(n, 12)
    want = [own.number(i) for i in range(n)]
    assert sorted(want) == list(range(n))
    got = spark.range(n).select("id", own.column("id").alias("slot")).collect()
    assert [r.slot for r in sorted(got)] == want
    if n > 50:
        other = [Feistel(n, 13).number(i) for i in range(n)]
        assert sum(a == b for a, b in zip(want, other)) < n / 10
        assert abs(np.corrcoef(range(n), want)[0, 1]) < 0.1


def test_shards_hold_every_sequence_at_its_slot(spark, docs_of, tmp_path):
    choose = random.Random(4)
    rows = [(i, "é" * choose.randint(0, 40) + "x" * choose.randint(0, 90)) for i in range(80)]
    rows += [(200, None), (201, ""), (5, "twice"), (5, "twice"), (5, "twice"), (None, "no id"), (300, "long" * 5000)]
    docs = docs_of(rows, extra=("slot", "version", "first")).withColumn("ids", F.encode("text", "UTF-8"))
    run = lambda: token_output.write_shards(docs, str(tmp_path / "out"), key=9, length=32, shard_bytes=1000).collect()
    got = run()
    total = sum(-(-len((t or "").encode()) // 32) for _, t in rows)
    assert sorted(r.slot for r in got) == list(range(total))
    records = list(token_output.read_slots(str(tmp_path / "out"), 0, total, 32, 1, 1000))
    texts = {}
    for i, t in rows:
        texts.setdefault(i, set()).add((t or "").encode())
    for r in got:
        held = records[r.slot]
        assert len(held) == 32 and held[r.n_ids :] == bytes(32 - r.n_ids)
        assert any(t[r.seq_no * 32 : r.seq_no * 32 + 32] == held[: r.n_ids] for t in texts[r.doc_id])
        assert (r.shard, r.byte_offset) == (r.slot // 31, r.slot % 31 * 32)
    assert list(token_output.read_slots(str(tmp_path / "out"), 40, 75, 32, 1, 1000)) == records[40:75]
    assert run() and sorted(os.listdir(tmp_path / "out")) == [token_output.shard_name(i) for i in range(-(-total // 31))]
    assert token_output.write_shards(docs.limit(0), str(tmp_path / "none"), 9).count() == 0
