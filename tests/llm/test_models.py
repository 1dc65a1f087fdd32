import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from sitewright.llm import boost, lm, quality
from sitewright.llm.common import documents, remainder, table
from sitewright.llm.queries import op6_lm_score, op8_quality

SF = "/root/testdata/sf0.001"


class Plain:
    """Prediction by partial matching in dictionaries, byte by byte."""

    def __init__(self, texts, order):
        self.order, self.seen = order, {}
        for t in texts:
            data = lm.START * order + t.encode() + lm.END
            for i in range(order, len(data)):
                for k in range(order + 1):
                    self.seen.setdefault(data[i - k : i], Counter())[data[i]] += 1

    def log10(self, text):
        data = lm.START * self.order + text.encode() + lm.END
        return sum(self.byte(data[i - self.order : i], data[i]) for i in range(self.order, len(data)))

    def byte(self, context, symbol):
        p, excluded = 1.0, set()
        for k in range(self.order, -1, -1):
            counts = self.seen.get(context[len(context) - k :])
            if counts is None:
                continue
            left = {s: c for s, c in counts.items() if s not in excluded}
            total = sum(left.values())
            if symbol in left:
                return math.log10(p * (left[symbol] - 0.5) / total)
            if left:
                p *= len(left) / (2 * total)
            excluded = set(counts)
        return math.log10(p / (256 - len(excluded)))


def test_scores_equal_plain_partial_matching(spark, docs_of):
    texts = ["the cat sat on the mat", "the dog sat on the log", "théâtre", "", None, "zzzz" * 50, "the cat sat on the mat", "qqq new"]
    rows = list(enumerate(texts)) + [(3, "repeated"), (3, "repeated")]
    docs = docs_of(rows, extra=("word", "row", "score", "n"))
    train = [t or "" for i, t in rows if i < 6]
    own = Plain(train, 3)
    counts = Counter(w for t in train for w in [*lm.split_words(t), b""])
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (i, len(lm.split_words(t or "")) + 1, sum(counts[w] > 0 for w in [*lm.split_words(t or ""), b""]), n,
         round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*lm.split_words(t or ""), b""]), 5), round(own.log10(t or ""), 3))
        for i, t in rows
    )
    got = sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 3)) for r in lm.score(docs, F.col("doc_id") < 6, order=3).collect())
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want):
        assert abs(g[4] - w[4]) < 1e-4 and abs(g[5] - w[5]) < 2e-3 * max(1, abs(w[5]))


def test_probabilities_add_to_one_at_any_total():
    choose = random.Random(2)
    texts = ["".join(choose.choice("abc de") for _ in range(200)) for _ in range(30)]
    keys, begins = lm.grams(texts, 3)
    keys, counts = np.unique(keys[lm._inside(begins, len(keys), 3)], return_counts=True)
    for times in (10**4, 10**6, 10**9):  # totals of about 10^7, 10^9 and 10^12; single occurrences stay
        trie = lm.Trie(keys, np.where(counts > 3, counts * times + 1, counts).astype(np.int64), 3)
        trie.index()
        for context in (b"abc", b"zzz", lm.START * 3, b"a d", b"cea"):
            every = np.arange(256, dtype=np.uint64) + np.uint64(int.from_bytes(context, "big") << 8)
            logs = trie.log10(every).astype(float)
            assert np.isfinite(logs).all() and abs((10**logs).sum() - 1) < 1e-4


def test_probabilities_add_to_one_also_in_a_pruned_trie():
    choose = random.Random(1)
    texts = ["".join(choose.choice("abc de") for _ in range(200)) for _ in range(30)]
    keys, begins = lm.grams(texts, 3)
    keys, counts = np.unique(keys[lm._inside(begins, len(keys), 3)], return_counts=True)
    for least in (1, 5):
        trie = lm.Trie(keys[counts >= least], counts[counts >= least], 3)
        trie.index()
        for context in (b"abc", b"zzz", lm.START * 3, b"a d"):
            every = np.arange(256, dtype=np.uint64) + np.uint64(int.from_bytes(context, "big") << 8)
            assert abs((10 ** trie.log10(every).astype(float)).sum() - 1) < 1e-4


def test_no_training_and_empty_tables(spark, docs_of):
    docs = docs_of([(i, f"text number {i} of the test") for i in range(60)])
    r = lm.score(docs, F.lit(False)).collect()
    assert all(x.train_tokens == 0 and x.base_score == 0 and x.n_known == 0 for x in r)
    one = next(x for x in r if x.doc_id == 0)
    assert abs(one.score + len("text number 0 of the test" + "!") * math.log10(256)) < 1e-3
    assert lm.score(docs_of([]), F.lit(True)).count() == 0


def test_no_counted_node_is_left_out_of_scoring(spark, docs_of, monkeypatch):
    choose = random.Random(8)
    texts = ["".join(choose.choice("abcdefgh é") for _ in range(choose.randint(0, 300))) for _ in range(120)]
    docs = docs_of(list(enumerate(texts)))
    own = Plain(texts[:90], 3)
    for part, words in ((10**9, 10**6), (200, 9)):  # a part for 200 bytes and for nine words: many parts
        monkeypatch.setattr(lm, "WORDS", words)
        got = {r.doc_id: r.score for r in lm.score(docs, F.col("doc_id") < 90, order=3, part=part).collect()}
        for i, t in enumerate(texts):
            want = own.log10(t)
            assert np.isfinite(got[i]) and abs(got[i] - want) < 2e-3 * max(1, abs(want))


def test_parts_score_as_the_whole_trie():
    choose = random.Random(9)
    texts = ["".join(choose.choice("abc dé") for _ in range(200)) for _ in range(40)]
    keys, begins = lm.grams(texts, 4)
    keys, counts = np.unique(keys[lm._inside(begins, len(keys), 4)], return_counts=True)
    asked, _ = lm.grams(["".join(choose.choice("abcd éx") for _ in range(500))], 4)
    whole = lm.Trie(keys, counts, 4)
    whole.index()
    low, at = np.unique(keys & np.uint64(0xFFFF), return_inverse=True)
    n = np.bincount(at, counts).astype(np.int64)
    place, own = lm._place(keys, 5), lm._place(asked, 5)
    for p in range(5):
        part = lm.Trie(keys[place == p], counts[place == p], 4, (low, n))
        part.index()
        mine = asked[own == p]
        assert np.allclose(part.log10(mine), whole.log10(mine), atol=1e-6)


def test_held_out_is_by_id_and_no_text_of_it_is_counted(spark):
    got = op6_lm_score(spark, SF).collect()
    assert len(got) == documents(spark, SF).count()
    for r in got:
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 7 == 2)
    tokens = sum(r.n_tokens for r in got if not r.held_out)
    assert {r.train_tokens for r in got} == {tokens}


def test_quality_on_held_out_rows(spark):
    labels = {r.doc_id: r.quality for r in table(spark, "/root/testdata/sf0.1", "labels").collect()}
    got = op8_quality(spark, "/root/testdata/sf0.1").collect()
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert sum(a for a, b in held if b) >= 0.98 * sum(b for _, b in held)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_quality_edges(spark, docs_of):
    rows = [(1, "good text here"), (2, "BAD!! BAD!! BAD!!"), (3, None), (4, ""), (1, "good text here"), (None, "good"), (5, "x " * 40_000)]
    docs = docs_of(rows, extra=("score", "label", "i"))
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (7, 1), (None, 1), (4, 5), (5, None)], "doc_id long, quality int")
    got = quality.score(docs, quality.train(docs, labels, "quality", epochs=20)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r.score for r in got}
    assert by_id[1] > by_id[2] and by_id[3] == by_id[4]
    none = quality.train(docs, labels.limit(0), "quality")
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(docs_of([]), none).count() == 0


def test_labels_alone_decide_what_is_learned(spark):
    sf = "/root/testdata/sf0.001"
    docs = documents(spark, sf)
    changed = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q"))
    labels = table(spark, sf, "labels")
    assert quality.train(docs, labels, "quality", remainder("doc_id", 4) != 2) == quality.train(changed, labels, "quality", remainder("doc_id", 4) != 2)


def test_boosted_trees_score_alike_in_spark(spark):
    choose = random.Random(3)
    rows = [((a, b, c), 10.0 * ((a > 1) ^ (b > 2)), 10.0) for a in range(4) for b in range(5) for c in range(2)]
    trees = boost.fit(rows)
    assert all((boost.predict(trees, x) > 0) == (y > 5) for x, y, _ in rows)
    df = spark.createDataFrame([x for x, _, _ in rows], "a int, b int, c int")
    for r in df.withColumn("s", boost.expression(trees, ["a", "b", "c"])).collect():
        assert abs(r.s - boost.predict(trees, (r.a, r.b, r.c))) < 1e-9
    assert boost.fit([]) == [] and choose
