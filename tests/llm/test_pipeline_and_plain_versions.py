"""The pipeline, and operators against plain versions of what they compute."""

import math
import random
import struct
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from sitewright.llm import bpe, decontaminate, line_dedup, ngram_join, pii, quality, token_output
from sitewright.llm.queries import vocabulary

WORDS = [a + b for a in ("ka", "lo", "mi", "ten", "sor", "ver") for b in ("ra", "do", "nis", "pel", "um", "et", "or")]


def prose(choose, n):
    return " ".join(choose.choice(WORDS) for _ in range(n))


# --- Pipeline ----------------------------------------------------------------


@pytest.fixture
def folder(spark, docs_of, tmp_path):
    """documents, labels and benchmark with everything that may go wrong in them."""

    def make(rows, labels, items, extra=()):
        docs_of(rows, extra).write.parquet(str(tmp_path / "documents.parquet"))
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
        spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
        return str(tmp_path)

    return make


def test_pipeline_stages_take_effect(spark, folder):
    choose = random.Random(3)
    passage = "\n".join(prose(choose, 30) for _ in range(4))
    item = prose(choose, 25)
    text = prose(choose, 120)
    words = text.split()
    words[60] = "changed"
    rows = [(i, prose(choose, 60)) for i in range(200)]
    rows += [(i, "!!! " + " ".join("$%&"[k % 3] * 5 for k in range(40))) for i in range(200, 260)]  # junk
    rows += [(300, "own line one\n" + passage), (301, "another start\n" + passage)]
    rows += [(310, text), (311, text), (312, " ".join(words)), (312, " ".join(words))]
    rows += [(320, prose(choose, 40) + " " + item + " " + prose(choose, 40))]
    rows += [(330, None), (331, ""), (None, prose(choose, 50)), (332, "\n\n\n"), (333, prose(choose, 20_000))]
    labels = [(i, 1, 0) for i in range(0, 200, 2)] + [(i, 0, 0) for i in range(200, 260, 2)] + [(None, 1, 0), (7, None, None)]
    extra = ("score", "lines_removed", "kind", "rank", "hash", "group", "n")
    out = corpus_pipeline.run(spark, folder(rows, labels, [(1, item), (2, None), (3, "")], extra))
    got = {r.doc_id: r for r in out.collect()}
    assert not any(200 <= i < 260 for i in got if i is not None)  # rejected, labelled or not
    assert set(range(200)) <= set(got) and {300, 301, 310, 333, None} <= set(got)
    assert not {311, 312, 320} & set(got)
    name, pattern = vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(name), special_tokens={})
    assert got[301].n_tokens == len(library.encode_ordinary("another start"))
    assert got[0].n_tokens == len(library.encode_ordinary(dict(rows[:200])[0]))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_pipeline_stages_keep_the_columns(spark, folder):
    choose = random.Random(4)
    rows = [(i, prose(choose, 30)) for i in range(20)] * 2
    sf = folder(rows, [(0, 1, 0), (1, 0, 0)], [(1, "some item of the test")])
    docs = spark.read.parquet(sf + "/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name


def test_pipeline_of_empty_tables(spark, folder):
    assert corpus_pipeline.run(spark, folder([], [], [])).collect() == []


# --- Line dedup --------------------------------------------------------------


def plain_chunks(text):
    """(start, stop) of the chunks of a text, by the rule in the module's docstring."""
    lines = text.split("\n")
    hashes = [struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(x.encode(), 42)))[0] for x in lines]
    words = [x.count(" ") + x.count("\t") + 1 for x in lines]
    long = [n >= line_dedup.LONG for n in words]
    last = len(lines) - 1
    found = set()
    for r in line_dedup.REMAINDERS:
        begin = 0
        for i in range(len(lines)):
            rolled = sum(hashes[i - k] % line_dedup._PRIME * 31**k if i >= k else 0 for k in range(line_dedup.WINDOW)) % line_dedup._PRIME
            if i == last or long[i] or long[i + 1] or rolled % line_dedup.DIVISOR == r:
                found.add((begin, i + 1))
                begin = i + 1
    for i in range(last):
        if not long[i]:
            n = next((n for n in range(2, line_dedup.FINE) if sum(words[i : i + n]) >= line_dedup.LONG), line_dedup.FINE)
            found.add((i, min(len(lines), i + n)))
    return lines, [(a, b) for a, b in found if b - a > 1 or long[a]]


def plain_left(rows):
    """Texts without what an earlier document has."""
    places = defaultdict(list)
    for doc_id, text in set(rows):
        if text:
            version = struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(text.encode(), 42)))[0]
            lines, found = plain_chunks(text)
            for a, b in found:
                places["\n".join(lines[a:b])].append(((doc_id, version, a), b, (doc_id, text)))
    gone = defaultdict(set)
    for same in places.values():
        first = min(p for p, _, _ in same)
        for place, stop, row in same:
            if place != first:
                gone[row] |= set(range(place[2], stop))
    return [(i, t if t is None or not gone[i, t] else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i, t])) for i, t in rows]


def test_line_dedup_equals_a_plain_version(docs_of):
    choose = random.Random(12)
    lines = [prose(choose, choose.randrange(1, 12)) for _ in range(25)] + [prose(choose, 55), "", "a\tb", "x\ty " * 30]
    passages = ["\n".join(choose.choices(lines, k=choose.randrange(2, 9))) for _ in range(6)]
    rows = [(i, "\n".join([*choose.choices(lines, k=choose.randrange(4)), choose.choice(passages), *choose.choices(lines, k=choose.randrange(4))])) for i in range(60)]
    rows += [(3, rows[3][1]), (5, rows[9][1]), (70, None), (71, ""), (72, "\n"), (73, "one line")]
    got = line_dedup.remove_repeats(docs_of(rows, extra=("hash", "start", "place"))).collect()
    assert sorted((r.doc_id, repr(r.text)) for r in got) == sorted((i, repr(t)) for i, t in plain_left(rows))


def test_line_dedup_of_very_many_lines(docs_of):
    text = "\n".join(f"line {i % 9973} {i}" for i in range(300_000))
    got = {r.doc_id: r for r in line_dedup.remove_repeats(docs_of([(1, text), (2, "begin here\n" + text)])).collect()}
    assert got[1].lines_removed == 0 and got[2].text.startswith("begin here") and len(got[2].text) < 200


@pytest.mark.parametrize("module", [line_dedup, decontaminate, ngram_join])
def test_paths_beyond_small_tables(docs_of, spark, monkeypatch, module):
    """The joins of tables too large to broadcast give the same rows."""
    choose = random.Random(5)
    passage = "\n".join(prose(choose, 20) for _ in range(4))
    rows = [(i, prose(choose, 30) + "\n" + (passage if i % 3 == 0 else prose(choose, 5))) for i in range(30)] + [(30, None), (4, None), (9, passage)]
    rows += [(40 + i, rows[2][1]) for i in range(4)] + [(41, rows[2][1])]
    docs = docs_of(rows)
    items = spark.createDataFrame([(1, passage.replace("\n", " ")), (2, rows[7][1])], "item_id long, text string")
    run = {
        line_dedup: lambda: line_dedup.remove_repeats(docs),
        decontaminate: lambda: decontaminate.clean(docs, items),
        ngram_join: lambda: ngram_join.keep_one(docs, 5, 80),
    }[module]
    want = sorted(map(repr, run().collect()))
    monkeypatch.setattr(module, "SMALL", 0)
    assert sorted(map(repr, run().collect())) == want and 0 < len(want)


def test_token_output_beyond_small_tables(spark, docs_of, tmp_path, monkeypatch):
    choose = random.Random(6)
    docs = docs_of([(i, prose(choose, choose.randrange(40))) for i in range(40)]).select("doc_id", F.encode("text", "UTF-8").alias("ids"))
    want = sorted(map(tuple, token_output.write_shards(docs, str(tmp_path / "a"), 7).collect()))
    monkeypatch.setattr(token_output, "SMALL", 0)
    assert sorted(map(tuple, token_output.write_shards(docs, str(tmp_path / "b"), 7).collect())) == want


# --- Links -------------------------------------------------------------------


def test_near_copies_give_a_spanning_forest(docs_of, monkeypatch):
    choose = random.Random(8)
    base = prose(choose, 200).split()
    rows = []
    for i in range(700):
        own = list(base)
        own[choose.randrange(200)] = f"own{i}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, prose(choose, 80)) for i in range(50)]
    handed = []
    real = ngram_join.materialize
    monkeypatch.setattr(ngram_join, "materialize", lambda df, name: (lambda out: handed.append(out.count()) or out if name == "links" else out)(real(df, name)))
    got = {r.doc_id: r.component_id for r in ngram_join.link_components(docs_of(rows), 3, 90).collect()}
    assert all(got[i] == 0 for i in range(700)) and all(got[1000 + i] == 1000 + i for i in range(50))
    blocks = -(-700 // ngram_join.BLOCK)
    assert handed and max(handed) <= blocks * blocks * 2 * 700 < 700 * 699 / 2 / 10


# --- Quality -----------------------------------------------------------------


def plain_ftrl(examples, epochs):
    """Follow the regularised leader over dictionaries; the key None is the bias."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(k):
        if abs(z[k]) <= quality.L1:
            return 0.0
        return -(z[k] - math.copysign(quality.L1, z[k])) / ((quality.BETA + math.sqrt(n[k])) / quality.ALPHA + quality.L2)

    for _ in range(epochs):
        for x, y in examples:
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(w[k] * v for k, v in x.items())))))
            for k, v in x.items():
                g = (p - y) * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / quality.ALPHA * w[k]
                n[k] += g * g
    return weight


def test_quality_equals_plain_ftrl(spark, docs_of):
    choose = random.Random(2)
    rows = [(i, prose(choose, choose.randrange(1, 30)) if i % 3 else "$$$ BUY 1 1 1 " * choose.randrange(1, 5)) for i in range(90)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 90, 2)], "doc_id long, quality int")
    docs = docs_of(rows)
    shapes = quality._Shapes()
    given = {i: dict(zip(*(a.tolist() for a in quality.features(t, shapes)))) | {None: 1.0} for i, t in rows}
    order = sorted(range(0, 90, 2), key=lambda i: (crc32(str(i).encode()), i))
    weight = plain_ftrl([(given[i], int(i % 3 > 0)) for i in order], quality.EPOCHS)
    for r in quality.score(docs, quality.train(docs, labels, "quality")).collect():
        want = 1 / (1 + math.exp(-sum(weight(k) * v for k, v in given[r.doc_id].items())))
        assert abs(r.score - want) < 1e-4


# --- Personal data -----------------------------------------------------------


def test_very_long_matches_end(docs_of):
    labels = 100_000
    rows = [
        (1, "a@b" + ".c" * labels), (2, "a [at] b" + " [dot] c" * labels), (3, "x" * labels + "@y.z"), (4, "password=" + "a" * labels + "1" * 20),
        (5, "1" + "-1" * labels), (6, "+1" + " 1" * labels), (7, "a" * labels + " [at] " + "b" * labels + ".c"), (8, "1." * labels),
    ]
    got = {r.doc_id: r for r in pii.per_document(pii.spans(docs_of(rows))).collect()}
    assert len(got) == 8 and got[1].n_email == 1 and got[3].n_email == 1
    assert f"email:0:{3 + 2 * labels}" in got[1].spans and got[1].n_spans >= 1
    assert np.all([r.n_added == r.n_spans - (r.n_email + r.n_ip + r.n_card + r.n_phone) for r in got.values()])
