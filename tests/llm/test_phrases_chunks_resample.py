"""Operators 11 to 13 against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from sitewright.llm import chunk_bpe, phrases, quotient, resample
from sitewright.llm.common import documents, table
from sitewright.llm.queries import op11_phrases, op12_chunk_bpe, op13_resample

SF = "/root/testdata/sf0.001"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# --- Phrases -----------------------------------------------------------------


def plain_phrases(rows, longest, at_least, percent, top):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(str.maketrans(UPPER, LOWER))):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    often = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= at_least}
    gone = set()
    for (lang, longer), f in often.items():
        for n in range(2, len(longer)):
            for i in range(len(longer) - n + 1):
                if 100 * f >= percent * counts[lang, longer[i : i + n]]:
                    gone.add((lang, longer[i : i + n]))
    out = []
    for (lang, words), a in often.items():
        if (lang, words) not in gone:
            cuts = [(counts[lang, words[:k]], counts[lang, words[k:]]) for k in range(1, len(words))]
            score, _, left, right = min((1000000 * a * a // (x * y), k, x, y) for k, (x, y) in enumerate(cuts))
            out.append((lang, " ".join(words), a, left, right, totals[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    place, ranked = Counter(), []
    for r in out:
        place[r[0]] += 1
        if place[r[0]] <= top:
            ranked.append((r[0], place[r[0]], *r[1:]))
    return ranked


def phrase_rows(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_phrases_of_the_small_table(spark):
    rows = [(r.text, r.lang) for r in documents(spark, SF).collect()]
    assert phrase_rows(op11_phrases(spark, SF)) == sorted(plain_phrases(rows, 3, 10, 50, 2000))


@pytest.mark.parametrize("longest", [2, 4])
def test_phrases_with_ties_nulls_and_overlaps(spark, longest):
    rng = random.Random(longest)
    words = ["a", "b", "A", "c", "é", "x-y", "\x00z", "the"]
    rows = [(None, "en"), ("", "en"), (None, None), ("a a a a a a", None), ("...;;\n\n\t \r", "en"), ("w" * 300_000 + " b", "en")]
    rows += [(rng.choice(" ,.\n\t").join(rng.choices(words, k=rng.randrange(40))), rng.choice(["en", "fr", None, ""])) for _ in range(80)]
    rows += rows[-20:] * 2
    df = spark.createDataFrame([(i, t, lang, "x", "y", 1) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, ids string, word string, n int")
    got = phrase_rows(phrases.collocations(df, longest, 5, 40, 12))
    assert got == sorted(plain_phrases(rows, longest, 5, 40, 12)) and got


def test_phrases_of_an_empty_table(spark, docs_of):
    assert phrases.collocations(docs_of([])).collect() == []


def test_word_ids_are_spark_hashes(spark):
    df = spark.createDataFrame([("en", "the"), ("", "é"), ("fr", "")], "lang string, word string")
    for r in df.select("lang", "word", phrases._id("3").alias("id")).collect():
        assert phrases.hash_of("3", r.lang)(r.word.encode()) == r.id % 2**64


def test_small_filters_and_lots_change_nothing(spark, monkeypatch):
    rows = [(f"w{i % 7} w{i % 5} w{i % 3}. W{i % 7} w{i % 2}", "en") for i in range(300)]
    df = spark.createDataFrame(rows, "text string, lang string")
    want = phrase_rows(phrases.collocations(df))
    for name, value in (("RUNS", 50), ("WAITING", 10), ("WORDS", 3), ("WORD_BYTES", 200), ("SHARES", 3)):
        monkeypatch.setattr(phrases, name, value)
    real = phrases.bloom
    monkeypatch.setattr(phrases, "bloom", lambda p: real(p, most=phrases.BLOCK_BITS))  # mostly false positives at scale
    assert phrase_rows(phrases.collocations(df)) == want == sorted(plain_phrases(rows, 3, 10, 50, 2000))


def test_quotient_filters_lose_nothing():
    rng = np.random.default_rng(1)
    for width, n in ((2, 1), (2, 5000), (3, 20000), (3, 2)):
        keys = [rng.integers(0, 50 if n > 2 else 2**63, n, np.uint64) for _ in range(width)]
        want = Counter(zip(*(k.tolist() for k in keys)))
        words = quotient.permuted(keys)
        assert all((a == b).all() for a, b in zip(quotient.restored(words), keys))
        halves = [quotient.counted([w[a::2] for w in words]) for a in (0, 1) if len(words[0][a::2])]
        for part in halves:
            loaded = quotient.load(quotient.dump(*part))
            assert all((a == b).all() for a, b in zip([*loaded[0], loaded[1]], [*part[0], part[1]]))
        merged, counts = quotient.merged([quotient.load(quotient.dump(*h)) for h in halves])
        got = dict(zip(zip(*(k.tolist() for k in quotient.restored(merged))), counts.tolist()))
        assert got == want and (np.diff(merged[0].astype(object)) >= 0).all()
    big = ([np.array([1, 1, 2], np.uint64), np.array([5, 6, 0], np.uint64)], np.array([1, 10**12, 255]))
    assert [x.tolist() for x in quotient.load(quotient.dump(*big))[0]] == [x.tolist() for x in big[0]]
    assert quotient.load(quotient.dump(*big))[1].tolist() == [1, 10**12, 255]
    mixed = quotient.counted([np.array([7, 7, 7, 7], np.uint64), np.array([1, 2, 1, 2], np.uint64)])
    assert mixed[1].tolist() == [2, 2]  # equal first words, in any order


# --- Chunk-reuse BPE ---------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def vocabulary():
    return chunk_bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def digest_of(library, doc_id, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return (doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


ODD = [
    None, "", " ", "a", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y<|endoftext|", "  \n\n  z", "it's we'RE they'll 'r 're",
    "՘Ᲊ \U000323b0x", "x" * 70_000, "ab " * 30_000, "é" * 5000 + " ß", "\x00\x1c\x85\xa0　a", "日本語。" * 3000, "\U0001f600" * 40, " " * 9000,
]


def key(row):
    return (row[0] is not None, row[0] or 0, *row[1:])


def test_chunks_encode_as_the_library_does(spark, docs_of, library, vocabulary):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (3, "a"), (3, "a"), (3, "other")]
    shared = "".join(f"sentence number {i} of a shared passage, it's long enough. " for i in range(200))
    rows += [(100 + i, f"doc {i} " * (i % 5) + shared + "tail" * (i % 3)) for i in range(40)]
    docs = docs_of(rows, extra=("window", "bucket", "data", "ids"))
    want = sorted((digest_of(library, i, t) for i, t in rows), key=key)
    for window_bytes in (chunk_bpe.WINDOW, 20_000):
        got = sorted((tuple(r) for r in chunk_bpe.round_trip(docs, vocabulary, window_bytes).collect()), key=key)
        assert got == want
    tokens = chunk_bpe.encode(docs, vocabulary)
    back = sorted(((r.doc_id, r.text) for r in chunk_bpe.decode(tokens, vocabulary).collect()), key=key)
    assert back == sorted(((i, t or "") for i, t in rows), key=key)


def test_chunk_query_on_the_small_table(spark, library):
    want = sorted(digest_of(library, r.doc_id, r.text) for r in documents(spark, SF).collect())
    assert sorted(tuple(r) for r in op12_chunk_bpe(spark, SF).collect()) == want


def test_chunks_of_an_empty_table(spark, docs_of, vocabulary):
    assert chunk_bpe.round_trip(docs_of([]), vocabulary).collect() == []


def test_joins_of_any_cut(library, vocabulary):
    encoder = chunk_bpe.Encoder(vocabulary)
    pieces = [vocabulary.pieces.get(i, b"") for i in range(vocabulary.size)]
    sizes = np.array(list(map(len, pieces)))
    rng = random.Random(9)
    pool = ["a", "the", " ", "  ", "\n", "'", "s", "'re", "r", "e", "1", "..", "é", "ß", "日本", "\xa0", "\t", "x'v", "\U0001f600", "՘", "\x85", "²"]
    for k in range(4000):
        text = "".join(rng.choices(pool, k=rng.randrange(1, 40)))
        cuts = sorted({0, len(text), *(rng.randrange(len(text) + 1) for _ in range(rng.randrange(9)))})
        parts = [chunk_bpe.Chunk(np.frombuffer(encoder.encode([text[a:b]])[0], encoder.wide), pieces, sizes) for a, b in zip(cuts, cuts[1:])]
        assert np.concatenate(chunk_bpe.joined(parts, encoder)).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_borders_resist_shifts():
    rng = random.Random(3)
    text = " ".join("".join(rng.choices(LOWER, k=rng.randrange(2, 9))) for _ in range(20_000)).encode()

    def chunks(data):
        cuts = chunk_bpe.borders(data)
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    own = chunks(text)
    assert b"".join(own) == text and 60 < len(own) < 240
    moved = chunks(b"some words more in front " + text)
    assert len(set(own) & set(moved)) >= len(set(own)) - 2
    wide = "é".encode() * 50_000
    assert all(c.decode() for c in chunks(wide)) and max(map(len, chunks(wide))) <= chunk_bpe.LONGEST


def test_each_chunk_is_encoded_once(spark, docs_of, vocabulary, monkeypatch):
    text = "".join(f"word{i} and so on, " for i in range(500))
    rows = [(i, text) for i in range(30)]
    cut = docs_of(rows).select("doc_id", "text").coalesce(1).toArrow().to_batches()
    monkeypatch.setattr(chunk_bpe.TaskContext, "get", lambda: type("T", (), {"partitionId": lambda self: 0})())
    parcels = list(chunk_bpe._cut(iter(cut), vocabulary.added, 3 * len(text)))
    assert sum(p.num_rows for p in parcels) > len(parcels) > 5
    asked = []
    real = chunk_bpe.Encoder.encode
    monkeypatch.setattr(chunk_bpe.Encoder, "encode", lambda self, t: asked.extend(t) or real(self, t))
    held = type("B", (), {"value": vars(vocabulary)})
    import pyarrow as pa

    table = pa.Table.from_batches(parcels).sort_by([("bucket", "ascending"), ("window", "ascending")])
    list(chunk_bpe._encode(iter(table.to_batches()), held))
    assert "".join(sorted(asked)) == "".join(sorted(set(asked))) and sum(map(len, asked)) == len(text)


# --- Importance resampling ---------------------------------------------------


def plain_sample(rows, target, percent=25, least=20):
    def features(text):
        words = [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(str.maketrans(UPPER, LOWER))) if w]
        return len(words), words + [" ".join(p) for p in zip(words, words[1:])]

    def count(texts):
        return Counter(crc32(f.encode()) % 10000 for t in texts for f in features(t)[1])

    s, t = count(x for _, x in rows), count(target)
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in range(10000)]
    out = []
    for doc_id, text in rows:
        n_words, own = features(text)
        weight = sum(gain[crc32(f.encode()) % 10000] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words >= least))
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = percent * len(able) // 100
    return [(*r[:4], i + 1 if i < drawn else None) for i, r in enumerate(able)] + [(*r[:4], None) for r in out if not r[4]]


def sample_rows(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr)


def test_sample_of_the_small_table(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark, SF).collect()]
    target = [r.text for r in table(spark, SF, "benchmark").collect()]
    assert sample_rows(op13_resample(spark, SF)) == sorted(plain_sample(rows, target), key=repr)


@pytest.mark.parametrize("ranges,samples", [(1, 1 << 18), (7, 5), (40, 1 << 18)])
def test_sample_with_ties_nulls_and_repeats(spark, docs_of, ranges, samples):
    rng = random.Random(ranges)
    words = ["a", "B", "é9", "x", "the", "日本", "q" * 50]
    rows = [(i, rng.choice(" -_.\n").join(rng.choices(words, k=rng.randrange(45)))) for i in range(150)]
    rows += [(5, rows[20][1])] * 60 + [(None, "z " * 30)] * 20 + [(7, None), (8, ""), (9, "--"), (10, "w" * 200_000), (None, None)]
    target = spark.createDataFrame([("the the x",), (None,), ("",)], "text string")
    docs = docs_of(rows, extra=("row", "range", "n_words", "rank")).repartition(5)
    got = sample_rows(resample.resample(docs, target, ranges=ranges, samples=samples).select("doc_id", "n_features", "weight", "score", "rank"))
    assert got == sorted(plain_sample(rows, ["the the x", None, ""]), key=repr)


def test_sample_of_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "text string")
    assert resample.resample(docs_of([]), none).collect() == []
    rows = [(i, "a b " * 12) for i in range(9)]
    got = sample_rows(resample.resample(docs_of(rows), none).select("doc_id", "n_features", "weight", "score", "rank"))
    assert got == sorted(plain_sample(rows, []), key=repr)


def test_codes_of_runs_are_crc32():
    rng, crc = random.Random(2), resample.Crc()
    words = [bytes(rng.randrange(256) for _ in range(rng.randrange(1, 300))) for _ in range(300)]
    packed = crc.codes(words)
    code, size = (packed >> np.uint64(32)).astype(np.uint32), (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)
    joined = crc.joined(code[:-1], code[1:], size[1:])
    assert joined.tolist() == [crc32(a + b" " + b) for a, b in zip(words, words[1:])]


def test_ranges_behind_the_draw_are_not_exchanged(spark, docs_of):
    rows = spark.range(1000).selectExpr("id AS doc_id", "id % 97 AS score", "id AS row")
    rows = resample.materialize(rows, "t")
    ranked = resample.ranked(rows, 100, ranges=10)
    assert ranked.where(F.col("rank").isNotNull()).count() == 100 and ranked.count() == 1000
    best = sorted(((-(i % 97), i) for i in range(1000)))[:100]
    assert [r.doc_id for r in ranked.where("rank is not null").orderBy("rank").collect()] == [i for _, i in best]
