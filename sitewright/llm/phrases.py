"""Phrase collocations of each language, counted in quotient filters.

Texts are cut into pieces at ``.,;:!?`` and line ends, pieces into words at blanks and tabs, A-Z in lower case.
A phrase is a run of words of one piece; all its occurrences count, overlapping ones too.

1. *Words.* Tasks count words in a bounded table and hand on partial counts. A word's id is a 64-bit hash of
   language and word under a salt for which no two words of the vocabulary share an id; this is checked over the whole
   vocabulary, and another salt is taken if it fails. So ids are lossless, and a task needs no dictionary.
2. *Phrases, length by length.* A phrase of ``at_least`` occurrences consists of phrases that have as many. Of each
   length, only runs whose two shorter runs are frequent are counted; a Bloom filter of at most ``FILTER_BITS``
   bits (64 MB) says which may be. Its false positives cost work, not results: the phrase's own count decides.
   Packed ids go into counting quotient filters; a task cuts its filters into shards, and a shard's filters are
   merged in sorted order. A phrase that fills the corpus is one entry a filter.
3. *Cuts and scores.* Parts of a phrase are frequent too, so their counts are joined by ids, and scores are worked
   out in whole numbers (decimals of 38 digits). Phrases inside a longer one of enough occurrences go. The first ``top``
   of a language are found in ``SHARES`` shares first, then among those.

Null texts count as empty, a null lang as ``und``. Empty texts have no words. Repeated rows count again. Ties: score, then
count, then bytes of the phrase; of equal cuts the shortest first part. An empty table gives no rows. Very long texts are one value of
one batch and are read in lots of words. Columns other than text and lang are left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitewright.llm import quotient
from sitewright.llm.common import UPPER, ship
from sitewright.operators.skew import lookup_join
from sitewright.session import materialize, shuffle_partitions

#: At most so many bits of a Bloom filter: 64 MB.
FILTER_BITS = 1 << 29
BLOCK_BITS = 1 << 15
#: Distinct words, or bytes of them, that a task counts or remembers at a time.
WORDS, WORD_BYTES = 300_000, 1 << 24
#: Runs that a task gathers before it makes a filter of them.
RUNS = 1_500_000
#: Shares of a language that are ranked by themselves.
SHARES = 32
#: Entries of a shard that wait to be merged.
WAITING = 1 << 20
_BREAK = b"\xff"  # a byte that is in no text
_PIECES = bytes.maketrans(UPPER.encode() + b".,;:!?\n\x0b\x0c\r", UPPER.lower().encode() + _BREAK * 10)
NO_LANG = "und"


def _words(text: str) -> list[bytes]:
    """Words, and a break between pieces."""
    return text.encode().translate(_PIECES).replace(_BREAK, b" \xff ").split()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1)):
            yield text.as_py() or "", NO_LANG if (own := lang.as_py()) is None else own


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = {}
    size = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            counts.pop(_BREAK, None)
            found = pa.array([w.decode() for w in counts], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), found, pa.array(counts.values(), pa.int64())], ["lang", "word", "n"])

    for text, lang in _rows(batches):
        counts = held.setdefault(lang, Counter())
        before = len(counts)
        counts.update(_words(text))
        size += len(counts) - before
        if size > WORDS or len(text) > WORD_BYTES:
            yield from rows()
            held, size = {}, 0
    yield from rows()


def _id(salt: str):
    """The id of a word as Spark works it out; ``hash_of`` is the same in a task."""
    return F.xxhash64(F.lit(salt), "lang", "word")


def hash_of(salt: str, lang: str):
    seed = 42
    for part in (salt, lang):
        seed = xxhash.xxh64_intdigest(part.encode(), seed)
    return lambda word: xxhash.xxh64_intdigest(word, seed)


def vocabulary(docs: DataFrame) -> tuple[DataFrame, str]:
    """(lang, word, n, id) of every word, and the salt under which no two words share an id."""
    counts = docs.select("text", "lang").mapInArrow(_word_counts, "lang string, word string, n long")
    words = materialize(counts.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    salt = 0
    while True:
        known = words.withColumn("id", _id(str(salt)))
        if known.groupBy("id").count().where("count > 1 or id = 0").isEmpty():
            return known, str(salt)
        salt += 1


def _two_places(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return x & mask, (x >> np.uint64(32)) & mask


class Bloom:
    """A Bloom filter of two places a key, as bytes."""

    def __init__(self, bits: int, data: bytes):
        self.bits, self.data = bits, data
        self.array = np.frombuffer(data, np.uint8)

    def plain(self) -> tuple[int, bytes]:
        return self.bits, self.data

    def has(self, x: int) -> int:
        a, b = x & self.bits - 1, x >> 32 & self.bits - 1
        return self.data[a >> 3] >> (a & 7) & self.data[b >> 3] >> (b & 7) & 1

    def have(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), np.uint8)
        for at in _two_places(x, self.bits):
            out &= self.array[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)
        return (out & 1).astype(bool)


def _places(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = np.unique(np.concatenate(_two_places(key_of(_columns(batch.column(0))), bits))).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array((at // BLOCK_BITS).astype(np.int32)), pa.array((at % BLOCK_BITS).astype(np.int32))], ["block", "bit"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block to one bitmap a block."""
    own, bitmap = None, np.zeros(BLOCK_BITS, bool)

    def row() -> pa.RecordBatch:
        data = np.packbits(bitmap, bitorder="little").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([data], pa.binary())], ["block", "data"])

    for batch in batches:
        block, bit = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for b in np.unique(block).tolist():
            if own is not None and b != own:
                yield row()
                bitmap[:] = False
            own = b
            bitmap[bit[block == b]] = True
    if own is not None:
        yield row()


def _columns(ids: pa.Array) -> list[np.ndarray]:
    """Lists of equal length to one array a place."""
    flat = ids.flatten().to_numpy().view(np.uint64)
    return list(flat.reshape(len(ids), -1).T.copy()) if len(ids) else [flat]


def key_of(words: list[np.ndarray]) -> np.ndarray:
    """One number for a run of ids, for Bloom filters."""
    out = words[0]
    for w in words[1:]:
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + w
    return out ^ (out >> np.uint64(29))


def bloom(phrases: DataFrame, most: int = FILTER_BITS) -> Bloom:
    """The filter of (ids, ...): about 16 bits a phrase, ``most`` at most."""
    bits = BLOCK_BITS
    while bits < min(most, 16 * phrases.count()):
        bits *= 2
    places = phrases.select("ids").mapInArrow(partial(_places, bits=bits), "block int, bit int").distinct()
    blocks = places.repartition("block").sortWithinPartitions("block").mapInArrow(_blocks, "block int, data binary")
    data = np.zeros(bits // 8, np.uint8)
    for row in blocks.toLocalIterator():  # ``most`` bits at most
        data[row.block * BLOCK_BITS // 8 : (row.block + 1) * BLOCK_BITS // 8] = np.frombuffer(row.data, np.uint8)
    return Bloom(bits, data.tobytes())


class Ids(dict):
    """Ids of words; 0 for words that are not frequent and for breaks."""

    def __init__(self, salt: str, lang: str, frequent: Bloom):
        self.hash, self.frequent, self.size = hash_of(salt, lang), frequent, 0
        self[_BREAK] = 0

    def __missing__(self, word: bytes) -> int:
        x = self.hash(word)
        # The filter is asked by the same number as for runs of one word.
        own = x if self.frequent.has(x ^ x >> 29) else 0
        self.size += len(word) + 100
        self[word] = own
        return own

    def of(self, words: list[bytes]) -> np.ndarray:
        if self.size > 2 * WORD_BYTES:
            self.clear()
            self[_BREAK] = self.size = 0
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _filters(batches: Iterator[pa.RecordBatch], length: int, salt: str, blooms, shards: int) -> Iterator[pa.RecordBatch]:
    """(shard, data): filters of the runs of ``length`` words that may be frequent."""
    known: dict[str, Ids] = {}
    held, size = [], 0

    def rows() -> Iterator[pa.RecordBatch]:
        words, counts = quotient.counted([np.concatenate(w) for w in zip(*held)])
        own = quotient.shard_of(words[0], shards)
        at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        ends = [*at[1:].tolist(), len(own)]
        data = [quotient.dump([w[a:b] for w in words], counts[a:b]) for a, b in zip(at.tolist(), ends)]
        yield pa.RecordBatch.from_arrays([pa.array(own[at].astype(np.int32)), pa.array(data, pa.binary())], ["shard", "data"])

    words_of, shorter = (b and Bloom(*b) for b in blooms.value)
    for text, lang in _rows(batches):
        if lang not in known:
            if len(known) >= 64:
                known.clear()
            known[lang] = Ids(salt, lang, words_of)
        ids = known[lang].of(_words(text))
        for begin in range(0, len(ids), RUNS):
            lot = ids[begin : begin + RUNS + length - 1]
            if len(lot) < length:
                continue
            run = [lot[i : len(lot) - length + 1 + i] for i in range(length)]
            whole = run[0] != 0
            for w in run[1:]:
                whole &= w != 0
            if shorter is not None:
                may = np.zeros(len(lot) - length + 2, bool)
                inner = [lot[i : len(lot) - length + 2 + i] for i in range(length - 1)]
                may[:] = shorter.have(key_of(inner))
                whole &= may[:-1] & may[1:]
            held.append(quotient.permuted([w[whole] for w in run]))
            size += len(held[-1][0])
            if size > RUNS:
                yield from rows()
                held, size = [], 0
    if size:
        yield from rows()


def _merged(batches: Iterator[pa.RecordBatch], at_least: int) -> Iterator[pa.RecordBatch]:
    """Filters of a shard, merged; the frequent keys of the result."""
    shards: dict[int, list] = {}
    waiting: dict[int, int] = {}
    for batch in batches:
        for shard, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            held = shards.setdefault(shard, [])
            held.append(quotient.load(data.as_py()))
            waiting[shard] = waiting.get(shard, 0) + len(held[-1][1])
            if waiting[shard] > max(WAITING, len(held[0][1])):
                shards[shard], waiting[shard] = [quotient.merged(held)], 0
    for held in shards.values():
        words, counts = quotient.merged(held)
        often = counts >= at_least
        words = quotient.restored([w[often] for w in words])
        flat = np.stack(words, 1).reshape(-1).view(np.int64)
        offsets = np.arange(0, len(flat) + 1, len(words), dtype=np.int32)
        for a in range(0, len(offsets) - 1, 10_000):
            b = min(a + 10_000, len(offsets) - 1)
            ids = pa.ListArray.from_arrays(pa.array(offsets[a : b + 1] - offsets[a]), pa.array(flat[offsets[a] : offsets[b]]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts[often][a:b])], ["ids", "f"])


def frequent_phrases(docs: DataFrame, longest: int, at_least: int) -> tuple[DataFrame, DataFrame]:
    """The vocabulary, and (ids, f) of all phrases of up to ``longest`` words with f >= at_least, single words included."""
    spark = docs.sparkSession
    vocab, salt = vocabulary(docs)
    total = vocab.agg(F.sum("n")).first()[0] or 0
    shards = max(shuffle_partitions(spark), total >> 24)
    found = [vocab.where(F.col("n") >= at_least).select(F.array("id").alias("ids"), F.col("n").alias("f"))]
    words_of, shorter = bloom(found[0]), None
    for length in range(2, longest + 1):
        blooms = spark.sparkContext.broadcast((words_of.plain(), shorter and shorter.plain()))
        run = partial(_filters, length=length, salt=salt, blooms=blooms, shards=shards)
        cut = docs.select("text", "lang").mapInArrow(run, "shard int, data binary").repartitionById(shards, "shard")
        found.append(materialize(cut.mapInArrow(partial(_merged, at_least=at_least), "ids array<long>, f long"), f"phrases{length}"))
        if length < longest:
            shorter = bloom(found[-1])
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return vocab, materialize(every, "phrases")


def collocations(
    docs: DataFrame, longest: int = 3, at_least: int = 10, percent: int = 50, top: int = 2000, scale: int = 1_000_000
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the ``top`` phrases of two to ``longest`` words of each language.

    score is the least of floor(scale * a * a / (l * r)) over all cuts. A phrase goes if a longer one contains
    it and has ``percent`` of its occurrences.
    """
    vocab, phrases = frequent_phrases(docs, longest, at_least)
    counts = phrases.select(F.col("ids").alias("__part"), F.col("f").alias("__f"))
    candidates = phrases.where(F.size("ids") > 1)
    cuts = candidates.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k")).select(
        "*", F.slice("ids", F.lit(1), F.col("k")).alias("left"), F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")).alias("right")
    )
    with_l = lookup_join(cuts, counts, "left", "__part", "inner", ["ids", "k"]).withColumnRenamed("__f", "l").drop("__part", "left")
    with_r = lookup_join(with_l, counts, "right", "__part", "inner", ["ids", "k"]).withColumnRenamed("__f", "r").drop("__part", "right")
    a, parts = F.col("a").cast("decimal(18,0)"), F.col("l").cast("decimal(18,0)") * F.col("r").cast("decimal(18,0)")
    product = (a * a).cast("decimal(36,0)") * F.lit(scale).cast("decimal(7,0)")
    scored = with_r.withColumn("p", product.cast("decimal(38,0)")).withColumn("q", parts.cast("decimal(36,0)")).withColumn("score", F.expr("p div q"))
    best = scored.groupBy("ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("ids", "a", "cut.l", "cut.r", "cut.score")
    inner = F.explode(
        F.flatten(F.transform(F.sequence(F.lit(2), F.size("ids") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("ids") - n + 1), lambda i: F.slice("ids", i, n))))
    )
    around = candidates.where(F.size("ids") > 2).select(inner.alias("ids"), "f").groupBy("ids").agg(F.max("f").alias("longer"))
    kept = best.join(around, "ids", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a"))).drop("longer")
    kept = materialize(kept, "kept")
    spelled = vocab.where(F.col("n") >= at_least).select(F.col("id").alias("__id"), "lang", "word")
    each = kept.select(F.col("ids"), F.posexplode("ids").alias("place", "id"))
    texts = (
        lookup_join(each, spelled, "id", "__id", "inner", ["ids"])
        .groupBy("ids", "lang")
        .agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda s: s.word)).alias("phrase"))
    )
    totals = vocab.groupBy("lang").agg(F.sum("n").alias("n"))

    def first_of(rows: DataFrame, *group: str) -> DataFrame:
        order = Window.partitionBy(*group).orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
        return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)

    # A language's phrases are first ranked in shares, so that its last task sees ``SHARES * top`` rows at most.
    shares = kept.join(texts, "ids").withColumn("share", F.pmod(F.xxhash64("ids"), F.lit(SHARES)))
    first = first_of(first_of(shares, "lang", "share").drop("rank"), "lang")
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ship(__name__)
