"""Importance resampling towards the word statistics of a target table.

Words are runs of ASCII digits, letters (A-Z in lower case) and characters beyond ASCII. Features are all
runs of one to ``LONGEST`` words, joined by one space, repeats counted, hashed by crc32 into ``BUCKETS``. A bucket's gain
is the log ratio of its shares in the target and in the corpus, one added to each count, in
thousandths; a document's weight is the floored mean of the gains of its features. Documents of enough words
draw without replacement: weight plus Gumbel noise from a hash of the id is the score, and the highest scores win.

1. *Counting.* A task adds its features into one array of buckets and hands on that array, so the
   exchange is ``BUCKETS`` rows a task. crc32 is linear: the code of two words is that of the first, shifted by
   the length of the second by table look-ups, so runs are hashed as arrays, not as strings.
2. *Scoring.* The gains, ``BUCKETS`` numbers whatever the corpus, are sent to all tasks; weights are look-ups in that array.
3. *Parallel sorting by regular sampling.* Scored rows are sorted within their partitions and written: the runs. Every
   ``stride``-th row of each run is a sample (``SAMPLES`` in all at most, and one a run); every so manieth of the
   sorted samples is a splitter. Rows per range are counted, prefix sums of these counts are the ranks before each
   range, ranges behind the last drawn rank go nowhere, and the others are exchanged, merged within their range and
   numbered. A sort key ends in the row's own number, so equal rows, however many, are split as well.
   Only samples, splitters and counts reach the driver. Samples decide balance, not ranks.

Null text: no words, no features, weight 0. Null doc_id: its hash is that of ``7:`` alone, and it comes before other ids in ties. Repeated
rows are documents of their own. An empty table gives an empty result, an empty target gains by the corpus counts
alone. Very long texts are one value of one batch. Columns other than doc_id and text are left out.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.llm.common import UPPER, ship
from sitewright.session import materialize, shuffle_partitions

BUCKETS = 10_000
LONGEST = 2
SAMPLES = 1 << 18
#: Bytes of words a task remembers the code of.
REMEMBERED = 1 << 24
#: Texts are cut into words in lots of about this many bytes.
LOT = 1 << 21
_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
#: A-Z to lower case, other ASCII characters that are no digits or letters to a blank.
_CLEAN = bytes.maketrans(
    UPPER.encode() + bytes(b for b in range(128) if b not in _WORD and chr(b) not in UPPER),
    UPPER.lower().encode() + b" " * sum(b not in _WORD and chr(b) not in UPPER for b in range(128)),
)


def words(text: str) -> list[bytes]:
    return text.encode().translate(_CLEAN).split()


class Crc:
    """crc32 of runs of words, as arrays."""

    def __init__(self):
        self.shifts: dict[int, np.ndarray] = {}
        self.known: dict[bytes, int] = {}
        self.size = 0

    def shift(self, length: int) -> np.ndarray:
        """Four tables of 256: the effect of ``length`` zero bytes on each byte of a code."""
        if length not in self.shifts:
            zeros = bytes(length)
            none = crc32(zeros)
            base = np.array([crc32(zeros, 1 << i) ^ none for i in range(32)], np.uint32)
            tables = np.zeros((4, 256), np.uint32)
            for byte in range(4):
                for bit in range(8):
                    tables[byte, np.arange(256) >> bit & 1 == 1] ^= base[8 * byte + bit]
            if len(self.shifts) > 4096:
                self.shifts.clear()
            self.shifts[length] = tables
        return self.shifts[length]

    def codes(self, found: list[bytes]) -> np.ndarray:
        known = self.known
        for w in set(found).difference(known):
            if self.size > REMEMBERED:
                self.size = 0
                known = self.known = {w: known[w] for w in set(found) if w in known}
            known[w] = crc32(w) << 32 | len(w)
            self.size += len(w) + 64
        return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))

    def joined(self, first: np.ndarray, then: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Codes of first + blank + then, given the codes and the lengths of what follows the blank."""
        out = then.copy()
        order = np.argsort(lengths, kind="stable")
        sizes, at = np.unique(lengths[order], return_index=True)
        led = _look(self.shift(1), first) ^ np.uint32(crc32(b" "))
        for size, rows in zip(sizes.tolist(), np.split(order, at[1:])):
            out[rows] ^= _look(self.shift(size), led[rows])
        return out


def _look(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    low, eight = np.uint32(0xFF), np.uint32(8)
    return tables[0][codes & low] ^ tables[1][codes >> eight & low] ^ tables[2][codes >> np.uint32(16) & low] ^ tables[3][codes >> np.uint32(24)]


def _features(texts: list[str], crc: Crc, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words per text; of all texts together the buckets of all runs, and the text that each run belongs to."""
    found, counts = [], []
    for text in texts:
        own = words(text)
        counts.append(len(own))
        found += own
    packed = crc.codes(found)
    single, lengths = (packed >> np.uint64(32)).astype(np.uint32), (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    code, size, run, of = single, lengths, [single], [owner]
    for n in range(2, longest + 1):
        # A run of n words: one word, a blank, the run of n - 1 words that follows.
        same = owner[: len(owner) - n + 1] == owner[n - 1 :] if len(owner) >= n else np.zeros(0, bool)
        code = crc.joined(single[: len(same)], code[1 : len(same) + 1], size[1 : len(same) + 1])
        size = lengths[: len(same)] + 1 + size[1 : len(same) + 1]
        run.append(code[same])
        of.append(owner[: len(same)][same])
    return np.array(counts, np.int64), np.concatenate(run) % np.uint32(buckets), np.concatenate(of)


def _lots(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts in lots of bounded bytes, with the row each lot begins at."""
    begin, held, size = 0, [], 0
    for i, value in enumerate(column):
        held.append(value.as_py() or "")
        size += len(held[-1])
        if size > LOT:
            yield begin, held
            begin, held, size = i + 1, [], 0
    if held:
        yield begin, held


def _count(batches: Iterator[pa.RecordBatch], longest: int, buckets: int) -> Iterator[pa.RecordBatch]:
    total, crc = np.zeros(buckets, np.int64), Crc()
    for batch in batches:
        for _, texts in _lots(batch.column(0)):
            total += np.bincount(_features(texts, crc, longest, buckets)[1], minlength=buckets)
    there = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there])], ["bucket", "n"])


def bucket_counts(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts lie in each bucket."""
    parts = docs.select("text").mapInArrow(partial(_count, longest=longest, buckets=buckets), "bucket int, n long")
    out = [0] * buckets
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket at most
        out[bucket] = n
    return np.array(out, object)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target share and corpus share of each bucket."""
    buckets, s_all, t_all = len(corpus), int(sum(corpus)), int(sum(target))
    ratio = (float((t + 1) * (s_all + buckets)) / float((s + 1) * (t_all + buckets)) for s, t in zip(corpus, target))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def noise(doc_id: int | None) -> int:
    """Gumbel noise in thousandths, fixed by the id."""
    h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scores(batches: Iterator[pa.RecordBatch], longest: int, gain: np.ndarray) -> Iterator[pa.RecordBatch]:
    crc = Crc()
    for batch in batches:
        for begin, texts in _lots(batch.column(1)):
            counts, buckets, owner = _features(texts, crc, longest, len(gain))
            n = np.bincount(owner, minlength=len(texts))
            total = np.zeros(len(texts), np.int64)
            np.add.at(total, owner, gain[buckets])
            weight = total // np.maximum(n, 1)
            ids = batch.column(0).slice(begin, len(texts))
            score = weight + np.fromiter(map(noise, ids.to_pylist()), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (counts, n, weight, score))], ["doc_id", "n_words", "n_features", "weight", "score"])


def scored(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row."""
    run = partial(_scores, longest=longest, gain=gain)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def _order() -> list[Column]:
    """Highest score first, ties to the smaller id, equal rows by their own number."""
    return [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("row").asc()]


Key = tuple[int, bool, int, int]


def _key(score: int, doc_id: int | None, row: int) -> Key:
    return -score, doc_id is not None, doc_id or 0, row


def _sampled(batches: Iterator[pa.RecordBatch], stride: int) -> Iterator[pa.RecordBatch]:
    seen = 0
    for batch in batches:
        at = np.arange(-seen % stride, batch.num_rows, stride)
        seen += batch.num_rows
        yield batch.take(pa.array(at))


def _placed(batches: Iterator[pa.RecordBatch], cut) -> Iterator[pa.RecordBatch]:
    """The range of each row: each sorted stretch is cut into segments by bisecting it at the splitters."""
    for batch in batches:
        keys = [_key(*k) for k in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("score", "doc_id", "row")))]
        # A task reads several runs one after the other, so a batch may hold the end of one and the begin of the next.
        begins = [0] + [i for i in range(1, len(keys)) if keys[i] < keys[i - 1]] + [len(keys)]
        own = np.zeros(len(keys), np.int32)
        for begin, end in zip(begins, begins[1:]):
            while begin < end:
                here = bisect_right(cut.value, keys[begin])  # a splitter opens its range
                stop = bisect_left(keys, cut.value[here], begin, end) if here < len(cut.value) else end
                own[begin:stop] = here
                begin = stop
        yield pa.RecordBatch.from_arrays([pa.array(own), *batch.columns], ["range", *batch.schema.names])


def _numbered(batches: Iterator[pa.RecordBatch], before: list[int]) -> Iterator[pa.RecordBatch]:
    """Ranks of rows that come sorted by range: what lies before the range, and the place within it."""
    last, place, offsets = -1, 0, np.asarray(before, np.int64)
    for batch in batches:
        part, at = batch.column(0).to_numpy(), np.arange(batch.num_rows)
        if not len(part):
            continue
        start = np.r_[part[0] != last, part[1:] != part[:-1]]
        first = np.maximum.accumulate(np.where(start, at, -place))
        last, place = part[-1], len(part) - first[-1]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(offsets[part] + at - first + 1)], [*batch.schema.names[1:], "rank"])


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes)


def ranked(rows: DataFrame, n_drawn: int, ranges: int | None = None, samples: int = SAMPLES) -> DataFrame:
    """``rows`` with the column rank: the place by score of the ``n_drawn`` first rows, null for the others.

    ``rows`` has doc_id, score and row, a number of its own for each row, and comes from a written table.
    """
    spark = rows.sparkSession
    ranges = ranges or shuffle_partitions(spark)
    runs = materialize(rows.sortWithinPartitions(*_order()), "runs")
    stride = max(1, -(-runs.count() // samples))
    keys = runs.select("score", "doc_id", "row")
    regular = keys.mapInArrow(partial(_sampled, stride=stride), _ddl(keys)).toArrow().to_pylist()
    regular = sorted(_key(r["score"], r["doc_id"], r["row"]) for r in regular)
    splitters = sorted({regular[len(regular) * i // ranges] for i in range(1, ranges)}) if regular else []
    cut = spark.sparkContext.broadcast(splitters)
    placed = runs.mapInArrow(partial(_placed, cut=cut), f"range int, {_ddl(runs)}")
    counts = {r["range"]: r["n"] for r in placed.groupBy("range").agg(F.count("*").alias("n")).collect()}  # one row a range
    before = np.cumsum([0] + [counts.get(i, 0) for i in range(len(splitters) + 1)])[:-1].tolist()
    wanted = sum(b < n_drawn for b in before)
    # A range that begins behind the last drawn rank holds no drawn row: the counts prove it, and it stays where it is.
    behind = placed.where(F.col("range") >= wanted).drop("range").withColumn("rank", F.lit(None).cast("long"))
    sent = placed.where(F.col("range") < wanted).repartitionById(max(1, wanted), F.col("range"))
    merged = sent.sortWithinPartitions("range", *_order()).mapInArrow(partial(_numbered, before=before), f"{_ddl(runs)}, rank long")
    drawn = merged.withColumn("rank", F.when(F.col("rank") <= n_drawn, F.col("rank")))
    return drawn.unionByName(behind)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, ranges: int | None = None, samples: int = SAMPLES
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document; rank is null where it was not drawn.

    ``percent`` of the documents that have at least ``least_words`` words are drawn.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    rows = materialize(scored(docs, gain).withColumn("row", F.monotonically_increasing_id()), "scored")
    able = rows.where(F.col("n_words") >= least_words)
    short = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked(able, percent * able.count() // 100, ranges, samples).unionByName(short).drop("row")


ship(__name__)
