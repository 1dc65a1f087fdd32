"""Language-model scoring: prediction by partial matching over bytes, and a word model to compare with.

Training counts how often each byte follows each context of ``ORDER`` bytes in the training
documents; shorter contexts are sums of these. Together they are a trie of contexts.
A byte is scored in the longest context that the trie holds. Where it never followed there, the
model pays the escape (method D: half the distinct followers over all occurrences; a follower seen
c times has c less a half of them) and goes on in the context without its oldest byte, with the followers of the longer context
excluded. Below order 0 the bytes not yet excluded are equally likely. A text starts after
``ORDER`` start marks and pays for an end mark. Scores are log10 probabilities of whole texts,
from the pretrained trie.

Every node that was counted takes part in scoring, whatever their number; all counts are whole numbers of 64 bits. The nodes
are dealt by the youngest two bytes of the context, so that a part holds all that orders 2 and up of its
contexts need; orders 0 and 1 have at most 65,536 nodes and go to every part. Tasks count into sorted arrays and hand on
one compressed parcel for each part. Documents are taken in chunks of about
``CHUNK`` bytes: a chunk asks each part once for every distinct byte in its context, and the answers meet the
chunk's texts by its number. There is a part for each ``PART`` bytes of training text; a part has more nodes only if one pair of
bytes has more.

The base is the word unigram model with one added to every count. Words that make up at least
1 / ``HEAVY`` of the training tokens, hence at most ``HEAVY`` of them, are looked up where the
documents are; for the others a chunk asks parts of the word counts, once for each distinct word, by a hash of 64 bits
under a salt for which no two words of the training documents have the same.

Null and empty texts consist of the end mark. Without training documents the base is 0
and every byte has probability 1 / 256. Rows are scored one by one, repeated ones too;
columns other than doc_id and text are left out.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.llm.common import UPPER, ship, texts
from sitewright.session import materialize

ORDER = 6
PART = 16 << 20
#: Distinct words of a part of the word counts.
WORDS = 1 << 18
CHUNK = 6_000_000
HEAVY = 1 << 16
START, END = b"\xfe", b"\xff"  # bytes that UTF-8 never has
_FLUSH = 4_000_000
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def split_words(text: str) -> list[bytes]:
    return text.encode().translate(_LOWER).split()


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def flushed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"]
        )

    for batch in batches:
        for text in batch.column(0):
            counts.update(split_words(text.as_py()))
            counts[b""] += 1  # the end
            if len(counts) > 300_000:
                yield flushed()
                counts.clear()
    if counts:
        yield flushed()


def grams(found: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Every byte of the texts behind its context, as one number each; and where each text's begin."""
    data = [t.encode() for t in found]
    stream = np.frombuffer(b"".join(x for d in data for x in (START * order, d, END)), np.uint8)
    keys = np.zeros(len(stream) - order, np.uint64)
    for i in range(order + 1):
        keys <<= np.uint64(8)
        keys |= stream[i : len(stream) - order + i]
    begins = np.cumsum([0, *(len(d) + 1 + order for d in data)])
    return keys, begins


def _inside(begins: np.ndarray, n: int, order: int) -> np.ndarray:
    """Places of ``grams`` that are no start marks."""
    keep = np.ones(n, bool)
    for i in range(1, order + 1):
        keep[begins[1:-1] - i] = False
    return keep


def _gram_counts(batches: Iterator[pa.RecordBatch], order: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Parcels (part, data) of the full-order nodes of texts."""
    held: list[np.ndarray] = []
    keys = counts = None

    def merged(keys, counts):
        new, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        if keys is None:
            return new, n
        return _sums(np.concatenate([keys, new]), np.concatenate([counts, n]))

    def flushed() -> pa.RecordBatch:
        part = _place(keys, parts).astype(np.int32)
        order = np.argsort(part, kind="stable")
        begins = np.searchsorted(part[order], np.arange(parts + 1))
        return _parcels([(p, keys[order[a:b]], counts[order[a:b]]) for p, (a, b) in enumerate(zip(begins, begins[1:])) if a < b])

    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            found, begins = grams(batch.column(0).slice(at, 256).to_pylist(), order)
            held.append(found[_inside(begins, len(found), order)])
            size += len(found)
            if size > _FLUSH:
                keys, counts = merged(keys, counts)
                size = 0
                if len(keys) > _FLUSH:
                    yield flushed()
                    keys = counts = None
    if held:
        keys, counts = merged(keys, counts)
    if keys is not None:
        yield flushed()


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their summed counts, in whole numbers."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts[order], first)


class Trie:
    """Counts of bytes behind contexts of 0 to ``order`` bytes, with what scoring needs of them."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int, low: tuple[np.ndarray, np.ndarray] | None = None):
        """``low``: all nodes of order 1, where ``keys`` are a part of the full-order nodes."""
        self.order = order
        self.nodes, self.contexts = [], []
        for k in range(order, -1, -1):
            if k < order:
                keys, counts = _sums(keys & np.uint64((1 << 8 * (k + 1)) - 1), counts)
            if k == 1 and low is not None:
                keys, counts = low
            above, first = np.unique(keys >> np.uint64(8), return_index=True)
            total = np.add.reduceat(counts, first) if len(first) else np.zeros(0, np.int64)
            kinds = np.diff(np.append(first, len(keys)))
            self.nodes.insert(0, (keys, counts))
            self.contexts.insert(0, [above, total, kinds, None])
        for k in range(1, order + 1):
            # What is excluded one context down: the counts there of the followers here.
            keys, _ = self.nodes[k]
            lower, n = self.nodes[k - 1]
            there = n[np.searchsorted(lower, keys & np.uint64((1 << 8 * k) - 1))]
            above = self.contexts[k][0]
            first = np.searchsorted(keys >> np.uint64(8), above)
            self.contexts[k][3] = np.add.reduceat(there, first) if len(first) else there

    def index(self) -> None:
        """Lay full-order nodes out for direct probes; those that meet another one go to a sorted rest."""
        keys, counts = self.nodes[-1]
        above, total, _, _ = self.contexts[-1]
        at = np.searchsorted(above, keys >> np.uint64(8))
        value = (np.log10(counts - 0.5) - np.log10(total[at])).astype(np.float32) if len(keys) else counts
        bits = max(10, int(len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots = np.full(1 << bits, np.uint64(2**64 - 1))
        self.values = np.zeros(1 << bits, np.float32)
        place = self._place(keys)
        _, first = np.unique(place, return_index=True)
        self.slots[place[first]], self.values[place[first]] = keys[first], value[first]
        rest = np.ones(len(keys), bool)
        rest[first] = False
        self.rest, self.rest_values = keys[rest], value[rest]

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each byte in its context."""
        place = self._place(keys)
        out = self.values[place]
        missing = np.flatnonzero(self.slots[place] != keys)
        if len(missing) and len(self.rest):
            asked = keys[missing]
            at = np.minimum(np.searchsorted(self.rest, asked), len(self.rest) - 1)
            hit = self.rest[at] == asked
            out[missing[hit]] = self.rest_values[at[hit]]
            missing = missing[~hit]
        if len(missing):
            out[missing] = self._escaped(keys[missing])
        return out

    def _escaped(self, keys: np.ndarray) -> np.ndarray:
        keys, back = np.unique(keys, return_inverse=True)
        out = np.zeros(len(keys))
        left = np.arange(len(keys))
        cut_total, cut_kinds = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)  # excluded by the context before
        for k in range(self.order, -1, -1):
            asked = keys[left] & np.uint64((1 << 8 * (k + 1)) - 1)
            above, total, kinds, excluded = self.contexts[k]
            if not len(above):
                break
            c = np.minimum(np.searchsorted(above, asked >> np.uint64(8)), len(above) - 1)
            known = above[c] == asked >> np.uint64(8)
            t, d = total[c] - cut_total[left], kinds[c] - cut_kinds[left]
            nodes, counts = self.nodes[k]
            at = np.minimum(np.searchsorted(nodes, asked), len(nodes) - 1)
            found = nodes[at] == asked
            with np.errstate(divide="ignore", invalid="ignore"):
                out[left[found]] += np.log10((counts[at[found]] - 0.5) / t[found])
                paid = known & ~found & (d > 0)
                out[left[paid]] += np.log10((d / (2 * t))[paid])
            cut_total[left] = np.where(known, excluded[c] if k else 0, 0)
            cut_kinds[left] = np.where(known, kinds[c], 0)
            left = left[~found]
        out[left] -= np.log10(256 - cut_kinds[left])
        return out[back].astype(np.float32)


def _place(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key: a mix of the youngest two bytes of its context."""
    pair = (keys >> np.uint64(8)) & np.uint64(0xFFFF)
    return ((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(parts)


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys.sort()
    return keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys


def _by_part(found: list[str], order: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of texts, by part and then by number, and where each part's begin."""
    held = []
    for at in range(0, len(found), 256):
        keys, begins = grams(found[at : at + 256], order)
        held.append(_distinct(keys[_inside(begins, len(keys), order)]))
    keys = np.concatenate(held)
    held.clear()
    keys = _distinct(keys)
    part = _place(keys, parts).astype(np.int32)
    by_part = np.argsort(part, kind="stable")
    return keys[by_part], np.searchsorted(part[by_part], np.arange(parts + 1))


def _packed(**columns: pa.Array) -> bytes:
    batch = pa.record_batch(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes, column: str) -> pa.Array:
    return pa.ipc.open_stream(data).read_all()[column].combine_chunks()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids and texts in chunks, under a number of their own; the rows are written once."""
    ids, listed, size = [], [], 0

    def flushed() -> pa.RecordBatch:
        data = _packed(ids=pa.array(ids, pa.int64()), texts=pa.array(listed, pa.large_string()))
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([data], pa.binary())], ["chunk", "docs"])

    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(i)
            listed.append(text)
            size += len(text) + ORDER
            if size > CHUNK:
                yield flushed()
                ids, listed, size = [], [], 0
    if ids:
        yield flushed()


def _asked(batches: Iterator[pa.RecordBatch], order: int, parts: int, word_parts: int, salt: str, heavy) -> Iterator[pa.RecordBatch]:
    """The keys and the hashes of words that each part is asked for by a chunk, as steps from one to the next."""
    for batch in batches:
        for chunk, docs in zip(batch.column(0), batch.column(1)):
            listed = _unpacked(docs.as_py(), "texts").to_pylist()
            keys, begins = _by_part(listed, order, parts)
            wanted = [(p, keys[begins[p] : begins[p + 1]]) for p in np.flatnonzero(np.diff(begins)).tolist()]
            _, hashes, by_hash = _rare(listed, heavy.value, salt)
            wanted += _by_word_part(hashes[by_hash], parts, word_parts)
            for p, own in wanted:
                steps = _packed(steps=pa.array(np.diff(own, prepend=np.uint64(0))))
                row = [pa.array([p], pa.int64()), pa.array([chunk.as_py()], pa.int64()), pa.array([steps], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, ["part", "chunk", "data"])


def _parcels(found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """(part, sorted keys, counts) as rows (part, data)."""
    data = [_packed(steps=pa.array(np.diff(k, prepend=np.uint64(0))), n=pa.array(n)) for _, k, n in found]
    return pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in found], pa.int64()), pa.array(data, pa.binary())], ["part", "data"])


def _opened(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(_unpacked(data, "steps").to_numpy()), _unpacked(data, "n").to_numpy()


def _merged_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parcels sorted by part to parcels of at most ``_FLUSH`` nodes, each node of a part in one of them."""
    part, held, waiting = None, [], 0

    def rows() -> pa.RecordBatch:
        keys, counts = _sums(*(np.concatenate(x) for x in zip(*held)))
        return _parcels([(part, keys[a : a + _FLUSH], counts[a : a + _FLUSH]) for a in range(0, len(keys), _FLUSH)])

    for batch in batches:
        for own, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            if own != part:
                if held:
                    yield rows()
                part, held, waiting = own, [], 0
            held.append(_opened(data.as_py()))
            waiting += len(held[-1][0])
            if waiting > max(_FLUSH, 2 * len(held[0][0])):
                held = [_sums(*(np.concatenate(x) for x in zip(*held)))]
                waiting = len(held[0][0])
    if held:
        yield rows()


def _low_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, n): nodes of order 1."""
    low = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for data in batch.column(1):
            keys, counts = _opened(data.as_py())
            np.add.at(low, (keys & np.uint64(0xFFFF)).astype(np.int64), counts)
    there = np.flatnonzero(low)
    yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(low[there])], ["k", "n"])


def _word_hash(salt: str):
    """The hash of a word as Spark's ``xxhash64(salt, word)`` works it out, without its sign."""
    return partial(xxhash.xxh64_intdigest, seed=xxhash.xxh64_intdigest(salt.encode(), 42))


def _word_part(keys: np.ndarray, parts: int, word_parts: int) -> np.ndarray:
    """Word parts are numbered behind the parts of nodes; they are ranges of hashes."""
    return parts + (((keys >> np.uint64(32)) * np.uint64(word_parts)) >> np.uint64(32)).astype(np.int64)


def _by_word_part(keys: np.ndarray, parts: int, word_parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Sorted hashes by part."""
    own = _word_part(keys, parts, word_parts)
    begins = np.searchsorted(own, np.arange(parts, parts + word_parts + 1))
    yield from ((parts + p, keys[a:b]) for p, (a, b) in enumerate(zip(begins, begins[1:])) if a < b)


def _word_parcels(batches: Iterator[pa.RecordBatch], parts: int, word_parts: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys, counts = _sums(batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy())
            own = _word_part(keys, parts, word_parts)
            begins = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            ends = [*begins[1:].tolist(), len(own)]
            yield _parcels([(int(own[a]), keys[a:b], counts[a:b]) for a, b in zip(begins.tolist(), ends)])


def _rare(listed: list[str], known: dict, salt: str) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of texts that are not heavy, their hashes, and the order of these."""
    found: set[bytes] = set()
    for text in listed:
        found.update(split_words(text))
    found.add(b"")
    found.difference_update(known)
    words = list(found)
    hashes = np.fromiter(map(_word_hash(salt), words), np.uint64, len(words))
    return words, hashes, np.argsort(hashes, kind="stable")


def _counts_of(held: list[tuple[np.ndarray, np.ndarray]], asked: np.ndarray) -> np.ndarray:
    """Counts of hashes of words; 0 for words that no training document has."""
    keys, counts = held[0] if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if not len(keys):
        return np.zeros(len(asked), np.int64)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, counts[at], 0)


def _answered(batches: Iterator[pa.RecordBatch], order: int, parts: int, low) -> Iterator[pa.RecordBatch]:
    """Rows (part, chunk, data) sorted by part and chunk: a part's nodes or word counts (chunk null), then what it is asked for."""
    part, held, trie = None, [], None
    for batch in batches:
        for p, chunk, data in zip(*(batch.column(i) for i in range(3))):
            p, chunk, data = p.as_py(), chunk.as_py(), data.as_py()
            if p != part:
                part, held, trie = p, [], None
            if chunk is None:
                held.append(_opened(data))
                continue
            if len(held) > 1:
                held = [_sums(*(np.concatenate(x) for x in zip(*held)))]
            asked = np.cumsum(_unpacked(data, "steps").to_numpy())
            if p >= parts:
                answer = _packed(n=pa.array(_counts_of(held, asked)))
            else:
                if trie is None:
                    trie = Trie(*(held[0] if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))), order, low.value)
                    trie.index()
                    held = []
                # Many bytes have the same few probabilities: their first, second, ... bytes compress well together.
                planes = np.ascontiguousarray(trie.log10(asked).astype("<f4").view(np.uint8).reshape(-1, 4).T)
                answer = zstandard.ZstdCompressor(level=3).compress(planes.tobytes())
            row = [pa.array([chunk], pa.int64()), pa.array([p], pa.int64()), pa.array([answer], pa.binary())]
            yield pa.RecordBatch.from_arrays(row, ["chunk", "part", "data"])


def _scored(batches: Iterator[pa.RecordBatch], order: int, parts: int, salt: str, heavy) -> Iterator[pa.RecordBatch]:
    """Sorted rows (chunk, part, data): a chunk's documents, then the answers to it by part."""
    known, chunk, ids, listed, logs, counts = heavy.value, None, [], [], [], []
    for batch in batches:
        for i in range(batch.num_rows):
            data = batch.column(2)[i].as_py()
            if batch.column(0)[i].as_py() != chunk:
                if ids:
                    yield from _summed(ids, listed, logs, counts, order, parts, salt, known)
                chunk, logs, counts = batch.column(0)[i].as_py(), [], []
                ids, listed = (_unpacked(data, c).to_pylist() for c in ("ids", "texts"))
            elif batch.column(1)[i].as_py() < parts:
                planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
                logs.append(np.ascontiguousarray(planes.T).view("<f4").reshape(-1))
            else:
                counts.append(_unpacked(data, "n").to_numpy())
    if ids:
        yield from _summed(ids, listed, logs, counts, order, parts, salt, known)


def _summed(
    ids: list, listed: list[str], logs: list[np.ndarray], counts: list[np.ndarray], order: int, parts: int, salt: str, known: dict
) -> Iterator[pa.RecordBatch]:
    # Words and keys are found again, in the order in which they were asked for.
    rare, _, by_hash = _rare(listed, known, salt)
    more = np.zeros(len(rare), np.int64)
    more[by_hash] = np.concatenate(counts) if counts else 0
    there = np.flatnonzero(more)
    log_of = (known | dict(zip([rare[i] for i in there.tolist()], np.log10(more[there] + 1).tolist()))).get
    asked, _ = _by_part(listed, order, parts)
    answers = np.concatenate(logs)
    by_key = np.argsort(asked)
    asked, answers = asked[by_key], answers[by_key]
    for at in range(0, len(listed), 256):
        part = listed[at : at + 256]
        keys, begins = grams(part, order)
        inside = _inside(begins, len(keys), order)
        distinct, back = np.unique(keys[inside], return_inverse=True)
        values = np.zeros(len(keys))
        values[inside] = answers[np.searchsorted(asked, distinct)][back]
        sums = np.add.reduceat(values, begins[:-1])
        rows = []
        for text in part:
            words = [*split_words(text), b""]
            there = [x for x in map(log_of, words) if x is not None]
            rows.append((len(words), len(there), sum(there)))
        columns = [pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64()))]
        names = ["doc_id", "n_tokens", "n_known", "base", "score"]
        yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 256], pa.int64()), *columns, pa.array(sums)], names)


def counted_nodes(docs: DataFrame, order: int, parts: int) -> DataFrame:
    """(part, data): all full-order nodes of the training documents, written once."""
    counted = texts(docs).select("text").mapInArrow(partial(_gram_counts, order=order, parts=parts), "part long, data binary")
    own = counted.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part")
    return materialize(own.mapInArrow(_merged_parts, "part long, data binary"), "grams")


def word_counts(docs: DataFrame) -> tuple[DataFrame, str]:
    """(word, c, h) of all words of the training documents, and the salt under which no two words share the hash h."""
    counts = texts(docs).select("text").mapInArrow(_word_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))
    counts, salt = materialize(counts, "words"), 0
    while True:
        hashed = counts.withColumn("h", F.xxhash64(F.lit(str(salt)), "word"))
        if hashed.groupBy("h").count().where("count > 1").isEmpty():
            return hashed, str(salt)
        salt += 1


def score(docs: DataFrame, learn: Column, order: int = ORDER, part: int = PART) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row; ``learn`` says which ids train."""
    spark = docs.sparkSession
    learned = docs.where(learn)
    words, salt = word_counts(learned)
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    often = words.where(F.col("c") * HEAVY >= total.n).collect()  # at most HEAVY rows
    heavy = spark.sparkContext.broadcast({bytes(r.word): math.log10(r.c + 1) for r in often})
    size = learned.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    parts, word_parts = max(1, -(-size // part)), max(1, -(-total.v // WORDS))
    counted = counted_nodes(learned, order, parts)
    low = counted.mapInArrow(_low_counts, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).orderBy("k").toArrow()  # at most 65,536 rows
    low = spark.sparkContext.broadcast((low["k"].to_numpy().astype(np.uint64), low["n"].to_numpy()))
    chunks = materialize(texts(docs).mapInArrow(_chunks, "chunk long, docs binary"), "chunks")
    held = counted.unionByName(words.select("h", "c").mapInArrow(partial(_word_parcels, parts=parts, word_parts=word_parts), "part long, data binary"))
    asked = chunks.mapInArrow(
        partial(_asked, order=order, parts=parts, word_parts=word_parts, salt=salt, heavy=heavy), "part long, chunk long, data binary"
    )
    rows = held.select("part", F.lit(None).cast("long").alias("chunk"), "data").unionByName(asked)
    tasks = min(parts + word_parts, 100_000)
    dealt = rows.repartitionById(tasks, F.pmod("part", F.lit(tasks)).cast("int")).sortWithinPartitions("part", F.asc_nulls_first("chunk"))
    answers = dealt.mapInArrow(partial(_answered, order=order, parts=parts, low=low), "chunk long, part long, data binary")
    texts_of = chunks.select("chunk", F.lit(-1).cast("long").alias("part"), F.col("docs").alias("data"))
    met = texts_of.unionByName(answers).repartition("chunk").sortWithinPartitions("chunk", "part")
    done = met.mapInArrow(
        partial(_scored, order=order, parts=parts, salt=salt, heavy=heavy), "doc_id long, n_tokens long, n_known long, base double, score double"
    )
    each = F.lit(math.log10(total.n + total.v + 1))
    return done.select(
        "doc_id",
        "n_tokens",
        "n_known",
        F.lit(total.n).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * each).alias("base_score"),
        "score",
    )


ship(__name__)
