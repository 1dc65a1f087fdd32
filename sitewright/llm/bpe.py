"""Byte-level BPE encoding and decoding by a ranks file of a public tokenizer.

Each match of the split pattern is encoded by itself: its bytes are pieces, and the
adjacent pair of lowest rank is merged until no pair has a rank. Only the distinct words
of a task are folded; their ids are looked up for every further occurrence. Decoding
concatenates the binary piece of every id.

The work is one narrow stage of Arrow batches: no shuffle, and a lost executor costs the
partitions it held. The ranks are read by the driver and broadcast, so executors need no file. A task's memory is
the ranks, one batch and two tables of words of about ``CACHED`` bytes each: when one is full, the words of the older one are
forgotten, unless they have occurred again.

Null and empty texts give no ids. Ids of documents that occur repeatedly are returned
once per row. White space, control strings such as ``<|endoftext|>`` and any other text
are ordinary text. Columns other than doc_id and text are left out.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import partial
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from sitewright.llm.common import ship, texts

#: Bytes of words, their ids and what Python needs to hold them in each of the two tables that a task remembers.
CACHED = 20 << 20
#: Texts and ids are handed on in lots of about this many characters or ids.
LOT = 1 << 20
#: Up to this many bytes a word is scanned for its lowest pair; longer ones use a heap.
SCANNED = 48
NEVER = 1 << 30


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank of every piece of a ranks file: base64 of the piece, a space, its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word by ranked merges."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > SCANNED:
        return _fold_long(word, ranks)
    get = ranks.get
    pieces = [word[i : i + 1] for i in range(len(word))]
    found = [get(word[i : i + 2], NEVER) for i in range(len(word) - 1)]
    while found and (best := min(found)) < NEVER:
        at = found.index(best)
        pieces[at : at + 2] = [both] = [pieces[at] + pieces[at + 1]]
        del found[at]
        if at:
            found[at - 1] = get(pieces[at - 1] + both, NEVER)
        if at < len(found):
            found[at] = get(both + pieces[at + 1], NEVER)
    return [ranks[p] for p in pieces]


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges in n log n: a heap of pairs over linked pieces."""
    n = len(word)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (rank := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        alive[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def pieces_of(ranks: dict[bytes, int]) -> list[bytes]:
    """Pieces by id."""
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, i in ranks.items():
        out[i] = piece
    return out


class Tokenizer:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.matches = regex.compile(pattern).findall
        self.pieces = pieces_of(ranks)
        self.known: dict[str, list[int]] = {}
        self.earlier: dict[str, list[int]] = {}
        self.held = 0

    def encode(self, text: str) -> list[int]:
        found = self.matches(text)
        known = self.known
        if self.held > CACHED:
            self.held, self.earlier, known = 0, known, {}
            self.known = known
        for word in set(found).difference(known):
            ids = known[word] = self.earlier.get(word) or fold(word.encode(), self.ranks)
            self.held += 200 + len(word) + 8 * len(ids)
        return list(chain.from_iterable(map(known.__getitem__, found)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


def _lots(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Begin and end of runs of rows, of about ``LOT`` characters or ids each."""
    begin, size = 0, 0
    for i, n in enumerate(pc.coalesce(pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column), 0).to_pylist()):
        size += n
        if size > LOT:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(column):
        yield begin, len(column)


def _each(batches: Iterator[pa.RecordBatch], ranks, pattern: str, digests: bool) -> Iterator[pa.RecordBatch]:
    own = Tokenizer(ranks.value, pattern)
    spelled = [str(i) for i in range(len(own.pieces))] if digests else []
    kinds = [pa.int64(), pa.string(), pa.string()] if digests else [pa.int64(), pa.list_(pa.int32())]
    names = ["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids"])]
    for batch in batches:
        for begin, end in _lots(batch.column(1)):
            rows = []
            for text in batch.column(1).slice(begin, end - begin):
                ids = own.encode(text.as_py())
                if digests:
                    listed = " ".join(map(spelled.__getitem__, ids)).encode()
                    rows.append((len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))
                else:
                    rows.append((len(ids), ids))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), *map(pa.array, zip(*rows), kinds)], names)


def _back(batches: Iterator[pa.RecordBatch], ranks) -> Iterator[pa.RecordBatch]:
    pieces = pieces_of(ranks.value)
    for batch in batches:
        for begin, end in _lots(batch.column(1)):
            data = [b"".join(map(pieces.__getitem__, ids.as_py() or ())) for ids in batch.column(1).slice(begin, end - begin)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array(data, pa.binary())], ["doc_id", "bytes"])


def _shipped(docs: DataFrame, path: str):
    return docs.sparkSession.sparkContext.broadcast(read_ranks(path))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row."""
    run = partial(_each, ranks=_shipped(docs, path), pattern=pattern, digests=False)
    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, bytes) of every row of (doc_id, ids); null ids give no bytes."""
    return tokens.select("doc_id", "ids").mapInArrow(partial(_back, ranks=_shipped(tokens, path)), "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoded, listed in decimal, decoded, digested in one pass."""
    run = partial(_each, ranks=_shipped(docs, path), pattern=pattern, digests=True)
    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


ship(__name__)
