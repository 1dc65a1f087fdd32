"""Byte-level BPE by a tokenizer file in JSON, encoding each shared chunk of text once.

1. *Cut.* A rolling hash over the bytes chooses chunk borders by content, so copies and shared passages are
   cut alike wherever they stand. A task gathers documents into windows of about ``WINDOW`` bytes; of each window it hands
   on every distinct chunk once, packed by the chunk's bucket, and a list of the chunk numbers of its documents.
2. *Encode.* A bucket meets the chunks of ``GROUP`` windows (8 GB of text) in one task and encodes each distinct one once. Its
   ids go back to the windows that asked, once a window, however many documents hold the chunk. A chunk that is in
   every document therefore is one row a window, and no task sees more than ``GROUP`` of them.
3. *Repair.* A window's task walks along each document. The split pattern looks ahead only, so from a word border on, words
   depend on what follows alone: words of a chunk stand as encoded up to the few that its end may have
   cut. There the text is read anew, word by word across the join, until a word border falls on a border of the next chunk; from
   that exact agreement on, the chunk's ids are taken again.

Added tokens of the file (``<|endoftext|>``) are found before anything else, as the tokenizers library does, and part
the text. Merges are by pair, in the order of the file. Decoding concatenates the pieces of the ids.

The file is read by the driver and broadcast (a vocabulary is bounded); executors need no file. A task holds one window or
a table of at most ``REMEMBERED`` bytes of encoded chunks and ``WORD_BYTES`` of words, which are emptied when full; an emptied
entry is encoded again. Null and empty texts give no ids. Rows are kept apart by their place, so repeated rows and repeated or
null ids are returned once per row. A very long text is a window of its own. Columns other than doc_id and text are left out.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.llm.common import ship, texts
from sitewright.session import shuffle_partitions

#: Bytes of text of a window.
WINDOW = 8 << 20
#: Windows among which a chunk is encoded once, and the buckets their chunks are dealt to.
GROUP, BUCKETS = 1024, 64
#: Mean and largest bytes of a chunk.
CHUNK, LONGEST = 1024, 1 << 16
#: Bytes of encoded chunks, and of words, that a task remembers.
REMEMBERED, WORD_BYTES = 64 << 20, 16 << 20
#: Bytes of text whose chunks are encoded together.
LOT = 1 << 20
#: Up to this many bytes a word is scanned for its lowest pair; longer ones use a heap.
SCANNED = 64
_LEVEL = 6
_NEVER = 1 << 62
# Letters and numbers that the regex module knows and the tokenizers library (Unicode 16) does not.
_NEWER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 "
    "10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF "
    "18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF "
    "1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)


def _alphabet() -> dict[str, int]:
    """The byte that each character of a piece stands for: printable bytes stand for themselves, the others follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """What a tokenizer file says: pieces by id, merges by pair of ids, added tokens."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        bytes_of = _alphabet()
        ids = given["model"]["vocab"]
        self.pieces = {i: bytes(bytes_of[c] for c in piece) for piece, i in ids.items() if all(c in bytes_of for c in piece)}
        self.added = {t["content"]: t["id"] for t in given["added_tokens"]}
        self.pieces |= {i: text.encode() for text, i in self.added.items()}
        self.size = max(self.pieces) + 1
        self.single = [ids[c] for c, _ in sorted(bytes_of.items(), key=lambda x: x[1])]
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(given["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[a] * self.size + ids[b]] = rank * self.size + ids[a + b]
        self.pattern = pattern

    @classmethod
    def of(cls, plain: dict) -> Vocabulary:
        """A vocabulary from the values of another one, as they were broadcast."""
        own = cls.__new__(cls)
        vars(own).update(plain)
        return own


def _narrow(pattern: str) -> str:
    """The split pattern for texts whose characters are all below 256, for the faster ``re``."""
    import unicodedata

    def members(kind: str) -> str:
        return "".join(f"\\x{c:02x}" for c in range(256) if unicodedata.category(chr(c))[0] == kind)

    space = "".join(f"\\x{c:02x}" for c in (9, 10, 11, 12, 13, 32, 0x85, 0xA0))
    letters, numbers = members("L"), members("N")
    both = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{numbers}]")
    return both.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]")


class Words(dict):
    """Ids of words as bytes. Words of a text that are new are folded together; a single one when it is asked for."""

    def __init__(self, fold):
        self.fold, self.held = fold, 0

    def __missing__(self, word: str) -> bytes:
        self.learn([word])
        return self[word]

    def learn(self, found: Iterable[str]) -> None:
        if self.held > WORD_BYTES:
            self.clear()
            self.held = 0
        new = [w for w in set(found) if w not in self]
        for word, ids in zip(new, self.fold([w.encode() for w in new])):
            self[word] = ids
            self.held += len(word) + len(ids) + 120


class Encoder:
    """Words and their ids."""

    def __init__(self, known: Vocabulary):
        self.v = known
        self.wide = np.dtype(np.uint32 if known.size > 1 << 16 else np.uint16)
        newer = "".join("-".join(rf"\U{int(x, 16):08X}" for x in r.split("-")) for r in _NEWER.split())
        self.newer = regex.compile(f"[{newer}]")
        exact = known.pattern.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{newer}])")
        for kind in (r" ?\p{L}+", r" ?\p{N}+"):
            exact = exact.replace(kind, rf" ?[{kind[2:-1]}--[{newer}]]+")
        self.plain, self.exact = regex.compile(known.pattern), regex.compile(exact, regex.V1)
        self.narrow = re.compile(_narrow(known.pattern))
        order = np.argsort(np.fromiter(known.merges, np.int64, len(known.merges)))
        self.pairs = np.fromiter(known.merges, np.int64, len(known.merges))[order]
        self.values = np.fromiter(known.merges.values(), np.int64, len(known.merges))[order]
        self.single = np.array(known.single, np.int64)
        self.words = Words(self.fold_all)

    def splitter(self, text: str):
        """The split pattern for this text, by the library's tables."""
        if text.isascii() or len(text.encode("latin-1", "ignore")) == len(text):
            return self.narrow
        return self.exact if self.newer.search(text) else self.plain

    def ids_of(self, word: str) -> np.ndarray:
        return np.frombuffer(self.words[word], self.wide)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as bytes."""
        found = [self.splitter(t).findall(t) for t in texts]
        self.words.learn(chain.from_iterable(found))
        return [b"".join(map(self.words.__getitem__, f)) for f in found]

    def fold_all(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word: words of up to ``SCANNED`` bytes are folded side by side, as rows of arrays."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for low, high in zip((0, 8, 16, 32), (8, 16, 32, SCANNED)):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            if len(rows) < 64:
                for i in rows.tolist():
                    out[i] = np.array(self.fold(words[i]), self.wide).tobytes()
            else:
                for i, ids in zip(rows.tolist(), self._fold_rows([words[i] for i in rows.tolist()], sizes[rows], high)):
                    out[i] = ids
        for i in np.flatnonzero(sizes > SCANNED).tolist():
            out[i] = np.array(self._fold_long(words[i]), self.wide).tobytes()
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.v.size + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (a >= 0) & (b >= 0), self.values[at], _NEVER)

    def _fold_rows(self, words: list[bytes], sizes: np.ndarray, width: int) -> list[bytes]:
        """In every row the lowest pair is merged, the leftmost of them first; rows without a pair are done."""
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        column = np.arange(width + 1)
        ids = np.full((len(words), width + 1), -1, np.int64)
        ids[:, :width] = np.where(column[:width] < sizes[:, None], self.single[raw], -1)
        found = np.full((len(words), width + 1), _NEVER, np.int64)
        found[:, : width - 1] = self._ranks(ids[:, : width - 1], ids[:, 1:width])
        done, left = [b""] * len(words), np.arange(len(words))
        while len(left):
            at = found.argmin(1)
            row = np.arange(len(left))
            best = found[row, at]
            over = best == _NEVER
            if over.any():
                for i, own in zip(left[over].tolist(), ids[over]):
                    done[i] = own[own >= 0].astype(self.wide).tobytes()
                keep = ~over
                left, ids, found, at, best = left[keep], ids[keep], found[keep], at[keep], best[keep]
                row = np.arange(len(left))
            if not len(left):
                break
            after = np.minimum(column + (column > at[:, None]), width)
            ids, found = np.take_along_axis(ids, after, 1), np.take_along_axis(found, after, 1)
            own = best % self.v.size
            ids[row, at] = own
            found[row, at] = self._ranks(own, ids[row, at + 1])
            has = at > 0
            found[row[has], at[has] - 1] = self._ranks(ids[row[has], at[has] - 1], own[has])
        return done

    def fold(self, word: bytes) -> list[int]:
        """The pair of lowest rank is merged, the leftmost of them first, until no pair has a rank."""
        if len(word) > SCANNED:
            return self._fold_long(word)
        size, get = self.v.size, self.v.merges.get
        ids = [self.v.single[b] for b in word]
        found = [get(a * size + b, _NEVER) for a, b in zip(ids, ids[1:])]
        while found and (best := min(found)) < _NEVER:
            at = found.index(best)
            ids[at : at + 2] = [own] = [best % size]
            del found[at]
            if at:
                found[at - 1] = get(ids[at - 1] * size + own, _NEVER)
            if at < len(found):
                found[at] = get(own * size + ids[at + 1], _NEVER)
        return ids

    def _fold_long(self, word: bytes) -> list[int]:
        """The same merges by a heap of pairs over linked ids."""
        size, get, n = self.v.size, self.v.merges.get, len(word)
        ids: list[int] = [self.v.single[b] for b in word]
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := get(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = m % size, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else -1
                if right >= 0 and (m := get(ids[left] * size + ids[right])) is not None:
                    heapq.heappush(heap, (m, left, ids[left], ids[right]))
        out, i = [], 0
        while i >= 0:
            out.append(ids[i])
            i = after[i]
        return out


# --- cutting -----------------------------------------------------------------

_GEAR = np.random.default_rng(20240131).integers(0, 1 << 32, 256, np.uint32)


def borders(data: bytes) -> list[int]:
    """Where chunks begin, and the end: chosen by a rolling hash over 16 bytes, at characters only."""
    n = len(data)
    raw = np.frombuffer(data, np.uint8)
    h = _GEAR[raw]
    for step in (1, 2, 4, 8):  # after them h[i] depends on the 16 bytes up to i
        h[step:] += h[:-step] << np.uint32(step) if len(h) > step else h[:0]
    h *= np.uint32(0x9E3779B1)
    at = np.flatnonzero(h >> np.uint32(32 - (CHUNK.bit_length() - 1)) == 0) + 1
    chosen = at[at < n][(raw[at[at < n]] & 0xC0) != 0x80].tolist()
    out = [0]
    for b in [*chosen, n]:
        while b - out[-1] > LONGEST:
            cut = out[-1] + LONGEST
            while raw[cut] & 0xC0 == 0x80:
                cut -= 1
            out.append(cut)
        out.append(b)
    return out if n else [0]


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=_LEVEL).compress(data)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


_NAMES = ["window", "bucket", "numbers", "lengths", "data"]
_CUT = "window long, bucket long, numbers binary, lengths binary, data binary"


def _window_rows(ids: list, docs: list[str], window: int, added: dict[str, int]) -> pa.RecordBatch:
    """The distinct chunks of a window by bucket, and its list of documents (bucket -1)."""
    part = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
    known: dict[bytes, int] = {}
    listed, sizes = [], []
    for text in docs:
        before, at = len(listed), 0
        marks = [*part.finditer(text)] if part else []
        for mark in [*marks, None]:
            data = text[at : mark.start() if mark else len(text)].encode()
            cuts = borders(data)
            listed += [known.setdefault(data[a:b], len(known)) for a, b in zip(cuts, cuts[1:])]
            if mark:
                listed.append(-1 - added[mark.group()])
                at = mark.end()
        sizes.append(len(listed) - before)
    group = window // GROUP
    chunks = list(known)
    own = [int.from_bytes(hashlib.blake2b(c, digest_size=4).digest(), "little") % BUCKETS for c in chunks]
    rows = []
    for bucket in sorted(set(own)):
        numbers = [i for i, b in enumerate(own) if b == bucket]
        lengths = np.array([len(chunks[i]) for i in numbers], np.uint32)
        rows.append((window, group * BUCKETS + bucket, np.array(numbers, np.uint32).tobytes(), lengths.tobytes(), _pack(b"".join(chunks[i] for i in numbers))))
    has = np.array([i is not None for i in ids], np.uint8)
    keys = np.array([i or 0 for i in ids], np.int64)
    manifest = (window, -1, has.tobytes() + keys.tobytes(), np.array(sizes, np.uint32).tobytes(), _pack(np.array(listed, np.int32).tobytes()))
    columns = list(zip(*rows, manifest))
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _NAMES)


def _cut(batches: Iterator[pa.RecordBatch], added: dict[str, int], window_bytes: int) -> Iterator[pa.RecordBatch]:
    ids, docs, size, n = [], [], 0, 0
    per_task = GROUP // 16  # window numbers a task usually needs; a task of more goes on in numbers no other task has
    task = TaskContext.get().partitionId()

    def window() -> int:
        return task * per_task + n if n < per_task else (1 << 40) + (task << 20) + n

    for batch in batches:
        for own, text in zip(batch.column(0), batch.column(1)):
            ids.append(own.as_py())
            docs.append(text.as_py())
            size += len(docs[-1])
            if size > window_bytes:
                yield _window_rows(ids, docs, window(), added)
                ids, docs, size, n = [], [], 0, n + 1
    if ids:
        yield _window_rows(ids, docs, window(), added)


# --- encoding ----------------------------------------------------------------


def _encode(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    """Chunks to their ids and the number of ids of each; every distinct chunk of a bucket is encoded once."""
    encoder = Encoder(Vocabulary.of(vocabulary.value))
    known: dict[bytes, bytes] = {}
    held, last, lot, size = 0, None, [], 0

    def rows() -> pa.RecordBatch:
        """The parcels of a lot, their new chunks encoded together."""
        nonlocal held
        chunks, out = [], []
        for _, _, _, lengths, data in lot:
            raw, ends = _unpack(data), np.cumsum(np.frombuffer(lengths, np.uint32)).tolist()
            chunks.append([raw[a:b] for a, b in zip([0, *ends], ends)])
        keys = [[hashlib.blake2b(c, digest_size=16).digest() for c in parcel] for parcel in chunks]
        new = {k: c for own, parcel in zip(keys, chunks) for k, c in zip(own, parcel) if k not in known}
        for key, ids in zip(new, encoder.encode([c.decode() for c in new.values()])):
            known[key] = ids
            held += len(ids) + 150
        for (window, bucket, numbers, _, _), own in zip(lot, keys):
            found = [known[k] for k in own]
            counts = np.array([len(i) // encoder.wide.itemsize for i in found], np.uint32)
            out.append((window, bucket, numbers, counts.tobytes(), _pack(b"".join(found))))
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], _NAMES)

    for batch in batches:
        for row in range(batch.num_rows):
            if batch.column(1)[row].as_py() < 0:
                yield batch.slice(row, 1)
                continue
            parcel = tuple(c[row].as_py() for c in batch.columns)
            if lot and (parcel[1] != last or size > LOT):
                yield rows()
                lot, size = [], 0
            if parcel[1] != last or held > REMEMBERED:
                known, held = {}, 0
            last = parcel[1]
            lot.append(parcel)
            size += int(np.frombuffer(parcel[3], np.uint32).sum())
    if lot:
        yield rows()


# --- repair ------------------------------------------------------------------


class Chunk:
    """An encoded chunk: its ids, its text, and where each id ends in its bytes."""

    def __init__(self, ids: np.ndarray, pieces: list[bytes], sizes: np.ndarray):
        self.ids = ids
        self.text = b"".join(map(pieces.__getitem__, ids.tolist())).decode()
        self.ends = np.cumsum(sizes[ids])


def joined(chunks: list[Chunk], encoder: Encoder) -> list[np.ndarray]:
    """Ids of the text that the chunks make up, as if it had been encoded whole."""
    if not chunks:
        return []
    if len(chunks) == 1:
        return [chunks[0].ids]
    text = "".join(c.text for c in chunks)
    # One pattern serves a document and its chunks: patterns agree where a text does not need the wider one.
    whole, out = encoder.splitter(text), []
    at, begin = 0, 0  # the text is encoded up to ``at``, a word border; the chunk begins at ``begin``
    for number, chunk in enumerate(chunks):
        end, own = begin + len(chunk.text), Borders(chunk, whole)
        while at < end:
            border = at - begin
            if border and border not in own:
                found = whole.match(text, at)  # a word across the join
                out.append(encoder.ids_of(found.group()))
                at = found.end()
                continue
            # Agreement: from here on the words are the chunk's own, up to those that its end may have cut.
            stop = len(chunk.text) if number == len(chunks) - 1 else _sure(chunk.text, border, whole)
            if stop > border:
                out.append(chunk.ids[_place(chunk, border) : _place(chunk, stop)])
                at = begin + stop
            if at < end:
                found = whole.match(text, at)
                out.append(encoder.ids_of(found.group()))
                at = found.end()
        begin = end
    return out


def _bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


def _place(chunk: Chunk, border: int) -> int:
    """Number of ids before a character of the chunk."""
    return int(np.searchsorted(chunk.ends, _bytes(chunk.text[:border]), "right")) if border else 0


class Borders:
    """Word borders of a chunk as it was encoded by itself, asked for from left to right."""

    def __init__(self, chunk: Chunk, split):
        self.starts = (m.start() for m in split.finditer(chunk.text))
        self.now = 0

    def __contains__(self, border: int) -> bool:
        while 0 <= self.now < border:
            self.now = next(self.starts, -1)
        return self.now == border


def _sure(text: str, border: int, split) -> int:
    """The end of the chunk's words that do not change whatever text follows.

    A word is sure if it ends before the text does and the pattern's longest contraction, of three characters, fits
    behind its begin. Near the end words are found from a sure border: one between a letter and a blank.
    """
    n, reach = len(text), 48
    while True:
        # Python's letters are letters of the pattern too.
        start = next((i for i in range(max(border + 1, n - reach), n) if text[i] == " " and text[i - 1].isalpha()), border)
        if start > border or n - reach <= border:
            break
        reach *= 4
    stop = start
    for found in split.finditer(text, start):
        if found.end() >= n or found.start() + 3 > n:
            break
        stop = found.end()
    return stop


def _assemble(batches: Iterator[pa.RecordBatch], vocabulary, digests: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by window, its list of documents first, to tokens of its documents."""
    encoder = Encoder(Vocabulary.of(vocabulary.value))
    wide = encoder.wide
    pieces = [encoder.v.pieces.get(i, b"") for i in range(encoder.v.size)]
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    spelled = [str(i) for i in range(encoder.v.size)] if digests else []
    window, listing, found = None, None, {}

    def rows() -> Iterator[pa.RecordBatch]:
        keys, sizes, data = listing
        count = len(sizes) // 4
        has, ids = keys[:count], np.frombuffer(keys, np.int64, count, count).tolist()
        numbers, at, out = np.frombuffer(_unpack(data), np.int32).tolist(), 0, []
        for i, size in enumerate(np.frombuffer(sizes, np.uint32).tolist()):
            parts, run = [], []
            for number in numbers[at : at + size]:
                if number >= 0:
                    run.append(Chunk(np.frombuffer(found[number], wide), pieces, lengths))
                else:
                    parts += joined(run, encoder) + [np.array([-1 - number], wide)]
                    run = []
            parts += joined(run, encoder)
            at += size
            own = np.concatenate(parts).tolist() if parts else []
            if digests:
                listed = hashlib.sha256(",".join(map(spelled.__getitem__, own)).encode()).hexdigest()
                text = b"".join(map(pieces.__getitem__, own)).decode("utf-8", "replace")
                out.append((ids[i] if has[i] else None, len(own), listed, hashlib.sha256(text.encode()).hexdigest()))
            else:
                out.append((ids[i] if has[i] else None, len(own), own))
            if len(out) == 256:
                yield batch_of(out)
                out = []
        yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()] if digests else [pa.int64(), pa.int64(), pa.list_(pa.int32())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "n_tokens", "ids"]
        columns = list(zip(*out)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    for batch in batches:
        for own, bucket, numbers, counts, data in zip(*(c.to_pylist() for c in batch.columns)):
            if own != window:
                if window is not None:
                    yield from rows()
                window, found = own, {}
            if bucket < 0:
                listing = (numbers, counts, data)
                continue
            raw, at = _unpack(data), 0
            for number, n in zip(np.frombuffer(numbers, np.uint32).tolist(), np.frombuffer(counts, np.uint32).tolist()):
                found[number] = raw[at : at + n * wide.itemsize]
                at += n * wide.itemsize
    if window is not None:
        yield from rows()


def _tokens(docs: DataFrame, vocabulary: Vocabulary, digests: bool, schema: str, window_bytes: int) -> DataFrame:
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    shipped = spark.sparkContext.broadcast(vars(vocabulary))
    cut = texts(docs).mapInArrow(partial(_cut, added=vocabulary.added, window_bytes=window_bytes), _CUT)
    # Lists of documents need no encoding; they pass through the task of their window's number.
    to = F.pmod(F.when(F.col("bucket") < 0, F.col("window")).otherwise(F.col("bucket")), F.lit(n)).cast("int")
    encoded = cut.repartitionById(n, to).sortWithinPartitions("bucket", "window").mapInArrow(partial(_encode, vocabulary=shipped), _CUT)
    back = encoded.repartitionById(n, F.pmod(F.col("window"), F.lit(n)).cast("int")).sortWithinPartitions("window", "bucket")
    return back.mapInArrow(partial(_assemble, vocabulary=shipped, digests=digests), schema)


def encode(docs: DataFrame, vocabulary: Vocabulary, window_bytes: int = WINDOW) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row."""
    return _tokens(docs, vocabulary, False, "doc_id long, n_tokens long, ids array<int>", window_bytes)


def _decoded(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    pieces = vocabulary.value["pieces"]
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            data = [b"".join(map(pieces.__getitem__, ids.as_py() or ())).decode("utf-8", "replace") for ids in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(data, pa.string())], ["doc_id", "text"])


def decode(tokens: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, text) of every row of (doc_id, ids); null ids give an empty text."""
    shipped = tokens.sparkSession.sparkContext.broadcast(vars(vocabulary))
    return tokens.select("doc_id", "ids").mapInArrow(partial(_decoded, vocabulary=shipped), "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: Vocabulary, window_bytes: int = WINDOW) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoded, listed in decimal with commas, decoded, digested."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _tokens(docs, vocabulary, True, schema, window_bytes)


ship(__name__)
