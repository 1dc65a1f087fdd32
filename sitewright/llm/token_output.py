"""Training-order materialisation: every sequence of token ids in its global slot, in fixed-stride binary shards.

Documents' ids are cut into sequences of ``length`` ids; the last one of a document is filled up with zeros. Sequences are
numbered by document (id, then a hash of the text) and place. A keyed Feistel permutation turns the number into the
slot: over a domain of two digits in radices just above the square root of their number, with cycle-walking for the few
numbers beyond, so slots are exactly 0 to N - 1, and an order needs no shuffle buffer, only its key.

Slots are dealt by range: shard s holds slots s * per_shard up to the next, in order, one record of ``length`` ids each,
little-endian, nothing else. So slot k is at a known place, reading is sequential, and a reader resumes at any slot
(``read_slots``). Sequences travel packed by shard and compressed. A shard (``SHARD_BYTES``) is put together by one task, written
under a name of its own and then renamed, so a repeated task replaces it as a whole. Files go to a folder every executor can reach, by its own file system.

Ids here are bytes of UTF-8 (one byte an id); other ids come as binary too, ``width`` bytes an id. Null and empty texts have
no sequences. Rows that are equal are numbered one after the other; every row's sequences are written. Other columns are left out.
An empty table gives no shard.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewright.llm.common import ship
from sitewright.session import materialize, shuffle_partitions

LENGTH = 512
SHARD_BYTES = 16 << 20
#: Bytes of sequences that a task gathers before it packs them by shard.
PARCEL = 32 << 20
ROUNDS = 6
PRIME = (1 << 31) - 1
#: Documents whose first number may be broadcast: about 50 MB.
SMALL = 500_000


@dataclass(frozen=True)
class Feistel:
    """A permutation of 0 to n - 1, the same for the same key."""

    n: int
    key: int

    @property
    def radices(self) -> tuple[int, int]:
        a = max(1, int(self.n**0.5))
        while a * a < self.n:
            a += 1
        return a, max(1, -(-self.n // a))

    @property
    def walks(self) -> int:
        """Steps after which a walk has ended, but for a chance below 2 ** -128."""
        a, b = self.radices
        beyond, steps, chance = a * b - self.n, 0, 1.0
        while chance > 2.0**-128 and steps <= beyond:
            chance *= beyond / (a * b)
            steps += 1
        return steps

    def keys(self, i: int) -> tuple[int, int]:
        digest = hashlib.sha256(f"{self.key}:{i}".encode()).digest()
        return int.from_bytes(digest[:4], "big") % (PRIME - 1) + 1, int.from_bytes(digest[4:8], "big") % PRIME

    def number(self, x: int) -> int:
        a, b = self.radices
        while True:
            left, right = divmod(x, b)
            for i in range(ROUNDS):
                m, k = self.keys(i)
                if i % 2 == 0:
                    y = (right * m + k) % PRIME
                    left = (left + y * y % PRIME) % a
                else:
                    y = (left * m + k) % PRIME
                    right = (right + y * y % PRIME) % b
            x = left * b + right
            if x < self.n:
                return x

    def once(self, x: str) -> str:
        """SQL of one application to ``x``; intermediate digits are bound by name."""
        a, b = self.radices
        sql = f"struct({x} div {b}L as l, {x} % {b}L as r)"
        for i in range(ROUNDS):
            m, k = self.keys(i)
            moved, other, radix = ("l", "r", a) if i % 2 == 0 else ("r", "l", b)
            y = f"((s.{other} * {m}L + {k}L) % {PRIME}L)"
            new = f"(s.{moved} + {y} * {y} % {PRIME}L) % {radix}L"
            parts = f"{new} as l, s.r as r" if moved == "l" else f"s.l as l, {new} as r"
            sql = f"transform(array({sql}), s -> struct({parts}))[0]"
        return f"transform(array({sql}), s -> s.l * {b}L + s.r)[0]"

    def column(self, x: str) -> Column:
        walked = f"aggregate(sequence(1, {max(1, self.walks)}), {self.once(x)}, (v, i) -> if(v < {self.n}L, v, {self.once('v')}))"
        return F.expr(walked)


def numbered(docs: DataFrame, length: int, width: int) -> tuple[DataFrame, int]:
    """(id, version, copies, sequences, first) of documents, and the number of all sequences."""
    size = F.octet_length("ids")
    counts = (
        docs.where(size > 0)
        .groupBy(F.col("doc_id").alias("id"), F.xxhash64("ids").alias("version"), F.ceil(size / (length * width)).cast("long").alias("sequences"))
        .agg(F.count("*").alias("copies"))
        .repartitionByRange(shuffle_partitions(docs.sparkSession), "id", "version")
        .withColumn("part", F.spark_partition_id())
    )
    counts = materialize(counts, "sequence-counts")
    each = F.col("sequences") * F.col("copies")
    parts = counts.groupBy("part").agg(F.sum(each).alias("all"))  # a row for each partition
    before = F.sum("all").over(Window.orderBy("part")) - F.col("all")
    total = parts.agg(F.sum("all")).first()[0] or 0
    within = F.sum(each).over(Window.partitionBy("part").orderBy("id", "version", "sequences").rowsBetween(Window.unboundedPreceding, 0)) - each
    placed = counts.withColumn("within", within).join(F.broadcast(parts.select("part", before.alias("before"))), "part")
    return placed.select("id", "version", "copies", "sequences", (F.col("before") + F.col("within")).alias("first")), total


def sequences(docs: DataFrame, key: int, length: int = LENGTH, width: int = 1) -> tuple[DataFrame, int]:
    """(slot, doc_id, seq_no, n_ids, ids) of (doc_id, ids binary), and the number of slots."""
    docs = docs.select("doc_id", "ids")
    firsts, total = numbered(docs, length, width)
    firsts = materialize(firsts, "first-numbers")
    small = firsts.count() <= SMALL
    repeated = firsts.where("copies > 1").select("id", "version")
    given = docs.where(F.octet_length("ids") > 0).withColumn("version", F.xxhash64("ids"))
    if not repeated.isEmpty():  # equal rows: one of them stands for all
        hint = F.broadcast(repeated) if small else repeated
        same = given.doc_id.eqNullSafe(F.col("id")) & (given.version == hint.version)
        given = given.join(hint, same, "left_anti").union(given.join(hint, same, "left_semi").dropDuplicates(["doc_id", "version"]))
    hint = F.broadcast(firsts) if small else firsts
    joined = given.join(hint, given.doc_id.eqNullSafe(F.col("id")) & (given.version == hint.version))
    stride = length * width
    pieces = F.flatten(
        F.transform(
            F.array("ids"),
            lambda ids: F.transform(
                F.sequence(F.lit(0).cast("long"), F.col("copies") * F.col("sequences") - 1),
                lambda k: F.struct(
                    (F.col("first") + k).alias("number"),
                    (k % F.col("sequences")).alias("seq_no"),
                    F.substring(ids, ((k % F.col("sequences")) * stride + 1).cast("int"), F.lit(stride)).alias("ids"),
                ),
            ),
        )
    )
    rows = joined.select("doc_id", F.explode(pieces).alias("p")).select("doc_id", "p.*")
    slot = Feistel(total, key).column("number") if total else F.lit(0).cast("long")
    return rows.select(slot.alias("slot"), "doc_id", "seq_no", (F.octet_length("ids") / width).cast("long").alias("n_ids"), "ids"), total


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


_META = np.dtype([("slot", "<i8"), ("doc_id", "<i8"), ("no_id", "u1"), ("seq_no", "<i8"), ("n_ids", "<i8")])


def _packed(batches: Iterator[pa.RecordBatch], stride: int, per_shard: int) -> Iterator[pa.RecordBatch]:
    """Rows to one compressed parcel for each shard and ``PARCEL`` bytes of rows: whole records, filled up, behind their numbers."""
    press = zstandard.ZstdCompressor(level=1)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def parcels() -> pa.RecordBatch:
        meta, records = (np.concatenate(x) for x in zip(*held))
        held.clear()
        shard = meta["slot"] // per_shard
        order = np.argsort(shard, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(shard[order]) != 0])
        data = []
        for own in np.split(order, first[1:]):
            data.append(press.compress(meta[own].tobytes() + records[own].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(shard[order][first]), pa.array(data, pa.binary())], ["shard", "data"])

    for batch in batches:
        if not batch.num_rows:
            continue
        slot, doc_id, seq_no, n_ids, ids = batch.columns
        meta = np.zeros(batch.num_rows, _META)
        meta["slot"], meta["seq_no"], meta["n_ids"] = slot.to_numpy(), seq_no.to_numpy(), n_ids.to_numpy()
        meta["doc_id"], meta["no_id"] = doc_id.fill_null(0).to_numpy(), doc_id.is_null().to_numpy(zero_copy_only=False)
        filled = b"".join(x.as_py().ljust(stride, b"\0") for x in ids)
        held.append((meta, np.frombuffer(filled, np.uint8).reshape(-1, stride)))
        size += len(filled)
        if size >= PARCEL:
            yield parcels()
            size = 0
    if held:
        yield parcels()


def _write(batches: Iterator[pa.RecordBatch], folder: str, stride: int, per_shard: int, total: int) -> Iterator[pa.RecordBatch]:
    """Parcels sorted by shard: each shard is put together in memory, once, and written."""
    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    open_box = zstandard.ZstdDecompressor()
    shard, metas, image = None, [], np.empty((0, stride), np.uint8)

    def written() -> pa.RecordBatch:
        target = posixpath.join(root, shard_name(shard))
        draft = posixpath.join(root, f".{shard_name(shard)}-{uuid.uuid4().hex}")
        with files.open_output_stream(draft) as out:
            out.write(image.data)
        if files.get_file_info(target).type != fs.FileType.NotFound:
            files.delete_file(target)  # of an earlier try of this task
        files.move(draft, target)
        meta = np.concatenate(metas)
        meta = meta[np.argsort(meta["slot"])]
        n = len(meta)
        doc_id = pa.array(meta["doc_id"], mask=meta["no_id"].astype(bool))
        columns = [meta["slot"], doc_id, meta["seq_no"], meta["n_ids"], np.full(n, shard, np.int64), meta["slot"] % per_shard * stride]
        names = ["slot", "doc_id", "seq_no", "n_ids", "shard", "byte_offset"]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(np.ascontiguousarray(c)) for c in columns], names)

    for batch in batches:
        for own, parcel in zip(batch.column(0).to_pylist(), batch.column(1)):
            if own != shard:
                if shard is not None:
                    yield written()
                shard, metas = own, []
                image = np.zeros((min(per_shard, total - own * per_shard), stride), np.uint8)
            data = open_box.decompress(parcel.as_py())
            n = len(data) // (_META.itemsize + stride)
            meta = np.frombuffer(data, _META, n)
            image[meta["slot"] % per_shard] = np.frombuffer(data, np.uint8, offset=n * _META.itemsize).reshape(n, stride)
            metas.append(meta)
    if shard is not None:
        yield written()


def write_shards(docs: DataFrame, folder: str, key: int, length: int = LENGTH, width: int = 1, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the shards as the result is computed: (slot, doc_id, seq_no, n_ids, shard, byte_offset) of every sequence."""
    rows, total = sequences(docs, key, length, width)
    stride = length * width
    per_shard = max(1, shard_bytes // stride)
    n_shards = max(1, -(-total // per_shard))
    parcels = rows.mapInArrow(partial(_packed, stride=stride, per_shard=per_shard), "shard long, data binary")
    dealt = parcels.repartitionById(n_shards, F.col("shard").cast("int")).sortWithinPartitions("shard")
    kinds = "slot long, doc_id long, seq_no long, n_ids long, shard long, byte_offset long"
    uri = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"
    return dealt.mapInArrow(partial(_write, folder=uri, stride=stride, per_shard=per_shard, total=total), kinds)


def read_slots(folder: str, start: int, stop: int, length: int = LENGTH, width: int = 1, shard_bytes: int = SHARD_BYTES) -> Iterator[bytes]:
    """Records of slots ``start`` up to ``stop``, in order."""
    files, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    stride = length * width
    per_shard = max(1, shard_bytes // stride)
    at = start
    while at < stop:
        shard = at // per_shard
        with files.open_input_file(posixpath.join(root, shard_name(shard))) as data:
            data.seek(at % per_shard * stride)
            while at < stop and at // per_shard == shard:
                yield data.read(stride)
                at += 1


ship(__name__)
