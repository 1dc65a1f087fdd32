"""Similarity join of documents by the Jaccard coefficient of their word n-grams, and its components.

Words are taken between white space, A-Z in lower case. A document's set holds the hashes (64 bits)
of its distinct ``width``-word shingles; the whole sequence where it has fewer words.

1. Documents with equal sets are one class; everything below works on classes.
2. Two sets with coefficient t or more differ in few shingles for their sizes, d at most. A set is cut
   by hash into somewhat more than d + 1 segments, so some of them are equal in linked sets; the sum of each of d + 1 non-empty
   segments is a key under which classes meet. These are the segments of the most shingles (ordered by key, where as many): linked sets
   share more segments than either leaves out, and one shingle that many texts happen to share is seldom a key, so clusters
   stay small as the corpus grows. Sizes fall in classes of ratio t; a set is cut for its size class and
   for the one below, d is of its own size. The most frequent shingles, as many as are at
   least 16 times in some task's documents and ``HOT`` of them at most, are left out before cutting, in all sets alike, which only lowers the difference; sets with too few others are
   cut with them, and sets near that border both ways. Sets with too few non-empty segments in every cut list the empty ones
   too. No linked pair is lost. A task hands on one set for each key and links the others it holds to that one, so a key of
   very many sets is a few rows.
3. Classes that lists connect are a cluster. A cluster of up to ``CLUSTER`` classes is dealt into blocks, and every pair of blocks is
   a unit of work: the sets of one block are looked up in the other. In larger clusters (copies of one text by the
   million), lists are worked off by pivots: in each list one pivot is compared with the members of other
   components, then, after these fell together, eight times as many in each round, until every pair of a list is in one component or compared.
4. A look-up is a T-occurrence search in an inverted index of a block, by DivideSkip: short lists are merged and
   counted, sets that may still reach the overlap are looked up in the long lists by binary search. A unit hands on
   a spanning forest of its links, not all of them: n near copies give n - 1 links.

Blocks hold about ``BLOCK`` sets, more in clusters of over ``BLOCKS`` blocks (700 at most); one task streams over its units and holds
one at a time.
Roles (which text goes to which unit) are broadcast up to ``SMALL`` rows and joined beyond.

Every row is a document, also where ids repeat. Null ids are documents too; they never name a
component that has other ids. Null and empty texts have empty sets, link with nothing and keep their own id.
Other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.llm.common import UPPER, ship, texts
from sitewright.llm.graph import components
from sitewright.session import materialize

BLOCK = 256
BLOCKS = 24
CLUSTER = 16_384
HOT = 1 << 21
CUTS = 6
#: Keys that a task gathers before it hands them on.
HELD = 500_000
#: Rows of about 70 bytes that may be broadcast: 35 MB.
SMALL = 500_000
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes."""
    found = text.encode().translate(_LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    k = min(width, len(w))
    x = np.full(len(w) - k + 1, np.uint64(k))
    for i in range(k):
        x = (x * _A) ^ (x >> np.uint64(31))
        x += w[i : len(w) - k + 1 + i] * _B
    x ^= x >> np.uint64(32)
    x *= _D
    x ^= x >> np.uint64(29)
    return np.unique(x)


def key_of(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def starts(percent: int, most: int) -> list[int]:
    """First sizes of the size classes, up to one beyond ``most``: linked sets are in one class or in neighbours."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * 100 // percent + 1)
    return out


def _without(own: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return own
    at = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
    return own[hot[at] != own]


def _differ(a: int, b: int, percent: int) -> int:
    """In how many shingles linked sets of these sizes differ at most."""
    return (100 - percent) * (a + b) // (100 + percent)


def segments(own: np.ndarray, percent: int, bounds: list[int], hot: np.ndarray) -> np.ndarray:
    """Keys of a set: two linked, unequal sets have one in common."""
    size_class = int(np.searchsorted(bounds, len(own), "right")) - 1
    cold, keys = _without(own, hot), []
    for scheme in (size_class, size_class - 1):
        if scheme < 0:
            continue
        largest = bounds[scheme + 1] - 1
        count = -(-(_differ(largest, largest * 100 // percent, percent) + 1) * 4 // 3)
        differ = _differ(len(own), len(own) * 100 // percent if scheme == size_class else largest, percent)
        enough = 8 * count // 5  # so many that few segments are empty
        if len(cold) >= enough:
            keys += _cuts(cold, count, differ, 2 * scheme)
        if len(cold) < enough + differ:  # the other set may have fewer than enough
            keys += _cuts(own, count, differ, 2 * scheme + 1)
    return np.concatenate(keys)


def _cuts(own: np.ndarray, count: int, differ: int, name: int) -> list[np.ndarray]:
    """Keys of cut after cut, up to the first with so many segments that are not empty that a linked set must share one.

    Of n such segments, a linked set shares n - ``differ`` at least, and so one of any ``differ`` + 1: those of the most shingles.
    Both sets put them in the same order, so the first that they share is listed by both.
    """
    out = []
    for cut in range(CUTS):
        part = ((own * (_C + np.uint64(2 * cut))) >> np.uint64(33)) % np.uint64(count)
        order = np.argsort(part, kind="stable")
        sorted_part = part[order]
        first = np.flatnonzero(np.r_[True, sorted_part[1:] != sorted_part[:-1]])
        there, sums = sorted_part[first], np.add.reduceat(own[order], first)
        good = len(there) > differ
        if not good and cut == CUTS - 1:
            empty = np.setdiff1d(np.arange(count, dtype=np.uint64), there)
            there, sums = np.append(there, empty), np.append(sums, np.zeros(len(empty), np.uint64))
        x = (sums * _A) ^ ((there + np.uint64((name * CUTS + cut) << 24)) * _B)
        x ^= x >> np.uint64(32)
        x *= _D
        if good:
            held = np.diff(np.append(first, len(own)))
            x = x[np.lexsort((x, -held))[: differ + 1]]
        out.append(x)
        if good:
            break
    return out


def _often(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Shingles that are frequent among the documents this task has seen, with their counts there."""
    held, size = [], 0

    def rows() -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(held), return_counts=True)
        often = n >= 3
        return pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(n[often])], ["shingle", "n"])

    for batch in batches:
        for text in batch.column(0):
            own = shingles(text.as_py(), width)
            held.append(own)
            size += len(own)
            if size > 2 * HELD:
                yield rows()
                held, size = [], 0
    if size:
        yield rows()


def node_of(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def _keys(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Size and key of each text's set, and the number that stands for the set among the segments."""
    for batch in batches:
        own = [shingles(text.as_py(), width) for text in batch.column(1)]
        keys = [key_of(x) for x in own]
        columns = [pa.array([len(x) for x in own], pa.int64()), pa.array(keys, pa.binary()), pa.array(map(node_of, keys), pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["doc_id", "version", "n", "key", "node"])


def _bounds(bounds: list[int], percent: int, size: int) -> list[int]:
    while size >= bounds[-2]:
        bounds = starts(percent, 2 * bounds[-1])
    return bounds


def _segment_rows(batches: Iterator[pa.RecordBatch], width: int, percent: int, hot) -> Iterator[pa.RecordBatch]:
    """(segment, a, b): a is the first set that this task has for the segment, b another one or a itself."""
    bounds, held, size = starts(percent, 1 << 16), [], 0

    def rows() -> pa.RecordBatch:
        segment, node = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((node, segment))
        segment, node = segment[order], node[order]
        new = np.r_[True, (segment[1:] != segment[:-1]) | (node[1:] != node[:-1])]
        segment, node = segment[new], node[new]
        start = np.r_[True, segment[1:] != segment[:-1]]
        first = node[np.flatnonzero(start)[np.cumsum(start) - 1]]
        return pa.RecordBatch.from_arrays([pa.array(segment), pa.array(first), pa.array(node)], ["segment", "a", "b"])

    for batch in batches:
        for text in batch.column(0):
            own = shingles(text.as_py(), width)
            if not len(own):
                continue
            bounds = _bounds(bounds, percent, len(own))
            keys = segments(own, percent, bounds, hot.value).view(np.int64)
            held.append((keys, np.full(len(keys), node_of(key_of(own)))))
            size += len(keys)
            if size > HELD:
                yield rows()
                held, size = [], 0
    if held:
        yield rows()


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by segment to links (u, v) that connect all sets of a segment."""
    last, first = None, 0
    for batch in batches:
        segment, a, b = (c.to_numpy() for c in batch.columns)
        if not len(segment):
            continue
        start = np.r_[segment[0] != last, segment[1:] != segment[:-1]]
        run = np.cumsum(start) - 1
        firsts = np.append(a[start], first)  # the run carried over from the batch before has number -1
        head = firsts[run]
        last, first = segment[-1], head[-1]
        u = np.concatenate([head[a != head], a[a != b]])
        v = np.concatenate([a[a != head], b[a != b]])
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def _listed(batches: Iterator[pa.RecordBatch], width: int, percent: int, hot) -> Iterator[pa.RecordBatch]:
    """(text, key, id) to the segments of the classes of large clusters."""
    bounds = starts(percent, 1 << 16)
    for batch in batches:
        ids, found = [], []
        for text, key, own_id in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist()):
            own = shingles(text.as_py(), width)
            if key_of(own) == key.as_py():
                bounds = _bounds(bounds, percent, len(own))
                found.append(segments(own, percent, bounds, hot.value).view(np.int64))
                ids.append(np.full(len(found[-1]), own_id))
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(ids), pa.int64())], ["segment", "class"])


def needed(n: int, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Overlap that a set of ``n`` must have with sets of ``sizes``: 100 * both >= percent * union."""
    return -(-percent * (n + sizes) // (100 + percent))


class Index:
    """Inverted lists of a block: for every shingle the sets that hold it, in order."""

    def __init__(self, members: list[np.ndarray], percent: int):
        self.percent = percent
        self.sizes = np.array([len(m) for m in members])
        owner = np.repeat(np.arange(len(members)), self.sizes)
        values = np.concatenate(members)
        order = np.argsort(values, kind="stable")
        self.values, self.owner = values[order], owner[order]

    def search(self, query: np.ndarray) -> np.ndarray:
        """T-occurrence search by DivideSkip: sets whose overlap with the query suffices."""
        n = len(query)
        want = needed(n, self.sizes, self.percent)
        want[(self.sizes * 100 < self.percent * n) | (n * 100 < self.percent * self.sizes)] = n + 1
        least = int(want.min())
        if least > n:
            return np.empty(0, np.int64)
        low, high = np.searchsorted(self.values, query, "left"), np.searchsorted(self.values, query, "right")
        lengths = high - low
        longest = max(int(lengths.max()), 2)
        n_long = min(least - 1, int(least / (math.log2(longest) + 1)))
        by_length = np.argsort(-lengths, kind="stable")
        long, short = by_length[:n_long], by_length[n_long:]
        short = short[lengths[short] > 0]
        merged = np.concatenate([self.owner[low[i] : high[i]] for i in short]) if len(short) else self.owner[:0]
        counts = np.bincount(merged, minlength=len(self.sizes))
        left = np.flatnonzero(counts >= want - n_long)
        for done, i in enumerate(long):
            left = left[counts[left] + (n_long - done) >= want[left]]
            if not len(left):
                break
            listed = self.owner[low[i] : high[i]]
            if len(listed):
                at = np.minimum(np.searchsorted(listed, left), len(listed) - 1)
                counts[left] += listed[at] == left
        return left[counts[left] >= want[left]]


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Texts to sets; a row whose set is not that of its class is another document with the same id."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            own = [shingles(t.as_py(), width) for t in part.column(0)]
            right = [i for i, k in enumerate(part.column(1)) if key_of(own[i]) == k.as_py()]
            taken = part.take(pa.array(right, pa.int64()))
            data = pa.array([own[i].tobytes() for i in right], pa.binary())
            yield pa.RecordBatch.from_arrays([*taken.columns[2:], data], [*part.schema.names[2:], "data"])


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (a, b, c, member, id, data): a unit's probes, then its members; without probes, members probe each other."""
    unit, probes, members = None, [], []

    def found() -> list[tuple[int, int]]:
        """Links that hold the unit's components together, fewer than it has sets: a link between connected ones is left out."""
        if not members:
            return []
        index, out = Index([m for _, m in members], percent), []
        label = np.arange(len(members))
        for n, (own, data) in enumerate(probes or members):
            hits = index.search(data)
            hits = hits if probes else hits[hits > n]
            others, at = np.unique(label[hits], return_index=True)
            own_label = label[n] if not probes else others[0] if len(others) else -1
            for other, hit in zip(others.tolist(), hits[at].tolist()):
                if probes or other != own_label:
                    out.append((own, members[hit][0]))
                    label[label == other] = own_label
        return out

    def batch_of(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*pairs) if pairs else ([], []))], ["u", "v"])

    for batch in batches:
        pairs: list[tuple[int, int]] = []
        for a, b, c, member, own, data in zip(*(x.to_pylist() for x in batch.columns)):
            if unit != (a, b, c):
                pairs += found()
                unit, probes, members = (a, b, c), [], []
            side = members if member else probes
            if not side or side[-1][0] != own:
                side.append((own, np.frombuffer(data, np.uint64)))
        yield batch_of(pairs)
    yield batch_of(found())


def _texts_of(chosen: DataFrame, docs: DataFrame) -> DataFrame:
    """Texts beside the rows of ``chosen`` (low, key, ...) that they may belong to."""
    small = chosen.count() <= SMALL
    given = texts(docs).withColumnRenamed("doc_id", "doc")
    joined = given.join(F.broadcast(chosen) if small else chosen, given.doc.eqNullSafe(chosen.low))
    return joined.select("text", *[c for c in chosen.columns if c != "low"])


def compare(roles: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Linked pairs (u, v) of the classes that meet in a unit of ``roles`` (a, b, c, member, id)."""
    roles = materialize(
        roles.join(classes.select(F.col("class").alias("id"), "low", "key"), "id").select("low", "key", "a", "b", "c", "member", "id"), "roles"
    )
    kinds = "a long, b long, c long, member boolean, id long"
    sets = _texts_of(roles, docs).mapInArrow(partial(_sets, width=width), f"{kinds}, data binary")
    dealt = sets.repartition("a", "b", "c").sortWithinPartitions("a", "b", "c", "member", "id")
    return dealt.mapInArrow(partial(_linked, percent=percent), "u long, v long")


def _pivot_roles(pairs: DataFrame) -> DataFrame:
    """A unit for each pivot u and each share of the classes v it is compared with."""
    shares = pairs.groupBy("u").agg(F.ceil(F.count("*") / BLOCK).alias("shares"))
    no = F.lit(-1).cast("long")
    members = pairs.join(shares, "u").select(
        F.col("u").alias("a"), F.pmod(F.xxhash64("v"), F.col("shares")).alias("b"), no.alias("c"), F.lit(True).alias("member"), F.col("v").alias("id")
    )
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))
    probes = shares.select(F.col("u").alias("a"), every.alias("b"), no.alias("c"), F.lit(False).alias("member"), F.col("u").alias("id"))
    return members.unionByName(probes)


def _cluster_roles(clusters: DataFrame) -> DataFrame:
    """Every pair of blocks of a cluster as a unit; (class, root, size) gives the blocks."""
    own = F.pmod(F.xxhash64("class"), F.col("blocks"))
    dealt = (
        clusters.withColumn("blocks", F.least(F.ceil(F.col("size") / BLOCK).cast("long"), F.lit(BLOCKS)))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    )
    member = F.col("own") >= F.col("other")  # the higher block is indexed, the lower one probes
    return dealt.select(F.col("root").alias("a"), F.least("own", "other").alias("b"), F.greatest("own", "other").alias("c"), member.alias("member"), F.col("class").alias("id"))


def _pairs(lists: DataFrame, labels: DataFrame, pivots: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of (pivot, member) of different components, and lists with more pivots to come."""
    marked = lists.join(labels, "class", "left").select("segment", "class", F.coalesce("root", "class").alias("root"))
    sizes = marked.groupBy("segment", "root").agg(F.count("*").alias("k"), F.min("class").alias("least"))
    heads = (
        sizes.groupBy("segment")
        .agg(F.max(F.struct("k", -F.col("root"))).alias("m"), F.count("*").alias("roots"), F.sum("k").alias("all"))
        .where("roots > 1")
        .select("segment", (-F.col("m.col2")).alias("major"), (F.col("all") - F.col("m.k")).alias("minor"))
    )
    open_lists = marked.join(heads, "segment")
    ranked = F.row_number().over(_window())
    chosen = (
        open_lists.where("root <> major").withColumn("place", ranked).where(F.col("place") <= pivots)
        .select("segment", F.col("class").alias("u"), F.col("root").alias("u_root"))
    )
    pairs = open_lists.join(chosen, "segment").where("root <> u_root and class <> u").select("u", F.col("class").alias("v"))
    return pairs.distinct(), heads.where(F.col("minor") > pivots)


def _window():
    from pyspark.sql import Window

    return Window.partitionBy("segment").orderBy("class")


def _large(lists: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links of large clusters, list by list, by pivots; enough of them to connect what is connected."""
    spark = docs.sparkSession
    labels = spark.createDataFrame([], "class long, root long")
    links = spark.createDataFrame([], "u long, v long")
    seen, step = None, 0
    while True:
        pairs, more = _pairs(lists, labels, 8 ** max(0, step - 1))
        if seen is None:  # one pivot for each member is enough to begin with
            pairs = pairs.groupBy("v").agg(F.min("u").alias("u")).select("u", "v")
        else:
            pairs = pairs.join(seen, ["u", "v"], "left_anti")
        pairs = materialize(pairs, "pairs")
        if not pairs.isEmpty():
            links = links.union(materialize(compare(_pivot_roles(pairs), classes, docs, width, percent), "found"))
            labels = components(links).select(F.col("node").alias("class"), "root")
            seen = pairs if seen is None else seen.union(pairs)
        elif more.isEmpty():
            return links
        step += 1


def grouped_rows(docs: DataFrame, width: int = 3, percent: int = 90, cluster: int = CLUSTER) -> DataFrame:
    """(doc_id, version, n_shingles, group, component_id) of every row of ``docs``; version is a hash of the text, group null for empty sets."""
    given = texts(docs)
    prints = materialize(
        given.withColumn("version", F.xxhash64("text"))
        .mapInArrow(partial(_keys, width=width), "doc_id long, version long, n long, key binary, node long")
        .withColumn("row", F.monotonically_increasing_id()),
        "prints",
    )
    classes = materialize(
        prints.where("n > 0").groupBy("key", "node").agg(F.min("row").alias("class"), F.min("doc_id").alias("low")), "classes"
    )
    often = given.select("text").mapInArrow(partial(_often, width=width), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    often, least = materialize(often.where("n >= 16"), "often"), 16
    while often.where(F.col("n") >= least).count() > HOT:
        least *= 2
    common = often.where(F.col("n") >= least).select("shingle").toArrow()["shingle"].to_numpy()
    hot = docs.sparkSession.sparkContext.broadcast(np.sort(common.view(np.uint64)))
    kinds = "segment long, a long, b long"
    dealt = given.select("text").mapInArrow(partial(_segment_rows, width=width, percent=percent, hot=hot), kinds).repartition("segment")
    meetings = dealt.sortWithinPartitions("segment", "a").mapInArrow(_meetings, "u long, v long")
    joined = materialize(components(meetings), "joined")
    every = joined.union(joined.select("root", "root").distinct()).withColumnRenamed("node", "__node")
    sizes = joined.groupBy("root").agg((F.count("*") + 1).alias("size"))
    clusters = classes.join(every.join(sizes, "root"), F.col("node") == F.col("__node")).select("class", "low", "key", "root", "size")
    clusters = materialize(clusters, "clusters")
    links = materialize(compare(_cluster_roles(clusters.where(F.col("size") <= cluster)), classes, docs, width, percent), "links")
    large = clusters.where(F.col("size") > cluster).select("low", "key", F.col("class").alias("id"))
    if not large.isEmpty():
        lists = _texts_of(large, docs).mapInArrow(partial(_listed, width=width, percent=percent, hot=hot), "segment long, class long").distinct()
        links = links.union(_large(materialize(lists, "lists"), classes, docs, width, percent))
    labels = components(links).select(F.col("node").alias("class"), "root")
    rooted = classes.join(labels, "class", "left").select("class", "key", "low", F.coalesce("root", "class").alias("root"))
    names = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    by_class = rooted.join(names, "root").select("key", F.col("root").alias("group"), "component_id")
    return prints.join(by_class, "key", "left").select(
        "doc_id", "version", F.col("n").alias("n_shingles"), "group", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def link_components(docs: DataFrame, width: int = 3, percent: int = 90, cluster: int = CLUSTER) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    return grouped_rows(docs, width, percent, cluster).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The rows of ``docs``, all columns, without those linked to a row of smaller id (then smaller hash of the text).

    One of several equal rows stays. Rows with empty sets stay, all of them.
    """
    rows = materialize(grouped_rows(docs, width, percent).where(F.col("group").isNotNull()).select(F.col("doc_id").alias("__id"), F.col("version").alias("__v"), "group"), "grouped")
    first = rows.groupBy("group").agg(F.min(F.struct("__id", "__v")).alias("first"))
    gone = rows.join(first, "group").where("not (__id <=> first.__id and __v = first.__v)").select("__id", "__v").distinct()
    gone = materialize(gone, "gone")
    repeated = materialize(rows.groupBy("__id", "__v").count().where("count > 1").select("__id", "__v"), "repeated")
    given = docs.withColumn("__version", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = given.doc_id.eqNullSafe(F.col("__id")) & (F.col("__version") == F.col("__v"))

    def hint(side: DataFrame) -> DataFrame:
        return F.broadcast(side) if side.count() <= SMALL else side

    left = given.join(hint(gone), same, "left_anti")
    if not repeated.isEmpty():
        left = left.join(hint(repeated), same, "left_anti").unionByName(left.join(hint(repeated), same, "left_semi").dropDuplicates(["doc_id", "__version"]))
    return left.drop("__version")


ship(__name__)
