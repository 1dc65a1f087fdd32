"""Exact top-k search by inner product: an impact-ordered index, processed score at a time.

A posting segment holds the vectors of one block whose component in one dimension falls on one level; levels
are runs of whole-number components, so impacts are quantised. For a query, a segment's contribution is bounded by the
better end of its level times the query's component, less the least such bound in its dimension, so that no
contribution is negative. Segments are processed by descending contribution, adding to an accumulator for
each vector. After each group of segments, the sum over dimensions of the largest contributions to come bounds what
any vector may still gain. Processing stops only on proof: when the vectors whose accumulator plus that bound can still
reach the k-th best exact score so far are few. These possible members are rescored exactly.

Vectors are dealt by hash into blocks of about ``BLOCK``, queries into groups of about ``GROUP``; each pair of block
and group is one unit of work, with the best k of the block for each query of the group, and a ranked window keeps the
best k of all. A block's index is built once for a unit. One task holds one block at a time, whatever the data's size.

``scaled`` turns vectors into whole numbers. Accumulators and products are as wide as the components ask for; a component
or a score of the best k beyond a long is an error. Vectors that are null, or have null or non-finite components, take no part, as
do vectors of another number of dimensions than the query's. A null id takes no part. Rows with an id are the query's own if
the ids are equal; an id that occurs repeatedly is one query (its least vector) and several candidates. Ties go to the smaller id.
Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewright.llm.common import ship
from sitewright.session import materialize, shuffle_partitions

BLOCK = 65_536
#: Queries of a group, at least.
GROUP = 128
LEVELS = 16
#: Processing goes on while more than this share of a block may still be members: rescoring those costs less than the proof.
FEW = 0.4
#: Shares of the segments after which the proof is tried; with the first, the k-th best score is bounded.
STEPS = (0.5, 0.65, 0.75, 0.85, 0.95, 1.0)


def scaled(vectors: DataFrame, factor: int) -> DataFrame:
    """(vec_id, v): floor of ``factor`` times each component, for vectors that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    beyond = F.raise_error(F.lit("a component is beyond a long")).cast("long")
    whole = F.transform("embedding", lambda x: F.when(F.abs(x.cast("double") * factor) < 2.0**63, F.floor(x.cast("double") * factor)).otherwise(beyond))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine).select("vec_id", whole.alias("v"))


class Index:
    """Posting segments of a block, by dimension and level."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        # Single precision holds sums below 2 ** 24 exactly, and double precision those below 2 ** 53.
        self.largest = max(int(self.vectors.max()), -int(self.vectors.min()))
        self.exact = self.vectors.astype(np.float32 if vectors.shape[1] * self.largest**2 < 1 << 24 else np.float64)
        n, dims = vectors.shape
        self.postings, low, high, dim = [], [], [], []
        for d in range(dims):
            column = self.vectors[:, d]
            by_value = np.argsort(column, kind="stable")
            values = column[by_value]
            # Levels end where the value changes, at about equal numbers of vectors.
            cuts = np.unique(np.searchsorted(values, values[np.linspace(0, n - 1, LEVELS + 1).astype(int)], "left"))
            for a, b in zip(cuts, np.append(cuts[1:], n)):
                if a < b:
                    self.postings.append(np.sort(by_value[a:b]))
                    low.append(int(values[a]))
                    high.append(int(values[b - 1]))
                    dim.append(d)
        self.low, self.high, self.dim = (np.array(x, np.int64) for x in (low, high, dim))
        self.first = np.flatnonzero(np.r_[True, self.dim[1:] != self.dim[:-1]])

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the best k others, best first."""
        q = query.astype(np.int64)
        others = self.ids != own
        reach = len(q) * self.largest * max(int(q.max()), -int(q.min()))  # no score, nor part of one, is beyond
        if 4 * reach >= 1 << 63:  # sums may leave a long on the way; a score that does not fit raises
            wide = self.vectors.astype(object) @ q.astype(object)
            best = sorted(np.flatnonzero(others), key=lambda i: (-wide[i], self.ids[i]))[:k]
            return self.ids[best], np.array([wide[i] for i in best], np.int64)
        bound = np.maximum(q[self.dim] * self.low, q[self.dim] * self.high)
        least = np.minimum.reduceat(bound, self.first)
        gain = bound - least[self.dim]
        order = np.argsort(-gain, kind="stable")
        order = order[gain[order] > 0]
        # An accumulator and what may still be added stay within four times the reach.
        width = np.int32 if 4 * reach < 1 << 31 else np.int64
        acc = np.full(len(self.ids), int(least.sum()), width)
        # What a dimension may still add: the largest gain among its segments that are not yet processed.
        position = np.full(len(gain), len(order))
        position[order] = np.arange(len(order))
        rows = self.exact if reach < 1 << 53 else self.vectors
        exact = q.astype(np.float64 if 1 << 24 <= reach < 1 << 53 else rows.dtype)
        possible, threshold, done = np.flatnonzero(others), None, 0
        for step in STEPS:
            upto = int(np.ceil(step * len(order)))
            for s in order[done:upto]:
                acc[self.postings[s]] += width(gain[s])
            done = upto
            if len(possible) <= k:
                break
            if threshold is None or step > 0.9:
                likely = possible[np.argpartition(-acc[possible], min(2 * k, len(possible) - 1))[: 2 * k + 1]]
                scores = np.sort(rows[likely] @ exact)
                threshold = scores[-k] if threshold is None else max(threshold, scores[-k])
            rest = int(np.maximum.reduceat(np.where(position >= done, gain, 0), self.first).sum())
            possible = possible[acc[possible] + rest >= threshold]
            if len(possible) <= FEW * len(acc):
                break
        # Beyond an eighth of the rows, a product with all of them is cheaper than gathering those.
        many = len(possible) * 8 > len(acc)
        scores = ((rows @ exact)[possible] if many else rows[possible] @ exact).astype(np.int64)
        best = np.lexsort((self.ids[possible], -scores))[:k]
        return self.ids[possible][best], scores[best]


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (unit, kind, id, data): a unit's candidates, then its queries."""
    unit, held, index = None, [], None

    def built() -> dict[int, Index]:
        ids, lengths, values = (np.concatenate(x) for x in zip(*held))
        place = np.concatenate([[0], np.cumsum(lengths)])
        out = {}
        for w in np.unique(lengths[lengths > 0]):
            at = np.flatnonzero(lengths == w)
            out[int(w)] = Index(ids[at], values[place[at][:, None] + np.arange(w)].astype(np.int64))
        return out

    for batch in batches:
        units, kinds, ids = (batch.column(i).to_numpy() for i in range(3))
        ends = batch.column(3).offsets.to_numpy()
        values = batch.column(3).values.to_numpy()
        borders = np.flatnonzero(np.r_[True, (units[1:] != units[:-1]) | (kinds[1:] != kinds[:-1])])
        out: list[tuple[int, int, int]] = []
        for a, b in zip(borders, np.append(borders[1:], len(units))):
            if units[a] != unit:
                unit, held, index = units[a], [], None
            if kinds[a] == 0:
                held.append((ids[a:b], np.diff(ends[a : b + 1]), values[ends[a] : ends[b]].copy()))
                continue
            if index is None:
                index, held = built() if held else {}, []
            for i in range(a, b):
                query = values[ends[i] : ends[i + 1]].astype(np.int64)
                if len(query) in index:
                    found, scores = index[len(query)].top(query, ids[i], k)
                    out += zip([int(ids[i])] * len(found), found.tolist(), scores.tolist())
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else ([], [], []))], ["query_id", "vec_id", "score"])


def search(vectors: DataFrame, queries: Column, k: int, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score) of (vec_id, v), for the ids that ``queries`` holds for."""
    vectors = materialize(vectors.select("vec_id", "v"), "vectors")
    asked = materialize(vectors.where(queries).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    blocks = max(1, -(-vectors.count() // block))
    # Groups of queries are as large as blocks, so that vectors are copied seldom, but for as many as it takes to keep all tasks busy.
    n_asked, busy = asked.count(), -(-4 * shuffle_partitions(vectors.sparkSession) // blocks)
    groups = max(1, -(-n_asked // block), min(busy, -(-n_asked // group)))
    own_block = F.pmod(F.xxhash64(F.col("vec_id"), F.lit(1)), F.lit(blocks))
    own_group = F.pmod(F.xxhash64(F.col("vec_id"), F.lit(2)), F.lit(groups))
    every_group = F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))
    every_block = F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))
    # A stated set of queries against all vectors, in blocks: each side is copied to the units of the other's blocks.
    indexed = vectors.withColumn("g", F.explode(every_group)).select((own_block * groups + F.col("g")).alias("unit"), F.lit(0).alias("kind"), "vec_id", "v")
    posed = asked.withColumn("b", F.explode(every_block)).select((F.col("b") * groups + own_group).alias("unit"), F.lit(1).alias("kind"), "vec_id", "v")
    tasks = min(blocks * groups, 100_000)
    dealt = indexed.union(posed).repartitionById(tasks, F.pmod("unit", F.lit(tasks)).cast("int")).sortWithinPartitions("unit", "kind")
    found = dealt.mapInArrow(partial(_search, k=k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


ship(__name__)
