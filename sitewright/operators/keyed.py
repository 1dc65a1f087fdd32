"""Tables of one row a URL that rounds change: a bucketed base, and the rows that rounds changed.

Base and changes are bucketed by the URL into the same number of buckets, so they meet, and are grouped, without
an exchange: a round shuffles and writes what it changes, whatever the size of the table. Readers see the last
change of each URL in place of the base row. ``compact`` folds changes into a new base.

Bucketing is a property of catalog tables; they are external ones below ``path`` in the shared folder.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..rules import Rules, STANDARD
from ..session import materialize, shuffle_partitions, work_path
from . import registry as R
from .registry import CrawlState


class KeyedTable:
    """Rows by ``url``; ``change`` stores a round, ``current`` merges on read."""

    def __init__(self, rows: DataFrame, path: str | None = None, buckets: int | None = None):
        self.spark: SparkSession = rows.sparkSession
        self.path = path or work_path(self.spark, "keyed")
        self.buckets = buckets or shuffle_partitions(self.spark)
        self.columns = rows.columns
        self._name = f"keyed_{uuid.uuid4().hex}"
        self._bases, self.rounds = 0, 0
        self._store(rows, self._base_name)

    @property
    def _base_name(self) -> str:
        return f"{self._name}_base{self._bases}"

    @property
    def _changes_name(self) -> str:
        return f"{self._name}_changes{self._bases}"

    def _store(self, rows: DataFrame, name: str) -> None:
        (
            rows.repartition(self.buckets, "url")
            .write.format("parquet")
            .mode("append")
            .bucketBy(self.buckets, "url")
            .sortBy("url")
            .option("path", f"{self.path}/{name}")
            .saveAsTable(name)
        )

    def change(self, rows: DataFrame, gone: DataFrame | None = None) -> None:
        """Store a round: whole new rows, unique by URL, and the URLs ``gone(url)`` that leave the table."""
        self.rounds += 1
        marked = rows.select(*self.columns).withColumn("_gone", F.lit(False))
        if gone is not None:
            kinds = dict(rows.dtypes)
            nulls = [F.lit(None).cast(kinds[c]).alias(c) for c in self.columns if c != "url"]
            marked = marked.unionByName(gone.select("url", *nulls, F.lit(True).alias("_gone")))
        self._store(marked.withColumn("_round", F.lit(self.rounds)), self._changes_name)

    def changes(self) -> DataFrame | None:
        """Rows of all rounds since the last base, with ``_round`` and ``_gone``; None if there were none."""
        return self.spark.table(self._changes_name) if self.rounds else None

    def current(self) -> DataFrame:
        base, changes = self.spark.table(self._base_name), self.changes()
        if changes is None:
            return base
        rest = [c for c in self.columns if c != "url"]
        last = changes.groupBy("url").agg(F.max_by(F.struct("_gone", *rest), "_round").alias("_row"))
        # The whole struct must be unpacked behind the filter, by name.
        changed = last.filter(~F.col("_row._gone")).select("url", *(F.col(f"_row.{c}").alias(c) for c in rest))
        kept = base.join(changes.select("url"), "url", "left_anti")
        return kept.select(*self.columns).unionByName(changed.select(*self.columns))

    def compact(self) -> None:
        """Fold the rounds into a new base and drop the old one."""
        if not self.rounds:
            return
        rows, old = self.current(), (self._base_name, self._changes_name)
        self._bases += 1
        self._store(rows, self._base_name)
        self.rounds = 0
        for name in old:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def compact_if_outgrown(self) -> None:
        # Counts come from file footers.
        if self.rounds and self.changes().count() > max(10_000, self.spark.table(self._base_name).count()):
            self.compact()

    def drop(self) -> None:
        """Take the tables out of the catalog; their files stay until the work folder is cleared."""
        for name in (self._base_name, self._changes_name):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


@dataclass(frozen=True)
class KeyedState:
    registry: KeyedTable
    frontier: KeyedTable

    @classmethod
    def of(cls, state: CrawlState, path: str | None = None, buckets: int | None = None) -> KeyedState:
        at = (lambda name: None) if path is None else (lambda name: f"{path}/{name}")
        return cls(KeyedTable(state.registry, at("registry"), buckets), KeyedTable(state.frontier, at("frontier"), buckets))

    def compact_if_outgrown(self) -> None:
        """Fold tables whose changes are more than their base: each row is rewritten a few times at most."""
        for table in (self.registry, self.frontier):
            table.compact_if_outgrown()

    def current(self) -> CrawlState:
        return CrawlState(self.registry.current(), self.frontier.current())


def touched(registry: DataFrame, *urls: DataFrame) -> DataFrame:
    """Registry rows of the given URLs; the registry is read once and stays where it is."""
    wanted = urls[0].select("url")
    for more in urls[1:]:
        wanted = wanted.unionByName(more.select("url"))
    return registry.join(wanted.distinct(), "url", "left_semi")


def process_results(state: KeyedState, results: DataFrame, rules: Rules = STANDARD, max_depth: int | None = None) -> None:
    """Absorb one round, as ``registry.process_results`` does, storing changed rows only."""
    found = R.new_batch(results, rules, max_depth).withColumn("pos", F.struct("depth", "added_at", "parent_url", "url"))
    round_ = R.round_tables(found, results.drop("discovered_urls", "depth"))
    known = materialize(touched(state.registry.current(), round_.latest, round_.batch), "touched")
    fresh = materialize(round_.batch.join(known.select("url"), "url", "left_anti"), "fresh")
    fetched = known.join(round_.latest.select("url"), "url", "left_semi")
    state.registry.change(R.apply_results(fetched, round_.latest).unionByName(R.pending_rows(fresh)))
    left = state.frontier.current().join(round_.latest.select("url"), "url", "left_semi").select("url")
    state.frontier.change(R.frontier_rows(fresh), gone=materialize(left, "dequeued"))
