"""URL registry and frontier upkeep as table-to-table steps.

A registry row is one URL. Inputs that may repeat a URL are first reduced to one
row per URL by an aggregation with map-side combine, so the joins that follow are
unique on both sides and no key can be hot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import url as U
from ..rules import Rules, STANDARD
from ..session import materialize, will_broadcast
from .skew import HOT_ROWS, lookup_join, ranked


@dataclass(frozen=True)
class CrawlState:
    registry: DataFrame
    frontier: DataFrame

    def write(self, path: str) -> CrawlState:
        """Store both tables under a new version path and read them back.

        Parquet has no MERGE: a round reads one version and writes the next, and
        what it reads stays as it is until the new version is complete.
        """
        spark = self.registry.sparkSession
        out = {}
        for name, df in (("registry", self.registry), ("frontier", self.frontier)):
            df.write.mode("error").parquet(f"{path}/{name}")
            out[name] = spark.read.schema(df.schema).parquet(f"{path}/{name}")
        return CrawlState(**out)


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The whole row that comes first per key; ``order`` decides ties in full."""
    rest = [c for c in df.columns if c != key]
    return (
        df.groupBy(key)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(key, *(F.col("_row")[c].alias(c) for c in rest))
    )


def dedupe_first(df: DataFrame, url: str = "url", pos: str = "pos") -> DataFrame:
    """Normalise, drop invalid URLs, keep the first position of each."""
    return (
        df.select(U.url_normalize(url).alias("url"), F.col(pos).alias("pos"))
        .filter(U.is_valid_url("url"))
        .groupBy("url")
        .agg(F.min("pos").alias("pos"))
    )


def first_parent(discoveries: DataFrame) -> DataFrame:
    """First discoverer of each URL: least depth, then time, then parent."""
    return first_per_key(discoveries, "url", ["depth", "discovered_at", "parent_url"])


def pattern_first(urls: DataFrame) -> DataFrame:
    """Flag every URL but the first of its pattern as a likely duplicate.

    The first URL per pattern is found by a combinable minimum and joined back on
    the URL itself, so a pattern that holds most URLs stays spread out.
    """
    tagged = urls.select("url", C.url_pattern("url").alias("pattern"))
    firsts = tagged.groupBy("pattern").agg(F.min("url").alias("_first")).select("_first")
    return tagged.join(firsts, F.col("url") == F.col("_first"), "left").select(
        "url", "pattern", F.col("_first").isNull().alias("is_duplicate")
    )


def latest_result(crawl_log: DataFrame) -> DataFrame:
    """Last attempt per URL wins."""
    rest = [c for c in crawl_log.columns if c != "url"]
    return (
        crawl_log.groupBy("url")
        .agg(
            F.max_by(F.struct(*rest), F.struct("fetched_at", "attempt_id")).alias("_row")
        )
        .select("url", *(F.col("_row")[c].alias(c) for c in rest))
    )


def seed_batch(bases: DataFrame, added_at: str) -> DataFrame:
    """Base URLs ``bases(url)`` as a discovery batch: depth 0, priority 100."""
    return bases.select(
        "url",
        F.lit(None).cast("string").alias("parent_url"),
        F.lit(0).alias("depth"),
        F.lit(False).alias("is_dynamic"),
        F.lit(100).alias("priority"),
        F.col("url").alias("pos"),
        F.lit(added_at).cast("timestamp").alias("added_at"),
    )


def pending_rows(found: DataFrame, added_at: Column | str = "added_at") -> DataFrame:
    """Registry rows of URLs known but not fetched."""
    at = F.col(added_at) if isinstance(added_at, str) else added_at
    return found.select(
        "url",
        at.cast("timestamp").alias("discovered_at"),
        F.lit(None).cast("timestamp").alias("last_crawled"),
        F.lit(None).cast("int").alias("status_code"),
        F.lit(None).cast("string").alias("content_type"),
        "is_dynamic",
        F.col("depth").cast("int").alias("depth"),
        "parent_url",
        F.lit("pending").alias("crawl_status"),
        F.lit(None).cast("string").alias("error_message"),
        F.lit(None).cast("double").alias("response_time"),
        F.lit(None).cast("timestamp").alias("updated_at"),
    )


def frontier_rows(found: DataFrame) -> DataFrame:
    return found.select(
        "url",
        F.col("priority").cast("int").alias("priority"),
        F.col("added_at").cast("timestamp").alias("added_at"),
        F.lit(False).alias("is_processing"),
    )


@dataclass(frozen=True)
class Round:
    """What a round brings, one row per URL, written once: latest results and URLs found."""

    latest: DataFrame
    batch: DataFrame


def round_tables(found: DataFrame, crawl_log: DataFrame) -> Round:
    latest = latest_result(crawl_log.withColumn("url", U.url_normalize("url")))
    batch = first_per_key(found.withColumn("url", U.url_normalize("url")), "url", ["pos"])
    return Round(materialize(latest, "latest"), materialize(batch, "batch"))


def new_urls(found: DataFrame, registry: DataFrame) -> DataFrame:
    """URLs of a batch that the registry lacks: normalised, first position wins.

    A batch small enough to broadcast first picks its known URLs out of the registry
    scan, which then needs no shuffle.
    """
    batch = materialize(
        first_per_key(found.withColumn("url", U.url_normalize("url")), "url", ["pos"]), "batch"
    )
    known = registry.select("url")
    if will_broadcast(batch):
        known = known.join(batch.select("url"), "url", "left_semi")
    return batch.join(known, "url", "left_anti")


def registry_add(
    state: CrawlState, found: DataFrame, known: DataFrame | None = None
) -> CrawlState:
    """Add unknown URLs of ``found(url, parent_url, depth, is_dynamic, priority, pos, added_at)``.

    ``known`` may name a table of the same URLs that is cheaper to search.
    """
    # Both tables take the new rows: written once, so the registry is searched once.
    fresh = materialize(new_urls(found, state.registry if known is None else known), "fresh")
    return CrawlState(
        state.registry.unionByName(pending_rows(fresh)),
        state.frontier.unionByName(frontier_rows(fresh)),
    )


def apply_results(registry: DataFrame, results: DataFrame) -> DataFrame:
    """Overwrite the fetch columns of URLs that have a result (one per URL)."""
    r = results.select(
        "url",
        F.lit(True).alias("_hit"),
        F.struct(
            F.col("fetched_at").alias("last_crawled"),
            "status_code",
            "content_type",
            C.crawl_status("status_code", "error_message").alias("crawl_status"),
            "error_message",
            "response_time",
            F.col("fetched_at").alias("updated_at"),
        ).alias("_new"),
    )
    updated = (
        "last_crawled", "status_code", "content_type", "crawl_status",
        "error_message", "response_time", "updated_at",
    )
    joined = registry.join(r, "url", "left")
    return joined.select(
        *(
            F.when(F.col("_hit"), F.col("_new")[c]).otherwise(F.col(c)).alias(c)
            if c in updated
            else F.col(c)
            for c in registry.columns
        )
    )


def dequeue_done(frontier: DataFrame, done: DataFrame) -> DataFrame:
    return frontier.join(done.select("url").distinct(), "url", "left_anti")


def mark_crawled(state: CrawlState, crawl_log: DataFrame) -> CrawlState:
    """Write the latest result of each URL and take it off the frontier.

    The results are written once for both tables; with their real size known, a
    small round is broadcast and the registry is not shuffled.
    """
    latest = materialize(
        latest_result(crawl_log.withColumn("url", U.url_normalize("url"))), "latest"
    )
    return CrawlState(
        apply_results(state.registry, latest), dequeue_done(state.frontier, latest)
    )


def mark_skipped(state: CrawlState, skipped: DataFrame) -> CrawlState:
    """Write status ``skipped`` and the reason: ``skipped(url, reason, at)``."""
    s = first_per_key(
        skipped.select(U.url_normalize("url").alias("url"), "reason", "at"), "url", ["at", "reason"]
    ).select("url", F.struct("reason", "at").alias("_skip"))
    joined = state.registry.join(s, "url", "left")
    hit = F.col("_skip").isNotNull()
    registry = joined.select(
        *(
            {
                "crawl_status": F.when(hit, "skipped").otherwise(F.col("crawl_status")),
                "error_message": F.when(hit, F.col("_skip.reason")).otherwise(
                    F.col("error_message")
                ),
                "updated_at": F.when(hit, F.col("_skip.at").cast("timestamp")).otherwise(
                    F.col("updated_at")
                ),
            }
            .get(c, F.col(c))
            .alias(c)
            for c in state.registry.columns
        )
    )
    return CrawlState(registry, dequeue_done(state.frontier, s))


def replace_results(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` stand in for rows of ``old`` with the same URL."""
    return old.join(new.select("url").distinct(), "url", "left_anti").unionByName(new)


def uncrawled(discovered: DataFrame, crawled: DataFrame) -> DataFrame:
    return discovered.select("url").distinct().join(
        crawled.select("url").distinct(), "url", "left_anti"
    )


def merge_discovered(known: DataFrame, found: DataFrame) -> DataFrame:
    return known.select("url").unionByName(found.select("url")).distinct()


def next_urls(frontier: DataFrame, n: int) -> DataFrame:
    """The ``n`` most urgent URLs not being processed."""
    return (
        frontier.filter(~F.col("is_processing"))
        .orderBy(F.desc("priority"), F.asc("added_at"), F.asc("url"))
        .limit(n)
    )


def claim(frontier: DataFrame, n: int) -> DataFrame:
    """The frontier with its next ``n`` URLs set to processing."""
    picked = next_urls(frontier, n).select("url", F.lit(True).alias("_picked"))
    return frontier.join(picked, "url", "left").select(
        "url",
        "priority",
        "added_at",
        (F.col("is_processing") | F.coalesce("_picked", F.lit(False))).alias("is_processing"),
    )


def clear_processing(frontier: DataFrame) -> DataFrame:
    return frontier.withColumn("is_processing", F.lit(False))


def batch_frontier(frontier: DataFrame, size: int) -> DataFrame:
    """The ordered frontier cut into numbered batches."""
    order = [F.desc("priority"), F.asc("added_at"), F.asc("url")]
    return ranked(frontier, order).withColumn(
        "batch_no", F.floor((F.col("rn") - 1) / size).cast("bigint")
    )


def new_batch(
    results: DataFrame, rules: Rules = STANDARD, max_depth: int | None = None
) -> DataFrame:
    """URLs found by fetches: ``results(url, depth, fetched_at, discovered_urls)``.

    Results at the depth limit bring no new URLs.
    """
    limit = rules.max_depth if max_depth is None else max_depth
    found = F.filter(
        "discovered_urls",
        lambda u: U.is_target_domain(u, rules) & ~U.should_skip_url(u, rules),
    )
    return (
        results.filter(F.col("depth") < limit)
        .select(
            F.col("url").alias("parent_url"),
            (F.col("depth") + 1).cast("int").alias("depth"),
            C.frontier_priority("depth").alias("priority"),
            F.col("fetched_at").alias("added_at"),
            F.explode(found).alias("url"),
        )
        .select(
            "url",
            "parent_url",
            "depth",
            U.is_dynamic_url("url", rules).alias("is_dynamic"),
            "priority",
            "added_at",
        )
    )


def process_results(
    state: CrawlState, results: DataFrame, rules: Rules = STANDARD, max_depth: int | None = None
) -> CrawlState:
    """Absorb one round: mark what was fetched, then add what it found.

    Among finders of a URL the least depth wins, then time, then parent URL.
    """
    found = new_batch(results, rules, max_depth).withColumn(
        "pos", F.struct("depth", "added_at", "parent_url", "url")
    )
    marked = mark_crawled(state, results.drop("discovered_urls", "depth"))
    # Marking changes no URL, so the registry as given is searched, not the lazy result.
    return registry_add(marked, found, state.registry)


def parent_lineage(registry: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each URL beside the row of its parent; a parent may own a third of all URLs."""
    child = registry.select("url", "depth", "parent_url")
    parent = registry.select(
        F.col("url").alias("_parent"),
        F.col("depth").alias("parent_depth"),
        F.col("crawl_status").alias("parent_status"),
    )
    joined = lookup_join(child, parent, "parent_url", "_parent", "left", ["url"], hot_rows)
    return joined.select(
        "url",
        "depth",
        "parent_url",
        "parent_depth",
        "parent_status",
        (F.col("depth") == F.col("parent_depth") + 1).alias("depth_follows"),
    )
