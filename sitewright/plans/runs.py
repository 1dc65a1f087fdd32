"""Whole runs over a stored corpus: crawl by levels, then the site's output files."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import url as U
from ..operators import filters, generate as G, graph, keyed, links as L, registry as R
from ..operators import schedule, sitemap as S, stats
from ..operators.registry import CrawlState
from ..rules import FINAL, Rules, STANDARD
from ..session import materialize, work_path
from ..sources import sitemap_files as X
from ..sources.tables import reset_registry


def results_of(pages: DataFrame, crawl_log: DataFrame, rules: Rules = STANDARD) -> DataFrame:
    """Latest fetch per normalised URL with the links its page holds; written once."""
    latest = R.latest_result(crawl_log.withColumn("url", U.normalize("url", rules)))
    found = L.links_per_page(pages, rules).select(
        U.normalize("src_url", rules).alias("url"), "src_url", "discovered_urls"
    )
    first = R.first_per_key(found, "url", ["src_url"]).select("url", "discovered_urls")
    nothing = F.array().cast("array<string>")
    joined = latest.join(first, "url", "left").withColumn(
        "discovered_urls", F.coalesce("discovered_urls", nothing)
    )
    return materialize(joined, "results")


def crawl(
    seeds: DataFrame,
    results: DataFrame,
    seeded_at: str,
    rules: Rules = STANDARD,
    path: str | None = None,
) -> CrawlState:
    """Replay a crawl by breadth-first levels: ``seeds(url)``, ``results`` of ``results_of``.

    Each level takes the frontier's URLs that have a result, marks them, adds what
    they link to, and stores the changed rows of both tables under ``path``; a level costs what it
    changes, and once changes outgrow the base they are folded into it. URLs without a result stay pending.
    """
    spark = results.sparkSession
    path = path or work_path(spark, "crawl")
    empty = CrawlState(*reset_registry(spark))
    seeded = R.registry_add(empty, R.seed_batch(seeds, seeded_at))
    state = keyed.KeyedState.of(seeded, path)
    for _ in range(rules.max_depth + 1):
        now = state.current()
        waiting = now.registry.join(now.frontier.select("url"), "url", "left_semi")
        level = materialize(
            results.join(waiting.select("url", "depth"), "url"), "level"
        )
        if level.isEmpty():
            break
        keyed.process_results(state, level, rules)
        state.compact_if_outgrown()
    return state.current()


def publish(
    state: CrawlState, out_dir: str, now: Column, rules: Rules = STANDARD, gzip: bool = False
) -> DataFrame:
    """Sitemaps, index and robots.txt of a crawl; returns the validation report."""
    entries = S.build_entries(filters.valid_urls(state.registry), rules)
    names = X.write_site(entries, out_dir, rules.base_urls[0], now, rules.urls_per_sitemap, gzip)
    spark = state.registry.sparkSession
    if not names:
        return spark.createDataFrame([], "file string, kind string, urls bigint, valid boolean, file_size_mb double")
    return X.validate_sitemaps(spark, f"{out_dir}/sitemap*.xml", rules.urls_per_sitemap)


@dataclass(frozen=True)
class FinalRun:
    """``discovered(url, depth)``, ``results`` per URL, ``to_render``: the short list."""

    discovered: DataFrame
    results: DataFrame
    to_render: DataFrame

    def stats(self) -> DataFrame:
        return stats.final_stats(self.discovered, self.results)

    def with_rendered(self, rendered: DataFrame) -> FinalRun:
        """Rendered results stand in for the static ones and add what they found.

        ``rendered`` has the columns of ``results`` and ``discovered_urls``. URLs
        added here are known but not fetched.
        """
        chosen = rendered.join(self.to_render.select("url"), "url", "left_semi")
        ok = F.coalesce("error_message", F.lit("")) == ""
        extra = chosen.filter(ok).select(
            F.explode("discovered_urls").alias("url"), F.lit(None).cast("int").alias("depth")
        )
        fresh = extra.distinct().join(self.discovered.select("url"), "url", "left_anti")
        return FinalRun(
            self.discovered.unionByName(fresh),
            R.replace_results(self.results, chosen.drop("discovered_urls")),
            self.to_render,
        )

    def entries(self, now: Column, rules: Rules = FINAL) -> DataFrame:
        return S.build_entries_final(self.results, now, rules)


def crawl_final(
    pages: DataFrame,
    crawl_log: DataFrame,
    seeds: DataFrame,
    dimensions: G.Dimensions,
    rules: Rules = FINAL,
) -> FinalRun:
    """The final rules: links and template URLs by levels, failed pages lead nowhere.

    Template URLs belong to an origin, not to a page, so each level adds them once
    per origin it reached instead of as edges of every page.
    """
    latest = materialize(
        R.latest_result(crawl_log.withColumn("url", U.normalize("url", rules))), "results"
    )
    fine = latest.filter(F.coalesce("error_message", F.lit("")) == "").select("url")
    static = L.extract_links(pages, replace(rules, generate=False))
    edges = static.select(
        U.normalize("src_url", rules).alias("src"), F.col("dst_url").alias("dst")
    ).join(fine.withColumnRenamed("url", "src"), "src", "left_semi")
    stored = pages.select(U.normalize("url", rules).alias("node")).distinct().join(
        fine.withColumnRenamed("url", "node"), "node", "left_semi"
    )
    parsed = materialize(
        stored.filter(U.is_target_domain("node", rules)), "parsed"
    )
    paths = G.path_rows(dimensions, G.all_paths, rules)

    def templates(level: DataFrame) -> DataFrame:
        origins = (
            level.join(parsed, "node", "left_semi")
            .select(U.url_origin("node").alias("origin"))
            .distinct()
            .filter(~U.should_skip_url(F.concat("origin", F.lit("/")), rules))
        )
        return G.on_origins(origins, paths).select(F.col("url").alias("node"))

    start = seeds.select(U.normalize("url", rules).alias("node"))
    found = graph.bfs_depth(start, edges, rules.max_depth, templates).select(
        F.col("node").alias("url"), "depth"
    )
    crawled = latest.join(found.select("url"), "url", "left_semi")
    return FinalRun(found, crawled, schedule.topk_per_class(found, rules))
