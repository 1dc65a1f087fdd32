"""Rendered pages as snapshots: links that appear from one step to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import url as U
from ..rules import Rules, STANDARD
from ..session import materialize
from .links import normalized_links, option_paths, own_url
from .skew import HOT_ROWS, join_parts, lookup_join


def snapshot_links(snapshots: DataFrame) -> DataFrame:
    """``(url, step, dst_url)``: distinct absolute anchor and area links per snapshot."""
    staged = snapshots.select(
        "url", "step", U.url_split("url").alias("base"), H.strip_noise("html").alias("markup")
    )
    base, markup = F.col("base"), F.col("markup")
    raws = F.array_distinct(F.concat(H.hrefs_of(markup, "a"), H.hrefs_of(markup, "area")))
    refs = F.transform(raws, lambda r: U.url_split(r))
    urls = F.transform(
        F.transform(refs, lambda r: U.resolve_parts(base, r)), lambda u: U.unsplit_parts(u)
    )
    return staged.select("url", "step", F.explode(F.array_distinct(urls)).alias("dst_url"))


def snapshot_delta(
    snapshots: DataFrame,
    stop_on_empty: bool = True,
    max_steps: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Links new at each step against the step before: ``(url, step, dst_url)``.

    All steps count, or those up to ``max_steps``. With ``stop_on_empty`` a step that brings nothing ends the page. The comparison
    is an anti join on page, step and link, so a page with very many links is spread. Joins are dealt over as many
    partitions as the links need.
    """
    # The links serve several joins below: parse the markup once.
    if max_steps is not None:
        snapshots = snapshots.filter(F.col("step") <= max_steps)
    links = materialize(snapshot_links(snapshots), "snapshots")
    parts = join_parts(links)
    keys = ["url", "step", "dst_url"]
    before = links.select("url", (F.col("step") + 1).alias("step"), "dst_url").repartition(parts, *keys)
    delta = links.filter(F.col("step") > 0).repartition(parts, *keys).join(before.hint("merge"), keys, "left_anti")
    if not stop_on_empty:
        return delta
    delta = materialize(delta, "delta")
    steps = snapshots.filter(F.col("step") > 0).select("url", "step").distinct().repartition(parts, "url", "step")
    useful = delta.select("url", "step").distinct().repartition(parts, "url", "step")
    stops = (
        steps.join(useful.hint("merge"), ["url", "step"], "left_anti")
        .groupBy(F.col("url").alias("_url"))
        .agg(F.min("step").alias("_stop"))
    )
    joined = lookup_join(delta, stops, "url", "_url", "left", ["dst_url", "step"], hot_rows, parts)
    return joined.filter(F.col("_stop").isNull() | (F.col("step") < F.col("_stop"))).select(
        "url", "step", "dst_url"
    )


def extract_links_rendered(snapshots: DataFrame, rules: Rules = STANDARD) -> DataFrame:
    """All candidate URLs of rendered pages: ``(src_url, dst_url)``, distinct.

    Every snapshot counts in full: anchors, areas, ``data-*`` URLs, pagination and filter
    options, at whatever step they appear; then the filters of the static extraction.
    """
    staged = snapshots.select(
        F.col("url").alias("src_url"),
        "step",
        U.url_split("url").alias("base"),
        H.strip_noise("html").alias("markup"),
    ).withColumn("own", own_url(rules))
    markup = F.col("markup")
    raws = F.array_distinct(
        F.concat(
            H.hrefs_of(markup, "a"),
            H.hrefs_of(markup, "area"),
            H.data_urls(markup),
            H.pagination_hrefs(markup),
            option_paths(markup, "rendered"),
        )
    )
    return staged.select(
        "src_url",
        F.explode(normalized_links(raws, F.col("base"), F.col("own"), rules)).alias("dst_url"),
    ).distinct()


def diff_urls(after: DataFrame, before: DataFrame) -> DataFrame:
    """Distinct URLs of ``after`` that ``before`` lacks."""
    return after.select("url").subtract(before.select("url"))
