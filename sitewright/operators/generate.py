"""Candidate URLs from templates and dimensions.

Dimensions (locations, categories, ...) are tables of ``(pos, value)``. Templates are
filled row by row; where two tables must be paired, one is copied to a number of
buckets and the other dealt over them, so pairs come from an equality join that
spreads over the cluster, and no dimension is gathered in one row or task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import url as U
from ..session import materialize, shuffle_partitions


@dataclass(frozen=True)
class Dimensions:
    """One table ``(pos, value)`` per dimension."""

    location: DataFrame
    category: DataFrame
    type: DataFrame
    level: DataFrame
    salary: DataFrame


Paths = Callable[[Dimensions], DataFrame]


def value_rows(spark: SparkSession, values: Iterable[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(values)), "pos int, value string")


def dimension(df: DataFrame, pos: str, value: str) -> DataFrame:
    return df.select(F.col(pos).alias("pos"), F.col(value).alias("value"))


def literal_dimensions(
    spark: SparkSession, location: Iterable[str], category: Iterable[str]
) -> Dimensions:
    return table_dimensions(value_rows(spark, location), value_rows(spark, category))


def table_dimensions(location: DataFrame, category: DataFrame) -> Dimensions:
    spark = location.sparkSession
    return Dimensions(
        location=location,
        category=category,
        type=value_rows(spark, R.JOB_TYPES),
        level=value_rows(spark, R.JOB_LEVELS),
        salary=value_rows(spark, R.SALARY_BANDS),
    )


def paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every row of ``left`` with every row of ``right``; column names must differ.

    Left rows are copied once per bucket, right rows dealt over the buckets: each
    bucket is one share of the pairs, whatever the values are.
    """
    n = shuffle_partitions(left.sparkSession)
    copied = left.withColumn("_bucket", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    dealt = right.withColumn(
        "_bucket", F.pmod(F.xxhash64(*right.columns), F.lit(n)).cast("int")
    )
    return copied.join(dealt, "_bucket").drop("_bucket")


def _filled(rows: DataFrame, templates: tuple[str, ...], **values: str) -> DataFrame:
    def path(template: str) -> Column:
        return reduce(
            lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), F.col(kv[1])),
            values.items(),
            F.lit(template),
        )

    return rows.select(F.explode(F.array(*map(path, templates))).alias("path"))


def fill(templates: tuple[str, ...], name: str, values: DataFrame) -> DataFrame:
    """Every template with every value of one dimension."""
    return _filled(values, templates, **{name: "value"})


def fill_pairs(
    templates: tuple[str, ...], locations: DataFrame, categories: DataFrame
) -> DataFrame:
    """Every template with every (location, category) pair."""
    pairs = paired(
        locations.select(F.col("value").alias("_location")),
        categories.select(F.col("value").alias("_category")),
    )
    return _filled(pairs, templates, location="_location", category="_category")


def top(values: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` values of a dimension, all for ``None``."""
    return values if n is None else values.orderBy("pos").limit(n)


def unite(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, parts)


def location_paths(d: Dimensions) -> DataFrame:
    return fill(R.LOCATION_TEMPLATES, "location", d.location)


def category_paths(d: Dimensions) -> DataFrame:
    return fill(R.CATEGORY_TEMPLATES, "category", d.category)


def type_level_paths(d: Dimensions) -> DataFrame:
    return unite(
        fill(R.TYPE_TEMPLATES, "type", d.type), fill(R.LEVEL_TEMPLATES, "level", d.level)
    )


def salary_paths(d: Dimensions) -> DataFrame:
    return fill(R.SALARY_TEMPLATES, "salary", d.salary)


def combo_paths(d: Dimensions, n: int | None = None) -> DataFrame:
    """Pairs of all values, or of the first ``n`` of each dimension."""
    return fill_pairs(R.COMBO_TEMPLATES, top(d.location, n), top(d.category, n))


def all_paths(d: Dimensions, n: int | None = None) -> DataFrame:
    return unite(
        location_paths(d), category_paths(d), type_level_paths(d), combo_paths(d, n), salary_paths(d)
    )


def templates_for(templates: tuple[str, ...], name: str) -> tuple[str, ...]:
    """Templates whose placeholders are all of the given dimension."""
    return tuple(t for t in templates if t.count("{") == t.count("{" + name + "}") > 0)


def pattern_paths(d: Dimensions, n: int | None = None) -> DataFrame:
    """Template URLs of the discovery rules: one dimension each, then pairs."""
    return unite(
        fill(templates_for(R.PATTERN_TEMPLATES, "location"), "location", d.location),
        fill(templates_for(R.PATTERN_TEMPLATES, "category"), "category", d.category),
        fill_pairs(R.PATTERN_COMBO_TEMPLATES, top(d.location, n), top(d.category, n)),
    )


def search_param_paths(d: Dimensions) -> DataFrame:
    """Seven fixed parameters on two endpoints."""
    rows = [(e, k, v) for e in ("/search", "/jobs") for k, v in R.SEARCH_PARAMS]
    fixed = d.location.sparkSession.createDataFrame(rows, "e string, k string, v string")
    return fixed.select(F.concat("e", F.lit("?"), "k", F.lit("="), U.form_encode("v")).alias("path"))


_ANY_ORIGIN = "http://h"


def path_rows(d: Dimensions, paths: Paths, rules: R.Rules | None = None) -> DataFrame:
    """The normalised distinct paths of ``paths``: ``(path)``, written once.

    Normalisation touches only what follows the origin, so it is done here and not
    once per origin. With ``rules``, paths to skip are dropped.
    """
    full = paths(d).select(U.url_split(F.concat(F.lit(_ANY_ORIGIN), "path")).alias("u"))
    cut = full.select(
        F.substring(U.normalize_parts_fast(F.col("u")), len(_ANY_ORIGIN) + 1, 1 << 30).alias("path")
    ).distinct()
    if rules is not None:
        cut = cut.filter(~U.should_skip_url("path", rules))
    return materialize(cut, "paths")


def on_origins(origins: DataFrame, paths: DataFrame) -> DataFrame:
    """Every path on every row of ``origins``, as ``url`` beside the given columns."""
    rows = paired(origins, paths)
    return rows.select(*origins.columns, F.concat("origin", "path").alias("url"))


def candidates(origins: DataFrame, d: Dimensions, paths: Paths) -> DataFrame:
    """Distinct normalised candidate URLs: every path on every origin.

    ``origins`` holds distinct origins and the paths are distinct, so the result
    needs no duplicate removal.
    """
    return on_origins(origins.select("origin"), path_rows(d, paths))


def site_origins(pages: DataFrame) -> DataFrame:
    """Distinct ``scheme://host`` of the corpus, scheme in lower case."""
    return pages.select(U.url_origin("url").alias("origin")).distinct()


def probe_sitemap_paths(origins: DataFrame) -> DataFrame:
    """The usual places of a sitemap on each origin."""
    return origins.select(
        "origin",
        F.explode(
            F.transform(
                F.array(*map(F.lit, R.SITEMAP_PATHS)), lambda p: U.url_resolve(p, F.col("origin"))
            )
        ).alias("url"),
    )


def api_candidates(probes: DataFrame, d: Dimensions, n: int | None = None) -> DataFrame:
    """Parameter URLs for API endpoints known to answer 200 with JSON."""
    good = (
        probes.filter(
            (F.col("status_code") == 200)
            & F.contains("content_type", F.lit("json"))
            & U.url_path("url").isin(*R.API_ENDPOINTS)
        )
        .select("url")
        .distinct()
    )
    plain = good.sparkSession.createDataFrame([("",)], "suffix string")
    suffixes = unite(
        plain,
        top(d.location, n).select(F.concat(F.lit("?location="), "value").alias("suffix")),
        top(d.category, n).select(F.concat(F.lit("?category="), "value").alias("suffix")),
    ).distinct()
    return paired(good, suffixes).select(
        F.col("url").alias("endpoint"), F.concat("url", "suffix").alias("url")
    )


def discovery(strategies: dict[str, DataFrame]) -> DataFrame:
    """URLs of all strategies, tagged: ``(strategy, url)``."""
    tagged = [
        df.select(F.lit(name).alias("strategy"), "url") for name, df in strategies.items()
    ]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df)
    return out


def union_strategies(strategies: dict[str, DataFrame]) -> DataFrame:
    return discovery(strategies).select("url").distinct()


def discovery_by_strategy(strategies: dict[str, DataFrame]) -> DataFrame:
    """Distinct URLs per strategy, and of all together under ``all``.

    Distinct first, with the strategy flags of each URL kept beside it, so that
    the counts need no second pass over the URLs.
    """
    names = list(strategies)
    flags = (
        discovery(strategies)
        .groupBy("url")
        .agg(*(F.max(F.col("strategy") == n).alias(f"_s{i}") for i, n in enumerate(names)))
    )
    counts = flags.agg(
        *(F.count_if(F.col(f"_s{i}")).alias(f"_s{i}") for i in range(len(names))),
        F.count(F.lit(1)).alias("_all"),
    )
    rows = F.array(
        *(
            F.struct(F.lit(n).alias("strategy"), F.col(f"_s{i}").alias("urls"))
            for i, n in enumerate(names)
        ),
        F.struct(F.lit("all").alias("strategy"), F.col("_all").alias("urls")),
    )
    return counts.select(F.explode(rows).alias("r")).select("r.strategy", "r.urls")
