"""Sitemap rows: entries, numbering, index, robots lines, validation, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import url as U
from ..rules import FINAL, MAX_URLS_PER_SITEMAP, Rules, STANDARD, URL_TYPE_CHANGEFREQ, URL_TYPE_PRIORITY
from .filters import valid_urls, valid_urls_final
from .skew import ranked


def build_entries(registry: DataFrame, rules: Rules = STANDARD) -> DataFrame:
    """Registry rows to ``(loc, lastmod, changefreq, priority)``."""
    typed = registry.select(
        F.col("url").alias("loc"),
        C.iso_lastmod("last_crawled").alias("lastmod"),
        C.classify_url_type("url", rules).alias("_type"),
    )
    return typed.select(
        "loc",
        "lastmod",
        C._lookup(URL_TYPE_CHANGEFREQ, F.col("_type")).alias("changefreq"),
        C._lookup(URL_TYPE_PRIORITY, F.col("_type")).alias("priority"),
    )


def build_entries_final(results: DataFrame, now: Column, rules: Rules = FINAL) -> DataFrame:
    """Final rules: status 200 only, one clock value for every row."""
    return valid_urls_final(results).select(
        F.col("url").alias("loc"),
        C.iso_lastmod(now).alias("lastmod"),
        C.url_changefreq_final("url").alias("changefreq"),
        C.url_priority_final("url", rules.base_urls[0]).alias("priority"),
    )


def type_lookup(urls: DataFrame, rules: Rules = STANDARD) -> DataFrame:
    """Type, priority and changefreq per URL, by a join with the nine-row rule table."""
    table = urls.sparkSession.createDataFrame(
        [(t, p, URL_TYPE_CHANGEFREQ[t]) for t, p in URL_TYPE_PRIORITY.items()],
        "url_type string, priority double, changefreq string",
    )
    return urls.select("url", C.classify_url_type("url", rules).alias("url_type")).join(
        F.broadcast(table), "url_type", "left"
    )


def chunk_sitemaps(entries: DataFrame, per_file: int = MAX_URLS_PER_SITEMAP) -> DataFrame:
    """Number the sitemap of each entry: blocks of ``per_file`` in URL order, from 1."""
    return ranked(entries, [F.asc("loc")]).select(
        *entries.columns, block_of("rn", per_file).alias("sitemap_no")
    )


def build_sitemap(registry: DataFrame, rules: Rules = STANDARD) -> DataFrame:
    """Valid URLs of a registry as numbered sitemap entries."""
    return chunk_sitemaps(build_entries(valid_urls(registry), rules), rules.urls_per_sitemap)


def sitemap_files(chunks: DataFrame) -> DataFrame:
    """``(sitemap_no, filename, urls)``; a lone sitemap carries no number."""
    sizes = chunks.groupBy("sitemap_no").agg(F.count(F.lit(1)).alias("urls"))
    last = chunks.agg(F.max("sitemap_no").alias("m")).scalar()
    return sizes.select(
        "sitemap_no",
        F.when(last == 1, "sitemap.xml")
        .otherwise(F.format_string("sitemap_%03d.xml", F.col("sitemap_no")))
        .alias("filename"),
        "urls",
    )


def _under(base_url: str, path: Column) -> Column:
    return U.url_resolve(path, F.lit(base_url.rstrip("/") + "/"))


def sitemap_index(files: DataFrame, base_url: str, now: Column, folder: str = "sitemap/") -> DataFrame:
    """Index rows ``(loc, lastmod)``; none for a lone sitemap."""
    return files.filter(F.col("filename") != "sitemap.xml").select(
        _under(base_url, F.concat(F.lit(folder), "filename")).alias("loc"),
        C.iso_lastmod(now).alias("lastmod"),
    )


def block_of(rank: str, per_file: int) -> Column:
    return F.floor((F.col(rank) - 1) / per_file) + 1


def index_name(no: str | Column, last: Column) -> Column:
    """File name of an index: a lone one carries no number."""
    return F.when(last == 1, "sitemap_index.xml").otherwise(F.format_string("sitemap_index_%03d.xml", no))


def robots_txt(files: DataFrame, base_url: str, per_index: int = MAX_URLS_PER_SITEMAP) -> DataFrame:
    """robots.txt as ``(line_no, line)``: the lone sitemap, or a line for each index."""
    counted = files.agg(F.count(F.lit(1)).alias("n"), F.max("filename").alias("only")).withColumn(
        "last", F.ceil(F.col("n") / per_index)
    )
    names = F.when(F.col("n") == 1, F.array("only")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest("last", F.lit(1))), lambda i: index_name(i, F.greatest("last", F.lit(1))))
    )
    targets = F.transform(
        names, lambda name: F.concat(F.lit("Sitemap: "), _under(base_url, F.concat(F.lit("sitemap/"), name)))
    )
    head = F.array(F.lit("User-agent: *"), F.lit("Allow: /"), F.lit(""))
    return counted.select(F.posexplode(F.concat(head, targets)).alias("line_no", "line"))


def robots_txt_final(files: DataFrame, base_url: str, index: str = "sitemap_index.xml") -> DataFrame:
    """robots.txt of the final rules: the sitemap at the site root or the file called ``index``, no blank line."""
    name = F.when(F.col("n") == 1, "sitemap.xml").otherwise(index)
    lines = F.array(
        F.lit("User-agent: *"),
        F.lit("Allow: /"),
        F.concat(F.lit(f"Sitemap: {base_url.rstrip('/')}/"), name),
    )
    some = files.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 0)
    return some.select(F.posexplode(lines).alias("line_no", "line"))


def sitemap_stats(rows: DataFrame, key: str = "sitemap_no") -> DataFrame:
    """Per sitemap: URLs and how many carry each optional field."""
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_urls"),
        F.count("lastmod").alias("has_lastmod"),
        F.count("changefreq").alias("has_changefreq"),
        F.count("priority").alias("has_priority"),
    )


def value_distribution(rows: DataFrame, field: str, key: str = "sitemap_no") -> DataFrame:
    return (
        rows.filter(F.col(field).isNotNull())
        .groupBy(key, field)
        .agg(F.count(F.lit(1)).alias("urls"))
    )
