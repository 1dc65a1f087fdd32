"""Many sites in one run: rule sets by host, as a table that URLs are joined with.

``sites(host, site, rules)`` has a row for each host: the site it belongs to and the name of the rule set
that holds there. Its size does not enter the plan: a small table is broadcast by Spark, a large one is met in a join
that splits the hosts of very many URLs. Rule sets are few and given by name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import url as U
from ..rules import FAST, FINAL, Rules, STANDARD
from .skew import HOT_ROWS, lookup_join

RULE_SETS = {r.name: r for r in (STANDARD, FAST, FINAL)}


def by_rules(name: Column, rule_sets: dict[str, Rules], made: Callable[[Rules], Column]) -> Column:
    """What ``made`` gives for the rule set of that name; null for an unknown one."""
    out = None
    for own, rules in rule_sets.items():
        out = (F.when if out is None else out.when)(name == own, made(rules))
    return out


def on_sites(urls: DataFrame, sites: DataFrame, column: str = "url", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows whose URL lies on a host of ``sites``, with its ``site`` and ``rules``."""
    hosts = sites.select(F.lower("host").alias("_host"), "site", "rules")
    keyed = urls.withColumn("_on", U.url_domain(column))
    salt = [c for c in urls.columns if c == column] or urls.columns
    return lookup_join(keyed, hosts, "_on", "_host", "inner", salt, hot_rows).drop("_on", "_host")


def filter_candidates(
    links: DataFrame, sites: DataFrame, rule_sets: dict[str, Rules] = RULE_SETS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Links ``(src_url, dst_url)`` that stay on their page's site, by the rules of the target's host.

    Skipped URLs and links to the page itself go. A site may have many hosts, a run many sites.
    """
    sources = on_sites(links, sites, "src_url", hot_rows).withColumnRenamed("site", "_site").drop("rules")
    both = on_sites(sources, sites, "dst_url", hot_rows).filter(F.col("site") == F.col("_site"))
    rules = F.col("rules")
    skipped = by_rules(rules, rule_sets, lambda r: U.should_skip_url("dst_url", r))
    itself = by_rules(rules, rule_sets, lambda r: F.col("dst_url") == U.normalize("src_url", r))
    return both.filter(~skipped & ~itself).select(*links.columns, "site", "rules")


def route(urls: DataFrame, sites: DataFrame, rule_sets: dict[str, Rules] = RULE_SETS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """URLs on known hosts, tagged with the way they are to be fetched by their host's rules."""
    dynamic = by_rules(F.col("rules"), rule_sets, lambda r: U.is_dynamic_url("url", r))
    return on_sites(urls, sites, "url", hot_rows).withColumn("route", F.when(dynamic, "dynamic").otherwise("static"))
