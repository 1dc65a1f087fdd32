"""robots.txt: lines to rules, and the verdict per URL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import url as U
from ..functions.html import strip_ws
from ..session import materialize
from .skew import HOT_ROWS, lookup_join, ranked


def _text(line: Column) -> Column:
    return strip_ws(F.regexp_replace(line, "#.*$", ""))


BLOCK = 10_000


@dataclass(frozen=True)
class RobotsTables:
    """Parsed robots.txt files.

    ``agents(host, group_no, agent)`` in lower case; ``rules(host, group_no, rule_no,
    allow, path)`` with decoded paths. The two meet by group only: a group's agents
    and rules are never paired up.
    """

    agents: DataFrame
    rules: DataFrame


def _line_kinds(lines: DataFrame) -> DataFrame:
    """Lines that count: ``(host, line_no, kind, value)``."""
    field = F.lower(F.trim(F.substring_index(_text(F.col("line")), ":", 1)))
    value = U.percent_decode(F.trim(F.regexp_replace(_text(F.col("line")), "^[^:]*:", "")))
    kind = (
        F.when(F.col("line") == "", "blank")
        .when(~F.contains(_text(F.col("line")), F.lit(":")), None)
        .when(field == "user-agent", "agent")
        .when(field.isin("allow", "disallow"), field)
        .when(field.isin("crawl-delay", "request-rate"), "other")
    )
    return lines.select("host", "line_no", kind.alias("kind"), value.alias("value")).filter(
        F.col("kind").isNotNull()
    )


def _grouped_lines(lines: DataFrame, block: int) -> DataFrame:
    """Lines with their group number and whether an agent line still holds.

    A group opens at an agent line that does not follow another one. Both facts
    depend on earlier lines, so lines are numbered and read in blocks: each block
    is one small window, and what it needs from before comes from one summary row
    per earlier block. A long file is spread like many short ones.
    """
    numbered = ranked(_line_kinds(lines), [F.asc("line_no")], ["host"], "no").withColumn(
        "block", F.floor((F.col("no") - 1) / block)
    )
    is_state = F.col("kind").isin("agent", "blank")
    blocks = Window.partitionBy("host").orderBy("block")
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    tails = numbered.groupBy("host", "block").agg(
        F.max_by("kind", "no").alias("tail"),
        F.max(F.when(is_state, F.struct("no", "kind")))["kind"].alias("state"),
    )
    carried = tails.select(
        "host",
        "block",
        F.lag("tail").over(blocks).alias("tail_before"),
        F.last("state", ignorenulls=True).over(earlier).alias("state_before"),
    )
    in_block = Window.partitionBy("host", "block").orderBy("no")
    previous = F.coalesce(F.lag("kind").over(in_block), F.col("tail_before"), F.lit(""))
    state = F.last(F.when(is_state, F.col("kind")), ignorenulls=True).over(in_block)
    opened = (
        numbered.join(carried, ["host", "block"])
        .withColumn("opens", ((F.col("kind") == "agent") & (previous != "agent")).cast("int"))
        .withColumn("state", F.coalesce(state, "state_before"))
    )
    opened = materialize(opened.drop("tail_before", "state_before"), "robots-lines")
    sums = opened.groupBy("host", "block").agg(F.sum("opens").alias("n"))
    before = sums.select(
        "host", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("groups_before")
    )
    return opened.join(before, ["host", "block"]).withColumn(
        "group_no", F.col("groups_before") + F.sum("opens").over(in_block)
    )


def parse_robots(lines: DataFrame, block: int = BLOCK) -> RobotsTables:
    """``lines(host, line_no, line)`` to agents and rules.

    A group is a run of agent lines and the rules under it; a blank line ends it.
    """
    grouped = materialize(_grouped_lines(lines, block), "robots-groups")
    agents = grouped.filter(F.col("kind") == "agent").select(
        "host", "group_no", F.lower("value").alias("agent")
    )
    rules = grouped.filter(
        F.col("kind").isin("allow", "disallow", "other") & (F.col("state") == "agent")
    ).select(
        "host",
        "group_no",
        F.col("line_no").alias("rule_no"),
        # An empty Disallow allows everything. A delay makes its group count though
        # it matches no path: its path is null.
        ((F.col("kind") != "disallow") | (F.col("value") == "")).alias("allow"),
        F.when(F.col("kind") != "other", F.col("value")).alias("path"),
    )
    return RobotsTables(agents, rules)


def applicable_rules(
    tables: RobotsTables, user_agent: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Rules of the one group per host that binds ``user_agent``.

    The first group in file order whose agent is part of the name, the first ``*``
    group last; a group that lists ``*`` among its agents counts as such and no
    other; groups without rules do not count.
    """
    name = user_agent.split("/")[0].lower()
    named = (F.col("agent") != "*") & F.contains(F.lit(name), F.col("agent"))
    groups = (
        tables.agents.groupBy("host", "group_no")
        .agg(F.max(named).alias("named"), F.max(F.col("agent") == "*").alias("is_default"))
        .filter(F.col("named") | F.col("is_default"))
        .join(tables.rules.select("host", "group_no").distinct(), ["host", "group_no"], "left_semi")
    )
    key = F.concat_ws(" ", "host", "group_no")
    chosen = (
        groups.groupBy("host")
        .agg(F.min_by("group_no", F.struct("is_default", "group_no")).alias("group_no"))
        .select(key.alias("_chosen"))
    )
    rules = tables.rules.withColumn("_group", key)
    return lookup_join(
        rules, chosen, "_group", "_chosen", "left_semi", ["rule_no"], hot_rows
    ).select("host", "rule_no", "allow", "path")


def robots_path(url: Column | str) -> Column:
    """The part of a URL that rules are matched with, percent escapes decoded."""
    return U.let(
        U.url_split(U.percent_decode(U._col(url))),
        lambda u: U.let(
            F.concat(
                u.path,
                F.when(u.query != "", F.concat(F.lit("?"), u.query)).otherwise(F.lit("")),
                F.when(u.fragment != "", F.concat(F.lit("#"), u.fragment)).otherwise(F.lit("")),
            ),
            lambda p: F.when(p == "", F.lit("/")).otherwise(p),
        ),
    )


def robots_allowed(
    urls: DataFrame,
    tables: RobotsTables,
    user_agent: str,
    hot_rows: int = HOT_ROWS,
    fetches: DataFrame | None = None,
) -> DataFrame:
    """``(url, allowed)``: the first rule in file order whose path is a prefix decides.

    ``fetches(host, status_code)``, one row a host, says how its robots.txt was answered. A host
    that refused it or failed is closed, one that has none or did not answer is open, whatever
    rules are on file; hosts without such a row go by their rules.

    Instead of comparing every URL with every rule of its host, a URL is cut at the
    path lengths its host's rules have, and the pieces are looked up as keys. A
    host's lengths are a set of small integers whatever the number of its rules.
    """
    # Written once: both lookups below read it, and its real size decides their joins.
    bound = materialize(
        applicable_rules(tables, user_agent, hot_rows).withColumn("_len", F.length("path")),
        "robots",
    )
    first = bound.groupBy("host", "path").agg(
        F.min_by(F.struct("rule_no", "allow"), "rule_no").alias("_rule")
    )
    lengths = bound.groupBy(F.col("host").alias("_host")).agg(
        F.collect_set("_len").alias("_lengths")
    )
    keyed = urls.select("url").distinct().select(
        "url", U.url_domain("url").alias("host"), robots_path("url").alias("_path")
    )
    if fetches is None:
        keyed = keyed.withColumn("_policy", F.lit("rules"))
    else:
        policies = fetches.select(
            F.col("host").alias("_fetched"), robots_fetch_policy("status_code").alias("_policy")
        )
        keyed = lookup_join(keyed, policies, "host", "_fetched", "left", ["url"], hot_rows).drop("_fetched")
    by_rules = F.coalesce("_policy", F.lit("rules")) == "rules"
    cuts = F.when(by_rules, F.filter("_lengths", lambda n: n <= F.length("_path")))
    pieces = (
        lookup_join(keyed, lengths, "host", "_host", "left", ["url"], hot_rows)
        .withColumn("_cut", F.explode_outer(cuts))
        .select(
            "url",
            (F.col("_policy") == "none").alias("_closed"),
            F.col("host").alias("_h"),
            F.substring("_path", F.lit(1), F.col("_cut")).alias("_piece"),
        )
    )
    # A short piece of a large host is the piece of very many URLs: such keys are dealt by their size.
    by_piece = first.select(F.concat_ws("\x00", "host", "path").alias("_rule_key"), "_rule")
    keyed_pieces = pieces.withColumn("_key", F.concat_ws("\x00", "_h", F.coalesce("_piece", F.lit("\x00"))))
    matched = lookup_join(keyed_pieces, by_piece, "_key", "_rule_key", "left", ["url"], hot_rows)
    return matched.groupBy("url").agg(
        (
            F.coalesce(F.min_by("_rule.allow", "_rule.rule_no"), F.lit(True))
            & ~F.coalesce(F.max("_closed"), F.lit(False))
        ).alias("allowed")
    )


def blocked_results(verdicts: DataFrame) -> DataFrame:
    """Fetch outcomes of URLs that robots.txt forbids."""
    return verdicts.filter(~F.col("allowed")).select(
        "url",
        F.lit(403).alias("status_code"),
        F.lit("Disallowed by robots.txt").alias("error_message"),
    )


def robots_fetch_policy(status_code: Column | str) -> Column:
    """What the fetch of robots.txt itself means: ``rules``, ``all`` or ``none`` allowed."""
    code = U._col(status_code)
    return (
        F.when(code.isin(401, 403), "none")
        .when(code.between(400, 499), "all")
        .when(code >= 500, "none")
        .when(code == 0, "all")
        .otherwise("rules")
    )


def robots_urls(lines: DataFrame) -> DataFrame:
    """URLs that robots.txt lines name: ``(host, kind, url)``.

    ``sitemap`` rows are declared sitemaps; ``path`` rows are allow and disallow
    paths other than the root and wildcards, resolved against the host.
    """
    text = strip_ws(F.col("line"))
    key = F.lower(F.substring_index(text, ":", 1))
    value = strip_ws(F.regexp_replace(text, "^[^:]*:", ""))
    keyed = lines.filter(F.contains("line", F.lit(":"))).select(
        "host",
        F.concat(F.lit("https://"), "host").alias("_base"),
        key.alias("key"),
        value.alias("value"),
    )
    sitemaps = keyed.filter((F.col("key") == "sitemap") & (F.col("value") != "")).select(
        "host", F.lit("sitemap").alias("kind"), F.col("value").alias("url")
    )
    paths = (
        keyed.filter(
            F.col("key").isin("allow", "disallow")
            & ~F.col("value").isin("", "/")
            & ~F.col("value").startswith("*")
        )
        .select(
            "host",
            F.lit("path").alias("kind"),
            "_base",
            U.url_resolve("value", "_base").alias("url"),
        )
        .filter(U.is_same_site("url", "_base"))
        .drop("_base")
    )
    return sitemaps.unionByName(paths).distinct()
