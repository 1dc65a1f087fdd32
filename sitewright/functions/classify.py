"""Classes, priorities and small crawl-log derivations as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import JOB_RELATED, Rules, STANDARD, URL_TYPE_CHANGEFREQ, URL_TYPE_PRIORITY
from .html import strip_ws
from .url import _col, is_dynamic_url, let, matches_any, query_pairs, url_split


def _rtrim_slash(c: Column) -> Column:
    return F.regexp_replace(c, "/+$", "")


def classify_url_type(url: Column | str, rules: Rules = STANDARD) -> Column:
    """Page type by ordered rules; the first that fits decides."""
    low = F.lower(_col(url))
    homes = [b.rstrip("/") for b in rules.base_urls]
    return (
        F.when(_rtrim_slash(low).isin(*homes), "homepage")
        .when(low.rlike(r"/jobs/[0-9]"), "individual_job")
        .when(low.contains("/jobs") & low.contains("jobs-in-"), "location_page")
        .when(low.contains("/jobs"), "job_listing")
        .when(low.rlike("/company|/companies"), "company_page")
        .when(low.rlike("/blog|/news|/article"), "blog_post")
        .when(low.rlike("/category|/sector|/industry"), "main_category")
        .otherwise("default")
    )


def _lookup(mapping: dict, key: Column) -> Column:
    table = F.create_map(*(F.lit(x) for x in chain.from_iterable(mapping.items())))
    return F.coalesce(F.try_element_at(table, key), F.lit(mapping["default"]))


def url_priority(url: Column | str, rules: Rules = STANDARD) -> Column:
    return _lookup(URL_TYPE_PRIORITY, classify_url_type(url, rules))


def url_changefreq(url: Column | str, rules: Rules = STANDARD) -> Column:
    return _lookup(URL_TYPE_CHANGEFREQ, classify_url_type(url, rules))


def is_job_related(url: Column | str) -> Column:
    return matches_any(url, JOB_RELATED)


def is_browse_jobs(url: Column | str) -> Column:
    return F.lower(_col(url)).contains("browse-jobs")


def url_priority_final(url: Column | str, base_url: str) -> Column:
    return (
        F.when(_rtrim_slash(_col(url)) == base_url.rstrip("/"), 1.0)
        .when(is_browse_jobs(url), 0.9)
        .when(is_job_related(url), 0.8)
        .otherwise(0.5)
    )


def url_changefreq_final(url: Column | str) -> Column:
    return F.when(is_job_related(url), "daily").otherwise("weekly")


def url_priority_fast(url: Column | str, rules: Rules) -> Column:
    return F.when(is_dynamic_url(url, rules), 0.8).otherwise(0.5)


def url_pattern(url: Column | str) -> Column:
    """Signature shared by pages that are likely near-duplicates."""
    url = _col(url)

    def signature(u: Column) -> Column:
        # Blank values do not count as present.
        keys = F.transform(F.filter(query_pairs(u.query), lambda p: p.v != ""), lambda p: p.k)
        category = F.array_contains(keys, "category")
        location = F.array_contains(keys, "location")
        return (
            F.when(
                is_browse_jobs(url),
                F.when(category & location, "browse-jobs-category-location")
                .when(category, "browse-jobs-category")
                .when(location, "browse-jobs-location")
                .otherwise("browse-jobs-base"),
            )
            # Parameters of the last segment are no part of the path.
            .otherwise(F.regexp_replace(u.path, ";[^/]*$", ""))
        )

    return let(url_split(url), signature)


def frontier_priority(parent_depth: Column | str) -> Column:
    """Priority of a URL found on a page of the given depth."""
    return F.greatest(F.lit(0), F.lit(100) - _col(parent_depth) * 10).cast("int")


def crawl_status(status_code: Column | str, error_message: Column | str) -> Column:
    code, error = _col(status_code), F.coalesce(_col(error_message), F.lit(""))
    return F.when((code >= 200) & (code < 400) & (error == ""), "success").otherwise("error")


def content_type_main(content_type: Column | str) -> Column:
    """Media type without parameters; nothing given is ``unknown``."""
    raw = F.coalesce(_col(content_type), F.lit(""))
    main = strip_ws(F.substring_index(raw, ";", 1))
    return F.when(raw == "", "unknown").otherwise(F.lower(main))


def is_html(content_type: Column | str) -> Column:
    return content_type_main(content_type).isin("text/html", "application/xhtml+xml")


def is_html_final(content_type: Column | str) -> Column:
    return F.coalesce(_col(content_type), F.lit("")).contains("text/html")


def iso_lastmod(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def success_rate(success: Column, crawled: Column) -> Column:
    """Successes in percent of what was crawled; 0 when nothing was."""
    return F.when(crawled > 0, success / crawled * 100).otherwise(F.lit(0.0))


def coverage_rate(crawled: Column, discovered: Column) -> Column:
    """Crawled in percent of discovered, failures included."""
    return crawled / F.greatest(discovered, F.lit(1)) * 100
