"""Link extraction: ``pages(url, html)`` to ``links(src_url, tag, raw, dst_url)``.

All of it is a narrow stage: every page yields its links from its own row, where
they are also resolved, filtered and deduplicated; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import url as U
from ..rules import COMPANY_WORDS, Rules, SEARCH_ENDPOINTS, STANDARD
from .generate import Dimensions, all_paths, on_origins, path_rows


def _found_links(pages: DataFrame, tag: str, found: Callable[[Column], Column]) -> DataFrame:
    """One row per raw link, with its absolute form."""
    staged = pages.select(
        F.col("url").alias("src_url"),
        U.url_split("url").alias("base"),
        H.strip_noise("html").alias("markup"),
    )
    return _resolved(staged, tag, found(F.col("markup")))


def _resolved(staged: DataFrame, tag: str, found: Column) -> DataFrame:
    base = F.col("base")
    rows = staged.select(
        "src_url",
        F.lit(tag).alias("tag"),
        F.explode(
            F.transform(
                found,
                lambda raw: F.struct(
                    raw.alias("raw"),
                    U.let(
                        U.let(U.url_split(raw), lambda r: U.resolve_parts(base, r)),
                        U.unsplit_parts,
                    ).alias("dst_url"),
                ),
            )
        ).alias("link"),
    )
    return rows.select("src_url", "tag", "link.raw", "link.dst_url")


def links_anchor(pages: DataFrame) -> DataFrame:
    return _found_links(pages, "a", lambda m: H.hrefs_of(m, "a"))


def links_rel(pages: DataFrame, rules: Rules = STANDARD) -> DataFrame:
    return _found_links(pages, "link", lambda m: H.rel_hrefs(m, rules.link_rels))


def links_area(pages: DataFrame) -> DataFrame:
    return _found_links(pages, "area", lambda m: H.hrefs_of(m, "area"))


def links_form(pages: DataFrame, any_method: bool = False) -> DataFrame:
    return _found_links(pages, "form", lambda m: H.form_actions(m, any_method))


def links_data_attr(pages: DataFrame) -> DataFrame:
    return _found_links(pages, "data-url", H.data_urls)


def links_data_location(pages: DataFrame) -> DataFrame:
    return _found_links(pages, "data-location", H.data_locations)


def links_pagination(pages: DataFrame) -> DataFrame:
    return _found_links(pages, "pagination", H.pagination_hrefs)


def links_pagination_top(pages: DataFrame, per_selector: int = 5) -> DataFrame:
    return _found_links(pages, "pagination", lambda m: H.pagination_top(m, per_selector))


def links_company(pages: DataFrame) -> DataFrame:
    return _found_links(pages, "company", lambda m: H.company_hrefs(m, COMPANY_WORDS))


def links_script(pages: DataFrame) -> DataFrame:
    """URLs in script text: read from the raw page, kept if of the same site."""
    staged = pages.select(
        F.col("url").alias("src_url"), U.url_split("url").alias("base"), F.col("html").alias("markup")
    )
    links = _resolved(staged, "script", H.script_urls(F.col("markup")))
    return links.filter(U.is_same_site("dst_url", "src_url"))


def _usable(value: Column, extra: tuple[str, ...] = ("all",)) -> Column:
    return ~value.isin("", "0", *extra)


def _name_has(name: Column, words: tuple[str, ...]) -> Column:
    return name.rlike("|".join(words))


def option_paths(markup: Column, variant: str) -> Column:
    """Paths that the options of location, category or type selects stand for."""

    def templates(*parts: tuple[str, str]) -> Callable[[Column], Column]:
        return lambda v: F.array(*(F.concat(F.lit(a), v, F.lit(b)) for a, b in parts))

    location_pages = templates(("/jobs-in-", ""), ("/", "-jobs"))
    nothing = F.array().cast("array<string>")

    def final(o: Column) -> Column:
        name, value = F.lower(o["name"]), H.strip_ws(o["value"])
        return (
            F.when(~_usable(value), nothing)
            .when(
                _name_has(name, ("location", "city", "area")),
                templates(("/jobs-in-", ""), ("/browse-jobs?location=", ""))(value),
            )
            .when(
                _name_has(name, ("category", "sector", "industry")),
                templates(("/", "-jobs"), ("/browse-jobs?category=", ""))(value),
            )
            .when(
                _name_has(name, ("type", "contract")),
                templates(("/", "-jobs"), ("/jobs?type=", ""))(value),
            )
            .otherwise(nothing)
        )

    def fast(o: Column) -> Column:
        name, value = F.lower(o["name"]), H.strip_ws(o["value"])
        wanted = _name_has(name, ("location", "city", "area", "region"))
        return F.when(
            wanted & _usable(value) & F.contains(value, F.lit("-")), location_pages(value)
        ).otherwise(nothing)

    def rendered(o: Column) -> Column:
        name, value = o["name"], o["value"]
        usable = _usable(value, ())
        location = F.when(
            _name_has(name, ("location", "city", "area"))
            & usable
            & F.contains(value, F.lit("-")),
            location_pages(value),
        ).otherwise(nothing)
        category = F.when(
            _name_has(name, ("category", "sector", "industry")) & usable,
            templates(("/", "-jobs"))(value),
        ).otherwise(nothing)
        return F.concat(location, category)

    rule = {"final": final, "fast": fast, "rendered": rendered}[variant]
    options = H.select_options(markup, in_forms=variant != "rendered")
    return F.flatten(F.transform(options, rule))


def links_select(pages: DataFrame, variant: str = "final") -> DataFrame:
    return _found_links(pages, "select", lambda m: option_paths(m, variant))


def search_option_urls(
    pages: DataFrame, endpoints: tuple[str, ...] = SEARCH_ENDPOINTS
) -> DataFrame:
    """``<search page>?<select name>=<option>`` for options on search pages."""
    staged = pages.filter(U.url_path("url").isin(*endpoints)).select(
        F.col("url").alias("src_url"), H.strip_noise("html").alias("markup")
    )
    options = staged.select(
        "src_url",
        F.explode(
            F.filter(
                H.select_options(F.col("markup"), in_forms=True),
                lambda o: _usable(o["value"]),
            )
        ).alias("o"),
    )
    name = F.when(F.col("o.named"), F.col("o.name")).otherwise("q")
    return options.select(
        "src_url",
        F.concat(
            "src_url", F.lit("?"), U.form_encode(name), F.lit("="), U.form_encode(F.col("o.value"))
        ).alias("dst_url"),
    ).distinct()


def _raw_links(markup: Column, rules: Rules) -> Column:
    found = [H.hrefs_of(markup, "a"), H.rel_hrefs(markup, rules.link_rels)]
    if rules.use_area:
        found.append(H.hrefs_of(markup, "area"))
    if rules.use_forms:
        found.append(H.form_actions(markup))
    if rules.use_data_location:
        found.append(H.data_locations(markup))
    if rules.use_company:
        found.append(H.company_hrefs(markup, COMPANY_WORDS))
    if rules.select_variant:
        found.append(option_paths(markup, rules.select_variant))
    return F.array_distinct(F.concat(*found))


def own_url(rules: Rules) -> Column:
    """The page's own URL in the form its links are compared with."""
    return U.url_normalize("src_url") if rules.normalization == "standard" else F.col("src_url")


def normalized_links(raws: Column, base: Column, own: Column, rules: Rules) -> Column:
    """Raw references of one page to its distinct candidate URLs.

    Kept are URLs of an own host that are not skipped and not the page itself.
    Normalisation leaves scheme and host alone, so foreign links go before it.
    """
    refs = F.transform(raws, lambda r: U.url_split(r))
    absolute = F.filter(
        F.transform(refs, lambda r: U.resolve_parts(base, r)),
        lambda u: F.lower(u.netloc).isin(*rules.hosts) & u.scheme.isin("http", "https"),
    )
    urls = F.transform(absolute, lambda u: U.normalize_parts(u, rules))
    return F.array_distinct(
        F.filter(urls, lambda u: (u != own) & ~U.should_skip_url(u, rules))
    )


def extract_links(
    pages: DataFrame, rules: Rules = STANDARD, dimensions: Dimensions | None = None
) -> DataFrame:
    """All candidate URLs of every page: ``(src_url, dst_url)``, distinct per page.

    With ``rules.generate`` the template URLs of ``dimensions`` are added once per
    origin, as links of its first page: they belong to the origin, not to a page.
    """
    staged = pages.select(
        F.col("url").alias("src_url"),
        U.url_split("url").alias("base"),
        H.strip_noise("html").alias("markup"),
    ).withColumn("own", own_url(rules))
    links = normalized_links(
        _raw_links(F.col("markup"), rules), F.col("base"), F.col("own"), rules
    )
    found = staged.select("src_url", F.explode(links).alias("dst_url"))
    if rules.generate and dimensions is not None:
        found = found.union(_generated_links(pages, rules, dimensions)).distinct()
    return found


def _generated_links(pages: DataFrame, rules: Rules, dimensions: Dimensions) -> DataFrame:
    """Template URLs on every origin that is a target, as links of its first page."""
    origins = (
        pages.select(U.url_origin("url").alias("origin"), F.col("url").alias("src_url"))
        .groupBy("origin")
        .agg(F.min("src_url").alias("src_url"))
        .filter(U.is_target_domain("src_url", rules))
        .filter(~U.should_skip_url(F.concat("origin", F.lit("/")), rules))
    )
    urls = on_origins(origins, path_rows(dimensions, all_paths, rules))
    return urls.filter(F.col("url") != own_url(rules)).select("src_url", F.col("url").alias("dst_url"))


def base_pages(pages: DataFrame) -> DataFrame:
    """Pages at the root of their origin."""
    parts = U.url_split("url")
    return pages.filter(U.let(parts, lambda u: u.path.isin("", "/") & (u.query == "")))


def homepage_links(pages: DataFrame) -> DataFrame:
    """Links of pages taken as home pages: anchors, script URLs, forms of any method and ``data-url``, same site only.

    All given pages count; ``base_pages`` picks those at the root of their origin.
    """
    staged = pages.select(
        F.col("url").alias("src_url"),
        U.url_split("url").alias("base"),
        F.col("html"),
        H.strip_noise("html").alias("markup"),
    )
    markup, base = F.col("markup"), F.col("base")
    raws = F.array_distinct(
        F.concat(
            H.raw_hrefs(markup, "a"),
            H.script_urls(F.col("html")),
            H.form_actions(markup, any_method=True),
            H.data_url_only(markup),
        )
    )
    refs = F.transform(raws, lambda r: U.url_split(r))
    urls = F.transform(
        F.transform(refs, lambda r: U.resolve_parts(base, r)), lambda u: U.unsplit_parts(u)
    )
    kept = F.array_distinct(F.filter(urls, lambda u: U.is_same_site(u, F.col("src_url"))))
    return staged.select("src_url", F.explode(kept).alias("dst_url"))


def page_metadata(pages: DataFrame) -> DataFrame:
    staged = pages.select("page_id", "url", H.strip_noise("html").alias("markup"))
    m = F.col("markup")
    return staged.select(
        "page_id",
        "url",
        H.page_title(m).alias("title"),
        H.first_meta(m, "description").alias("description"),
        H.page_canonical(m).alias("canonical"),
        H.page_language(m).alias("language"),
        H.first_meta(m, "last-modified").alias("last_modified"),
    )


def page_text(pages: DataFrame) -> DataFrame:
    staged = pages.select("page_id", "url", H.strip_noise("html").alias("markup"))
    return staged.select("page_id", "url", H.page_text(F.col("markup")).alias("content"))


def link_density(pages: DataFrame) -> DataFrame:
    """Anchors per KB of page; pages under one KB count as one KB."""
    staged = pages.select(
        "page_id", "url", F.length("html").alias("chars"), H.strip_noise("html").alias("markup")
    )
    return staged.select(
        "page_id",
        "url",
        (
            H.link_count(F.col("markup")) / F.greatest(F.col("chars") / 1024.0, F.lit(1.0))
        ).alias("link_density"),
    )


def links_per_page(pages: DataFrame, rules: Rules = STANDARD) -> DataFrame:
    """``(src_url, discovered_urls)``: the distinct candidate URLs of each page."""
    staged = pages.select(
        F.col("url").alias("src_url"),
        U.url_split("url").alias("base"),
        H.strip_noise("html").alias("markup"),
    ).withColumn("own", own_url(rules))
    links = normalized_links(
        _raw_links(F.col("markup"), rules), F.col("base"), F.col("own"), rules
    )
    return staged.select("src_url", links.alias("discovered_urls"))


def unique_links_per_page(pages: DataFrame, rules: Rules = STANDARD) -> DataFrame:
    """Number of distinct candidate URLs per page, pages without any included."""
    found = links_per_page(pages, rules)
    return found.select("src_url", F.size("discovered_urls").alias("unique_urls_found"))

