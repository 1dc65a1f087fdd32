"""Markup column functions: documented regex rules over HTML text.

These are not an HTML5 parser, but tags and attributes are read as one does: a tag
ends at the first ``>`` outside a quoted value, attributes are taken from left to
right, and the first of a name counts. Containers are found in the token tree (``tree``). Comments, ``<script>`` and ``<style>`` are
dropped first. Quantifiers are possessive, so that no page is scanned again and again.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import PAGINATION_WORDS, SCRIPT_URL_PATTERNS
from .tree import INSIDE, contents, start_tags, tokens
from .url import _col, let

NOISE = r"(?is)<(?:!--.*?-->|script\b.*?</script\s*>|style\b.*?</style\s*>)"
# What counts as white space at the ends of a text.
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
NON_LINK_PREFIXES = ("#", "javascript:", "mailto:", "tel:")
ENTITY = r"&(?:#[0-9]{1,12}|#[xX][0-9a-fA-F]{1,10}|[A-Za-z][A-Za-z0-9]{1,31});"
#: Every named entity of HTML with its characters, as one text for ``str_to_map``.
NAMED = "\x01".join(f"&{name}\x02{chars}" for name, chars in sorted(html5.items()) if name.endswith(";"))
#: One attribute: name, and value if there is one.
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>]*+)"""


def strip_noise(html: Column | str) -> Column:
    return F.regexp_replace(_col(html), NOISE, " ")


def strip_ws(text: Column) -> Column:
    return F.trim(text, F.lit(WHITE_SPACE))


def _character(entity: Column) -> Column:
    """Character of a numeric entity."""
    hexed = F.regexp_extract(entity, r"^&#[xX]0*+([0-9a-fA-F]*);", 1)
    plain = F.regexp_extract(entity, r"^&#0*+([0-9]*);", 1)
    number = F.when(entity.rlike("^&#[xX]"), F.when(F.length(hexed) <= 6, F.conv(hexed, 16, 10))).otherwise(
        F.when(F.length(plain) <= 7, plain)
    )
    return let(
        F.try_to_number(number, F.lit("99999999")).cast("int"),
        lambda n: F.when(
            n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF),
            F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"),
        ).otherwise(F.lit("\ufffd")),
    )


def unescape(text: Column) -> Column:
    """Decode numeric and all named entities, each once; unknown names stay as they are."""
    named = F.str_to_map(F.lit(NAMED), F.lit("\x01"), F.lit("\x02"))

    def decoded(t: Column) -> Column:
        pieces = F.split(t, ENTITY, -1)
        chars = F.transform(
            F.regexp_extract_all(t, F.lit(ENTITY), F.lit(0)),
            lambda e: F.when(e.startswith("&#"), _character(e)).otherwise(
                F.coalesce(F.element_at(named, e), e)
            ),
        )
        ends = F.concat(chars, F.array(F.lit("")))
        return F.array_join(F.zip_with(pieces, ends, lambda p, c: F.concat(p, c)), "")

    return let(text, lambda t: F.when(t.rlike(ENTITY), decoded(t)).otherwise(t))


def _up_to(name: str) -> str:
    """A tag from its start up to and with the first attribute of the name."""
    other = rf"[\s/]*+(?!{name}[\s=/>])[^\s=/>]++(?:\s*+=\s*+{_VALUE})?+"
    return rf"(?is)^<[a-z][^\s/>]*+(?:{other})*+[\s/]*+{name}\s*+="


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of one tag, entities decoded; empty if absent."""
    raw = F.regexp_extract(tag, _up_to(name) + rf"\s*+({_VALUE})", 1)

    def unquoted(v: Column) -> Column:
        quoted = v.startswith('"') | v.startswith("'")
        return F.when(quoted, F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)

    return unescape(let(raw, unquoted))


def has_attribute(tag: Column, name: str) -> Column:
    return tag.rlike(_up_to(name))


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def tags(markup: Column, name: str) -> Column:
    return find_all(markup, rf"(?is)<{name}(?=[\s/]){INSIDE}>")


def tags_with(markup: Column, *names: str) -> Column:
    """Tags of any element that have one of the attributes."""
    likely = "(?i)" + "|".join(names)

    def has_one(t: Column) -> Column:
        has = F.lit(False)
        for name in names:
            has = has | has_attribute(t, name)
        return t.rlike(likely) & has

    return F.filter(find_all(markup, rf"(?is)<[a-z]{INSIDE}>"), has_one)


def elements(markup: Column, name: str) -> Column:
    """Whole elements, up to the first closing tag of that name."""
    return find_all(markup, rf"(?is)<{name}(?=[\s/>]){INSIDE}>.*?</{name}\s*>")


def is_link_text(href: Column) -> Column:
    ok = href != ""
    for prefix in NON_LINK_PREFIXES:
        ok = ok & ~href.startswith(prefix)
    return ok


def _attributes(found: Column, name: str) -> Column:
    return F.transform(found, lambda t: attribute(t, name))


def _stripped(found: Column, name: str) -> Column:
    return F.transform(found, lambda t: strip_ws(attribute(t, name)))


def hrefs_of(markup: Column, tag: str) -> Column:
    """Trimmed ``href`` values that lead somewhere."""
    return F.filter(_stripped(tags(markup, tag), "href"), is_link_text)


def raw_hrefs(markup: Column, tag: str) -> Column:
    """``href`` values as written, empty ones dropped."""
    return F.filter(_attributes(tags(markup, tag), "href"), lambda h: h != "")


def rel_hrefs(markup: Column, rels: tuple[str, ...]) -> Column:
    """``<link href>`` whose ``rel`` holds one of the given tokens."""
    wanted = F.array(*(F.lit(r) for r in rels))
    kept = F.filter(
        tags(markup, "link"),
        lambda t: F.arrays_overlap(F.split(strip_ws(attribute(t, "rel")), r"\s+"), wanted),
    )
    return F.filter(_stripped(kept, "href"), lambda h: h != "")


def form_actions(markup: Column, any_method: bool = False) -> Column:
    """``<form action>`` of GET forms (GET being the default), or of all forms."""
    forms = tags(markup, "form")
    if any_method:
        return F.filter(_attributes(forms, "action"), lambda a: a != "")
    get_forms = F.filter(
        forms,
        lambda t: ~has_attribute(t, "method") | (F.lower(attribute(t, "method")) == "get"),
    )
    return F.filter(_stripped(get_forms, "action"), lambda a: a != "")


def data_urls(markup: Column) -> Column:
    """First non-empty of ``data-url``, ``data-href``, ``data-link`` per element."""
    found = tags_with(markup, "data-url", "data-href", "data-link")

    def first(t: Column) -> Column:
        return F.coalesce(
            F.nullif(attribute(t, "data-url"), F.lit("")),
            F.nullif(attribute(t, "data-href"), F.lit("")),
            attribute(t, "data-link"),
        )

    return F.filter(F.transform(found, first), lambda u: u != "")


def data_url_only(markup: Column) -> Column:
    found = tags_with(markup, "data-url")
    return F.filter(_attributes(found, "data-url"), lambda u: u != "")


def data_locations(markup: Column) -> Column:
    """``data-location`` values as location page paths."""
    found = tags_with(markup, "data-location")
    values = F.filter(_stripped(found, "data-location"), lambda v: v != "")
    return F.transform(values, lambda v: F.concat(F.lit("/jobs-in-"), v))


def script_urls(html: Column) -> Column:
    """URL-like string literals of the raw page, scripts included."""
    found = F.array_distinct(
        F.concat(*(find_all(html, p, 1) for p in SCRIPT_URL_PATTERNS))
    )
    return F.filter(found, lambda u: u.startswith("http") | u.startswith("/"))


def _has_token(tag: Column, name: str, *words: str) -> Column:
    """Whether an attribute of white-space separated words holds one of them."""
    wanted = F.array(*(F.lit(w) for w in words))
    return tag.rlike("|".join(words)) & F.arrays_overlap(F.split(attribute(tag, name), r"\s+"), wanted)


def _anchors_in(page: Column, css_class: str) -> Column:
    """Anchors inside elements of the class, wherever these end."""
    inside = F.flatten(contents(page, lambda t: _has_token(t, "class", css_class)))
    likely = F.exists(page, lambda t: F.contains(t, F.lit(css_class)))
    return start_tags(F.when(likely, inside).otherwise(F.array().cast("array<string>")), "a")


def _rel_next_anchors(page: Column) -> Column:
    return F.filter(start_tags(page, "a"), lambda t: F.contains(t, F.lit("next")) & (attribute(t, "rel") == "next"))


def pagination_hrefs(markup: Column) -> Column:
    """Hrefs under pagination selectors, and of anchors that read like page links."""

    def selected(page: Column) -> Column:
        return F.concat(
            _anchors_in(page, "pagination"),
            _anchors_in(page, "pager"),
            _rel_next_anchors(page),
            F.filter(start_tags(page), lambda t: _has_token(t, "class", "next-page")),
            F.filter(start_tags(page), lambda t: t.rlike("(?i)data-page") & has_attribute(t, "data-page")),
        )

    numbered = F.transform(
        F.filter(elements(markup, "a"), lambda e: _reads_like_page_link(inner_text(e))),
        lambda e: F.regexp_extract(e, rf"(?is)^<a{INSIDE}>", 0),
    )
    return F.array_distinct(
        F.filter(_attributes(F.concat(let(tokens(markup), selected), numbered), "href"), lambda h: h != "")
    )


def _reads_like_page_link(text: Column) -> Column:
    return text.rlike(r"^[0-9]+$") | F.lower(text).isin(*PAGINATION_WORDS)


def pagination_top(markup: Column, per_selector: int = 5) -> Column:
    """Hrefs of the first few elements under each pagination selector."""

    def first(found: Column) -> Column:
        return F.filter(
            _attributes(F.slice(found, 1, per_selector), "href"), lambda h: h != ""
        )

    def selected(page: Column) -> Column:
        return F.concat(
            first(_anchors_in(page, "pagination")),
            first(_anchors_in(page, "pager")),
            first(_rel_next_anchors(page)),
        )

    return F.array_distinct(let(tokens(markup), selected))


def inner_text(element: Column) -> Column:
    return strip_ws(unescape(F.regexp_replace(element, rf"(?s)<{INSIDE}>", "")))


def company_hrefs(markup: Column, words: str) -> Column:
    """Hrefs of company anchors whose own text holds one of the words."""

    def own_text(e: Column) -> Column:
        inner = F.regexp_replace(e, rf"(?is)^<a{INSIDE}>|</a\s*>$", "")
        return unescape(F.regexp_replace(inner, r"(?is)<[a-z][^>]*>.*?</[^>]*>", ""))

    hrefs = F.transform(
        F.filter(elements(markup, "a"), lambda e: own_text(e).rlike(words)),
        lambda e: attribute(F.regexp_extract(e, rf"(?is)^<a{INSIDE}>", 0), "href"),
    )
    return F.filter(
        hrefs, lambda h: F.contains(h, F.lit("/company/")) | F.contains(h, F.lit("/employer/"))
    )


def select_options(markup: Column, in_forms: bool) -> Column:
    """``array<struct<name, has_name, value>>`` of the options of every select."""
    selects = (
        F.flatten(F.transform(elements(markup, "form"), lambda f: elements(f, "select")))
        if in_forms
        else elements(markup, "select")
    )

    def options(select: Column) -> Column:
        head = F.regexp_extract(select, rf"(?is)^<select{INSIDE}>", 0)
        return let(
            F.struct(
                attribute(head, "name").alias("name"), has_attribute(head, "name").alias("named")
            ),
            lambda s: F.transform(
                F.filter(tags(select, "option"), lambda t: has_attribute(t, "value")),
                lambda t: F.struct(
                    s["name"].alias("name"), s.named.alias("named"), attribute(t, "value").alias("value")
                ),
            ),
        )

    return F.flatten(F.transform(selects, options))


def first_meta(markup: Column, name: str) -> Column:
    found = F.filter(tags(markup, "meta"), lambda t: attribute(t, "name") == name)
    return F.coalesce(F.get(_attributes(found, "content"), F.lit(0)), F.lit(""))


def page_title(markup: Column) -> Column:
    return strip_ws(unescape(F.regexp_extract(markup, r"(?is)<title[^>]*>(.*?)</title", 1)))


def page_language(markup: Column) -> Column:
    return attribute(F.regexp_extract(markup, rf"(?is)<html(?=[\s/>]){INSIDE}>", 0), "lang")


def page_canonical(markup: Column) -> Column:
    found = F.filter(
        tags(markup, "link"),
        lambda t: F.array_contains(F.split(strip_ws(attribute(t, "rel")), r"\s+"), "canonical"),
    )
    return F.coalesce(F.get(_attributes(found, "href"), F.lit(0)), F.lit(""))


def _is_main(tag: Column) -> Column:
    return tag.rlike(r"(?i)^<main[\s/>]") | (
        F.contains(tag, F.lit("main")) | F.contains(tag, F.lit("content"))
    ) & (_has_token(tag, "class", "main", "content") | attribute(tag, "id").isin("main", "content"))


def page_text(markup: Column) -> Column:
    """Text of the first main-content element, whole, else of the body."""
    body = F.regexp_extract(markup, rf"(?is)<body(?=[\s/>]){INSIDE}>(.*?)(?:</body\s*>|\z)", 1)
    main = let(tokens(markup), lambda page: F.get(contents(page, _is_main), F.lit(0)))
    return inner_text(let(main, lambda m: F.when(m.isNotNull(), F.array_join(m, "")).otherwise(body)))


def link_count(markup: Column) -> Column:
    return F.size(F.filter(tags(markup, "a"), lambda t: has_attribute(t, "href")))


def clean_text(text: Column | str) -> Column:
    """White space runs to one blank, ends trimmed, control characters deleted."""
    text = _col(text)
    spaced = F.regexp_replace(strip_ws(text), r"(?U)\s+", " ")
    return F.coalesce(F.regexp_replace(spaced, r"[\x00-\x1f\x7f-\x9f]", ""), F.lit(""))
