"""DuckDB SQL that gives the rows each query must return."""

from __future__ import annotations

from .. import rules as R
from ..rules import FAST, FINAL, STANDARD
from ..sources import sitemap_files as X
from .derived import CONTAINED, MAIN_TEXT, duckdb_with
from .queries import BASE, NOW, PER_FILE

NOW_ISO = NOW.replace(" ", "T") + "+00:00"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def let(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


URL_RE = q(
    r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
)


def parts(url: str) -> str:
    return f"regexp_extract(ltrim({url}), {URL_RE}, ['scheme', 'netloc', 'path', 'query', 'fragment'])"


def unsplit(scheme: str, netloc: str, path: str, query: str, fragment: str) -> str:
    return (
        f"(CASE WHEN {scheme} <> '' THEN lower({scheme}) || ':' ELSE '' END "
        f"|| CASE WHEN {netloc} <> '' THEN '//' || {netloc} ELSE '' END || {path} "
        f"|| CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END "
        f"|| CASE WHEN {fragment} <> '' THEN '#' || {fragment} ELSE '' END)"
    )


def fold(path: str) -> str:
    steps = (
        "list_reduce(list_transform(s, lambda e: [e]), lambda a, e: CASE WHEN e[1] = '..' "
        "THEN list_slice(a, 1, len(a) - 1) WHEN e[1] = '.' THEN a ELSE list_concat(a, e) END, "
        "CAST([] AS VARCHAR[]))"
    )
    body = (
        f"array_to_string(list_concat({steps}, CASE WHEN s[len(s)] IN ('.', '..') THEN [''] "
        "ELSE CAST([] AS VARCHAR[]) END), '/')"
    )
    folded = let(f"string_split({path}, '/')", "s", body)
    return let(
        folded, "f", "CASE WHEN starts_with(f, '/') THEN f ELSE '/' || f END"
    )


def resolve(ref: str, base: str) -> str:
    merged = (
        "CASE WHEN starts_with(x.r.path, '/') THEN x.r.path ELSE regexp_replace("
        "CASE WHEN x.b.path = '' THEN '/' ELSE regexp_replace(x.b.path, '[^/]*$', '') END "
        "|| x.r.path, '/{2,}', '/', 'g') END"
    )
    body = (
        "CASE WHEN x.r.scheme <> '' AND lower(x.r.scheme) <> lower(x.b.scheme) THEN "
        + ref
        + " WHEN x.r.netloc <> '' THEN "
        + unsplit("x.b.scheme", "x.r.netloc", "x.r.path", "x.r.query", "x.r.fragment")
        + " WHEN x.r.path = '' THEN "
        + unsplit(
            "x.b.scheme", "x.b.netloc", "x.b.path",
            "(CASE WHEN x.r.query = '' THEN x.b.query ELSE x.r.query END)", "x.r.fragment",
        )
        + " ELSE "
        + unsplit("x.b.scheme", "x.b.netloc", fold(merged), "x.r.query", "x.r.fragment")
        + " END"
    )
    return let(f"struct_pack(b := {parts(base)}, r := {parts(ref)})", "x", body)


def decode(x: str) -> str:
    return f"url_decode(replace({x}, '+', ' '))"


def encode(x: str) -> str:
    return f"replace(url_encode({x}), '%20', '+')"


def norm(url: str) -> str:
    pieces = "list_filter(string_split(u.query, '&'), lambda p: p <> '')"
    pairs = (
        f"list_sort(list_transform({pieces}, lambda p, i: struct_pack(k := {decode('split_part(p, chr(61), 1)')}, "
        f"i := i, v := CASE WHEN contains(p, '=') THEN {decode('substr(p, instr(p, chr(61)) + 1)')} ELSE '' END)))"
    )
    query = (
        f"array_to_string(list_transform({pairs}, lambda p: {encode('p.k')} || '=' || {encode('p.v')}), '&')"
    )
    path = "(CASE WHEN u.path = '/' THEN '/' ELSE rtrim(u.path, '/') END)"
    body = unsplit("u.scheme", "u.netloc", path, "n", "''")
    inner = let(f"CASE WHEN u.query = '' THEN '' ELSE {query} END", "n", body)
    return let(parts(url), "u", inner)


def norm_fast(url: str) -> str:
    path = r"regexp_replace(u.path, ';[^/]*$', '')"
    full = (
        f"lower(u.scheme) || '://' || u.netloc || {path} "
        "|| CASE WHEN u.query <> '' THEN '?' || u.query ELSE '' END"
    )
    body = let(
        full, "f", f"CASE WHEN ends_with(f, '/') AND length({path}) > 1 THEN rtrim(f, '/') ELSE f END"
    )
    return let(parts(url), "u", body)


def any_of(url: str, patterns) -> str:
    return f"regexp_matches({url}, {q('(?i)' + '|'.join(f'(?:{p})' for p in patterns))})"


def domain(url: str) -> str:
    return f"lower(regexp_extract({url}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1))"


def in_list(x: str, values) -> str:
    return f"{x} IN ({', '.join(q(v) for v in values)})"


def target(url: str, rules) -> str:
    return in_list(domain(url), rules.hosts)


def valid(url: str) -> str:
    return f"regexp_matches({url}, '^(?i:https?)://[^/?#]')"


def same_site(url: str, base: str) -> str:
    blocked = "|".join(e.replace(".", r"\.") for e in R.SAME_SITE_BLOCKED)
    return (
        f"({domain(url)} IN ({domain(base)}, 'www.' || {domain(base)}, "
        f"replace({domain(base)}, 'www.', '')) AND regexp_matches({url}, '^(?i:https?):') "
        f"AND NOT regexp_matches({url}, '(?i)({blocked})$'))"
    )


def ws(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S+00:00')"


def classify(url: str) -> str:
    homes = [b.rstrip("/") for b in STANDARD.base_urls]
    low = f"lower({url})"
    return (
        f"CASE WHEN {in_list(f'rtrim({low}, chr(47))', homes)} THEN 'homepage' "
        f"WHEN contains({low}, '/jobs') THEN CASE WHEN regexp_matches({low}, '/jobs/[0-9]+') "
        f"THEN 'individual_job' WHEN contains({low}, 'jobs-in-') THEN 'location_page' "
        f"ELSE 'job_listing' END "
        f"WHEN contains({low}, '/company') OR contains({low}, '/companies') THEN 'company_page' "
        f"WHEN contains({low}, '/blog') OR contains({low}, '/news') OR contains({low}, '/article') THEN 'blog_post' "
        f"WHEN contains({low}, '/category') OR contains({low}, '/sector') OR contains({low}, '/industry') "
        f"THEN 'main_category' ELSE 'default' END"
    )


def mapped(url: str, table: dict) -> str:
    whens = " ".join(
        f"WHEN '{k}' THEN " + (f"CAST({v} AS DOUBLE)" if isinstance(v, float) else f"'{v}'")
        for k, v in table.items()
    )
    return f"CASE {classify(url)} {whens} END"


def priority(url: str) -> str:
    return mapped(url, R.URL_TYPE_PRIORITY)


def changefreq(url: str) -> str:
    return mapped(url, R.URL_TYPE_CHANGEFREQ)


def job_related(url: str) -> str:
    return any_of(url, R.JOB_RELATED)


def priority_final(url: str) -> str:
    return (
        f"CAST(CASE WHEN rtrim({url}, '/') = '{BASE}' THEN 1.0 WHEN contains(lower({url}), 'browse-jobs') "
        f"THEN 0.9 WHEN {job_related(url)} THEN 0.8 ELSE 0.5 END AS DOUBLE)"
    )


def changefreq_final(url: str) -> str:
    return f"CASE WHEN {job_related(url)} THEN 'daily' ELSE 'weekly' END"


def pattern(url: str) -> str:
    def has(key: str) -> str:
        return f"regexp_matches({url}, '[?&]{key}=[^&#]')"

    return (
        f"CASE WHEN contains(lower({url}), 'browse-jobs') THEN CASE "
        f"WHEN {has('category')} AND {has('location')} THEN 'browse-jobs-category-location' "
        f"WHEN {has('category')} THEN 'browse-jobs-category' "
        f"WHEN {has('location')} THEN 'browse-jobs-location' ELSE 'browse-jobs-base' END "
        f"ELSE {parts(url)}.path END"
    )


def status(code: str, error: str) -> str:
    return (
        f"CASE WHEN {code} >= 200 AND {code} < 400 AND coalesce({error}, '') = '' "
        "THEN 'success' ELSE 'error' END"
    )


def main_type(c: str) -> str:
    return f"CASE WHEN coalesce({c}, '') = '' THEN 'unknown' ELSE lower({ws(f'split_part({c}, chr(59), 1)')}) END"


def html_type(c: str) -> str:
    return f"({main_type(c)}) IN ('text/html', 'application/xhtml+xml')"


# --- Markup -------------------------------------------------------------------

NOISE = q(r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>")


def stripped(html: str = "html") -> str:
    return f"regexp_replace({html}, {NOISE}, ' ', 'g')"


def unescape(x: str) -> str:
    for entity, char in (
        ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
        ("&nbsp;", "\xa0"), ("&copy;", "\xa9"), ("&middot;", "\xb7"), ("&amp;", "&"),
    ):
        x = f"replace({x}, {q(entity)}, {q(char)})"
    return x


def attr(tag: str, name: str) -> str:
    found = f"""regexp_extract({tag}, {q(r'(?is)\s' + name + r'''\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)''')}, 1)"""
    return unescape(f"""regexp_replace({found}, {q('''^["']|["']$''')}, '', 'g')""")


def has_attr(tag: str, name: str) -> str:
    return rf"regexp_matches({tag}, '(?is)\s{name}\s*=')"


def tags(m: str, name: str) -> str:
    return rf"regexp_extract_all({m}, '(?is)<{name}\s[^>]*>')"


def elements(m: str, name: str) -> str:
    return rf"regexp_extract_all({m}, '(?is)<{name}\b[^>]*>.*?</{name}\s*>')"


def each(found: str, body: str, keep: str = "v <> ''", var: str = "t") -> str:
    return f"list_filter(list_transform({found}, lambda {var}: {body}), lambda v: {keep})"


LINKISH = (
    "v <> '' AND NOT starts_with(v, '#') AND NOT starts_with(v, 'javascript:') "
    "AND NOT starts_with(v, 'mailto:') AND NOT starts_with(v, 'tel:')"
)


def hrefs(m: str, tag: str) -> str:
    return each(tags(m, tag), ws(attr("t", "href")), LINKISH)


def rel_hrefs(m: str, rels) -> str:
    wanted = "[" + ", ".join(q(r) for r in rels) + "]"
    kept = (
        f"list_filter({tags(m, 'link')}, lambda t: list_has_any("
        rf"regexp_split_to_array({ws(attr('t', 'rel'))}, '\s+'), {wanted}))"
    )
    return each(kept, ws(attr("t", "href")))


def form_actions(m: str, any_method: bool = False) -> str:
    if any_method:
        return each(tags(m, "form"), attr("t", "action"))
    gets = (
        f"list_filter({tags(m, 'form')}, lambda t: NOT {has_attr('t', 'method')} "
        f"OR lower({attr('t', 'method')}) = 'get')"
    )
    return each(gets, ws(attr("t", "action")))


def data_urls(m: str) -> str:
    found = rf"regexp_extract_all({m}, '(?is)<[a-z][^>]*\sdata-(?:url|href|link)\s*=[^>]*>')"
    return each(
        found,
        f"coalesce(nullif({attr('t', 'data-url')}, ''), nullif({attr('t', 'data-href')}, ''), {attr('t', 'data-link')})",
    )


def data_url_only(m: str) -> str:
    return each(
        rf"regexp_extract_all({m}, '(?is)<[a-z][^>]*\sdata-url\s*=[^>]*>')", attr("t", "data-url")
    )


def data_locations(m: str) -> str:
    found = rf"regexp_extract_all({m}, '(?is)<[a-z][^>]*\sdata-location\s*=[^>]*>')"
    return f"list_transform({each(found, ws(attr('t', 'data-location')))}, lambda w: '/jobs-in-' || w)"


def script_urls(html: str) -> str:
    found = ", ".join(
        f"regexp_extract_all({html}, {q(p)}, 1)" for p in R.SCRIPT_URL_PATTERNS
    )
    return (
        f"list_filter(list_distinct(flatten([{found}])), "
        "lambda v: starts_with(v, 'http') OR starts_with(v, '/'))"
    )


def rel_next(m: str) -> str:
    return f"list_filter({tags(m, 'a')}, lambda t: {attr('t', 'rel')} = 'next')"


def inner_text(e: str) -> str:
    return ws(unescape(f"regexp_replace({e}, '(?s)<[^>]*>', '', 'g')"))


NO_ANCHORS = {"pagination": "[]", "pager": "[]"}


def pagination(m: str, contained: dict[str, str] = CONTAINED) -> str:
    words = ", ".join(q(w) for w in R.PAGINATION_WORDS)
    next_page = (
        rf"list_filter(regexp_extract_all({m}, '(?is)<[a-z][^>]*\sclass\s*=[^>]*>'), "
        rf"lambda t: list_contains(regexp_split_to_array({attr('t', 'class')}, '\s+'), 'next-page'))"
    )
    data_page = rf"regexp_extract_all({m}, '(?is)<[a-z][^>]*\sdata-page\s*=[^>]*>')"
    numbered = (
        rf"list_transform(list_filter({elements(m, 'a')}, lambda e: regexp_matches({inner_text('e')}, '^[0-9]+$') "
        rf"OR lower({inner_text('e')}) IN ({words})), lambda e: regexp_extract(e, '(?is)^<a\b[^>]*>'))"
    )
    found = (
        f"flatten([{contained['pagination']}, {contained['pager']}, {rel_next(m)}, "
        f"{next_page}, {data_page}, {numbered}])"
    )
    return f"list_distinct({each(found, attr('t', 'href'))})"


def pagination_top(m: str) -> str:
    found = ", ".join(
        f"list_slice({x}, 1, 5)"
        for x in (*CONTAINED.values(), rel_next(m))
    )
    return f"list_distinct({each(f'flatten([{found}])', attr('t', 'href'))})"


def company(m: str) -> str:
    own = unescape(
        r"regexp_replace(regexp_replace(e, '(?is)^<a\b[^>]*>|</a\s*>$', '', 'g'), "
        r"'(?is)<[a-z][^>]*>.*?</[^>]*>', '', 'g')"
    )
    kept = f"list_filter({elements(m, 'a')}, lambda e: regexp_matches({own}, {q(R.COMPANY_WORDS)}))"
    return each(
        kept,
        attr(r"regexp_extract(e, '(?is)^<a\b[^>]*>')", "href"),
        "contains(v, '/company/') OR contains(v, '/employer/')",
        "e",
    )


def options(m: str, in_forms: bool) -> str:
    selects = (
        f"flatten(list_transform({elements(m, 'form')}, lambda f: {elements('f', 'select')}))"
        if in_forms
        else elements(m, "select")
    )
    head = r"regexp_extract(s, '(?is)^<select\b[^>]*>')"
    return (
        f"flatten(list_transform({selects}, lambda s: list_transform(list_filter({tags('s', 'option')}, "
        f"lambda t: {has_attr('t', 'value')}), lambda t: struct_pack(name := {attr(head, 'name')}, "
        f"named := {has_attr(head, 'name')}, value := {attr('t', 'value')}))))"
    )


def option_paths(m: str, variant: str) -> str:
    none = "CAST([] AS VARCHAR[])"

    def named(words: str) -> str:
        return f"regexp_matches(lower(o.name), '{words}')"

    v = ws("o.value")
    if variant == "final":
        rule = (
            f"CASE WHEN {v} IN ('', '0', 'all') THEN {none} "
            f"WHEN {named('location|city|area')} THEN ['/jobs-in-' || {v}, '/browse-jobs?location=' || {v}] "
            f"WHEN {named('category|sector|industry')} THEN ['/' || {v} || '-jobs', '/browse-jobs?category=' || {v}] "
            f"WHEN {named('type|contract')} THEN ['/' || {v} || '-jobs', '/jobs?type=' || {v}] ELSE {none} END"
        )
    elif variant == "fast":
        rule = (
            f"CASE WHEN {named('location|city|area|region')} AND {v} NOT IN ('', '0', 'all') AND contains({v}, '-') "
            f"THEN ['/jobs-in-' || {v}, '/' || {v} || '-jobs'] ELSE {none} END"
        )
    else:
        rule = (
            f"list_concat(CASE WHEN {named('location|city|area')} AND o.value NOT IN ('', '0') AND contains(o.value, '-') "
            f"THEN ['/jobs-in-' || o.value, '/' || o.value || '-jobs'] ELSE {none} END, "
            f"CASE WHEN {named('category|sector|industry')} AND o.value NOT IN ('', '0') "
            f"THEN ['/' || o.value || '-jobs'] ELSE {none} END)"
        )
    return f"flatten(list_transform({options(m, variant != 'rendered')}, lambda o: {rule}))"


def pages_cte(*more: str) -> str:
    return (
        f"WITH {duckdb_with('site_pages', *more)}, "
        f"m AS (SELECT page_id, url AS src_url, html, {stripped()} AS markup FROM site_pages)"
    )


def raw_links(found: str, where: str = "TRUE") -> str:
    return (
        f"{pages_cte()}, raws AS (SELECT src_url, unnest({found}) AS raw FROM m), "
        f"links AS (SELECT src_url, raw, {resolve('raw', 'src_url')} AS dst_url FROM raws) "
        f"SELECT src_url, raw, dst_url FROM links WHERE {where}"
    )


def link_ctes(rules, found: str, table: str = "m") -> str:
    n = norm if rules.normalization == "standard" else norm_fast
    own = norm("src_url") if rules.normalization == "standard" else "src_url"
    skip = any_of("dst_url", rules.skip)
    return (
        f"raws AS (SELECT DISTINCT src_url, unnest({found}) AS raw FROM {table}), "
        f"joined AS (SELECT src_url, {resolve('raw', 'src_url')} AS abs FROM raws), "
        f"normed AS (SELECT DISTINCT src_url, {n('abs')} AS dst_url FROM joined), "
        f"links AS (SELECT src_url, dst_url FROM normed WHERE {target('dst_url', rules)} "
        f"AND NOT {skip} AND {valid('dst_url')} AND dst_url <> {own})"
    )


STANDARD_RAWS = (
    f"flatten([{hrefs('markup', 'a')}, {rel_hrefs('markup', STANDARD.link_rels)}, {hrefs('markup', 'area')}])"
)
FAST_RAWS = (
    f"flatten([{hrefs('markup', 'a')}, {rel_hrefs('markup', FAST.link_rels)}, {form_actions('markup')}, "
    f"{data_locations('markup')}, {option_paths('markup', 'fast')}])"
)
GENERATED = "(SELECT list(path) FROM gen_paths)"
FIRST_PAGES = "(SELECT min(url) FROM site_pages GROUP BY regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*'))"


def final_raws(generated: str) -> str:
    return (
        f"flatten([{hrefs('markup', 'a')}, {rel_hrefs('markup', FINAL.link_rels)}, {form_actions('markup')}, "
        f"{company('markup')}, {option_paths('markup', 'final')}, {generated}])"
    )


FINAL_RAWS = final_raws(GENERATED)
FIRST_PAGE_RAWS = final_raws(f"CASE WHEN src_url IN {FIRST_PAGES} THEN {GENERATED} ELSE [] END")
HOME_RAWS = (
    r"flatten([" + each(tags("markup", "a"), attr("t", "href")) + f", {script_urls('html')}, "
    f"{form_actions('markup', True)}, {data_url_only('markup')}])"
)

# --- Generators ---------------------------------------------------------------


def filled(templates, dim: str, source: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT replace({q(t)}, '{{{dim}}}', value) AS path FROM {source}" for t in templates
    )
    return rows


def values_of(items) -> str:
    return "(VALUES " + ", ".join(f"({q(i)})" for i in items) + ") AS v(value)"


def top_dim(table: str, n: int) -> str:
    return f"(SELECT value FROM {table} ORDER BY pos LIMIT {n})"


def pairs(templates, n: int | None) -> str:
    loc = f"(SELECT value AS l FROM {top_dim('locations', n) if n else 'locations'})"
    cat = f"(SELECT value AS c FROM {top_dim('categories', n) if n else 'categories'})"
    return " UNION ALL ".join(
        f"SELECT replace(replace({q(t)}, '{{location}}', l), '{{category}}', c) AS path "
        f"FROM {loc} x CROSS JOIN {cat} y"
        for t in templates
    )


GEN_LOCATION = filled(R.LOCATION_TEMPLATES, "location", "locations")
GEN_CATEGORY = filled(R.CATEGORY_TEMPLATES, "category", "categories")
GEN_TYPE_LEVEL = (
    filled(R.TYPE_TEMPLATES, "type", values_of(R.JOB_TYPES))
    + " UNION ALL "
    + filled(R.LEVEL_TEMPLATES, "level", values_of(R.JOB_LEVELS))
)
GEN_SALARY = filled(R.SALARY_TEMPLATES, "salary", values_of(R.SALARY_BANDS))
GEN_COMBO = pairs(R.COMBO_TEMPLATES, None)
GEN_ALL = " UNION ALL ".join((GEN_LOCATION, GEN_CATEGORY, GEN_TYPE_LEVEL, GEN_SALARY, GEN_COMBO))
ONE_LOCATION = [
    t for t in R.PATTERN_TEMPLATES if t.count("{") == 1 and "{location}" in t
]
ONE_CATEGORY = [
    t for t in R.PATTERN_TEMPLATES if t.count("{") == 1 and "{category}" in t
]
GEN_PATTERNS = " UNION ALL ".join(
    (
        filled(ONE_LOCATION, "location", "locations"),
        filled(ONE_CATEGORY, "category", "categories"),
        pairs(R.PATTERN_COMBO_TEMPLATES, None),
    )
)
GEN_SEARCH = " UNION ALL ".join(
    f"SELECT {q(f'{e}?{k}={v}')} AS path" for e in ("/search", "/jobs") for k, v in R.SEARCH_PARAMS
)
ORIGINS = "SELECT DISTINCT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*') AS origin FROM pages"


def generated(paths: str) -> str:
    return (
        f"WITH {duckdb_with('locations', 'categories')} SELECT DISTINCT origin, {norm_fast('origin || path')} AS url "
        f"FROM ({ORIGINS}) o CROSS JOIN ({paths}) g"
    )


API_SQL = (
    "SELECT DISTINCT url AS endpoint, url || suffix AS url FROM (SELECT DISTINCT url FROM api_probes "
    "WHERE status_code = 200 AND contains(content_type, 'json') AND "
    f"{in_list('regexp_extract(url, chr(94) || $$[a-z]+://[^/?#]*([^?#]*)$$, 1)', R.API_ENDPOINTS)}) g "
    "CROSS JOIN (SELECT '' AS suffix UNION ALL SELECT '?location=' || value FROM "
    "locations UNION ALL SELECT '?category=' || value FROM categories) s"
)

SEARCH_SQL = (
    f"SELECT DISTINCT src_url, src_url || '?' || {encode('CASE WHEN o.named THEN o.name ELSE chr(113) END')} "
    f"|| '=' || {encode('o.value')} AS dst_url FROM (SELECT url AS src_url, unnest({options('markup', True)}) AS o "
    f"FROM (SELECT url, {stripped()} AS markup FROM search_pages WHERE "
    f"{in_list('regexp_extract(url, chr(94) || $$[a-z]+://[^/?#]*([^?#]*)$$, 1)', R.SEARCH_ENDPOINTS)}) z) y "
    "WHERE o.value NOT IN ('', '0', 'all')"
)

# --- Robots -------------------------------------------------------------------

ROBOTS_RULES = rf"""
rl AS (SELECT host, line_no, line, {ws("regexp_replace(line, '#.*$', '')")} AS txt FROM robots_lines),
rk AS (SELECT host, line_no, CASE WHEN line = '' THEN 'blank' WHEN NOT contains(txt, ':') THEN NULL
    ELSE CASE lower({ws("split_part(txt, ':', 1)")}) WHEN 'user-agent' THEN 'agent' WHEN 'allow' THEN 'allow'
    WHEN 'disallow' THEN 'disallow' WHEN 'crawl-delay' THEN 'other' WHEN 'request-rate' THEN 'other' END END AS kind,
    url_decode({ws("regexp_replace(txt, '^[^:]*:', '')")}) AS value FROM rl),
rs AS (SELECT *, lag(kind) OVER w AS prev,
    last_value(CASE WHEN kind IN ('agent', 'blank') THEN kind END IGNORE NULLS) OVER w AS state
    FROM rk WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY host ORDER BY line_no
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
rg AS (SELECT *, sum(CASE WHEN kind = 'agent' AND coalesce(prev, '') <> 'agent' THEN 1 ELSE 0 END)
    OVER (PARTITION BY host ORDER BY line_no) AS group_no FROM rs),
robots_rules AS (SELECT a.host, CAST(a.group_no AS BIGINT) AS group_no, lower(a.value) AS agent, r.line_no AS rule_no,
    (r.kind <> 'disallow' OR r.value = '') AS allow, CASE WHEN r.kind <> 'other' THEN r.value END AS path
    FROM rg a JOIN rg r ON a.host = r.host AND a.group_no = r.group_no
    WHERE a.kind = 'agent' AND r.kind IN ('allow', 'disallow', 'other') AND r.state = 'agent')
"""


def robots_verdict(agent: str, urls: str) -> str:
    path = let(
        parts("url_decode(url)"),
        "u",
        "CASE WHEN u.path || u.query || u.fragment = '' THEN '/' ELSE u.path "
        "|| CASE WHEN u.query <> '' THEN '?' || u.query ELSE '' END "
        "|| CASE WHEN u.fragment <> '' THEN '#' || u.fragment ELSE '' END END",
    )
    return f"""{ROBOTS_RULES},
groups AS (SELECT host, group_no, bool_or(agent = '*') AS dflt, bool_or(agent <> '*' AND contains('{agent}', agent)) AS named
    FROM robots_rules GROUP BY host, group_no),
chosen AS (SELECT host, arg_min(group_no, CASE WHEN dflt THEN 1000000000000 ELSE 0 END + group_no) AS group_no
    FROM groups WHERE dflt OR named GROUP BY host),
bound AS (SELECT DISTINCT r.host, r.rule_no, r.allow, r.path FROM robots_rules r JOIN chosen c
    ON r.host = c.host AND r.group_no = c.group_no),
asked AS (SELECT url, {domain('url')} AS host, {path} AS p FROM (SELECT DISTINCT url FROM ({urls}) z) y),
verdicts AS (SELECT a.url, coalesce(arg_min(b.allow, b.rule_no), TRUE) AS allowed FROM asked a
    LEFT JOIN bound b ON a.host = b.host AND starts_with(a.p, b.path) GROUP BY a.url)"""


ROBOTS_URLS = rf"""
k AS (SELECT host, 'https://' || host AS base, lower(split_part({ws('line')}, ':', 1)) AS key,
    {ws("regexp_replace(" + ws('line') + ", '^[^:]*:', '')")} AS value FROM robots_lines WHERE contains(line, ':')),
robots_urls AS (SELECT DISTINCT host, 'sitemap' AS kind, value AS url FROM k WHERE key = 'sitemap' AND value <> ''
  UNION SELECT host, 'path', url FROM (SELECT host, base, {resolve('value', 'base')} AS url FROM k
    WHERE key IN ('allow', 'disallow') AND value NOT IN ('', '/') AND NOT starts_with(value, '*')) p
  WHERE {same_site('url', 'base')})
"""

# --- Registry -----------------------------------------------------------------

LATEST = (
    "latest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY url "
    "ORDER BY fetched_at DESC, attempt_id DESC) AS rn FROM crawl_log) z WHERE rn = 1)"
)
LATEST_NORM = (
    f"clog AS (SELECT * REPLACE ({norm('url')} AS url) FROM crawl_log), "
    "latest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY url "
    "ORDER BY fetched_at DESC, attempt_id DESC) AS rn FROM clog) z WHERE rn = 1)"
)
FRESH = (
    f"fn AS (SELECT *  REPLACE ({norm('url')} AS url) FROM found), "
    "fresh AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY pos) AS rn "
    "FROM fn) z WHERE rn = 1 AND url NOT IN (SELECT url FROM registry))"
)
VALID = "valid AS (SELECT * FROM registry WHERE crawl_status = 'success' AND status_code BETWEEN 200 AND 399)"
CHUNKS = (
    f"{VALID}, chunks AS (SELECT url AS loc, {iso('last_crawled')} AS lastmod, {changefreq('url')} AS changefreq, "
    f"{priority('url')} AS priority, CAST((row_number() OVER (ORDER BY url) - 1) // {PER_FILE} + 1 AS BIGINT) "
    "AS sitemap_no FROM valid), last AS (SELECT max(sitemap_no) AS m FROM chunks), "
    "files AS (SELECT sitemap_no, CASE WHEN (SELECT m FROM last) = 1 THEN 'sitemap.xml' ELSE 'sitemap_' "
    "|| lpad(CAST(sitemap_no AS VARCHAR), CAST(greatest(3, length(CAST(sitemap_no AS VARCHAR))) AS INTEGER), '0') || '.xml' END AS file, "
    "count(*) AS urls, min(loc) AS first_loc, max(loc) AS last_loc FROM chunks GROUP BY sitemap_no)"
)


def w(*names: str, extra: str = "") -> str:
    return f"WITH {duckdb_with(*names)}" + (f", {extra}" if extra else "") + " "


def applied(column: str) -> str:
    return f"CASE WHEN l.url IS NOT NULL THEN l.{column} ELSE r.{column} END AS {column}"


NEW_STATUS = (
    f"CASE WHEN l.url IS NOT NULL THEN {status('l.status_code', 'l.error_message')} "
    "ELSE r.crawl_status END AS crawl_status"
)

AT_ROOT = "regexp_matches(src_url, '^[a-z]+://[^/?#]*/?$')"
HOME = f"m AS (SELECT url AS src_url, html, {stripped()} AS markup FROM home_pages)"
DECLARED = (
    f"{ROBOTS_URLS}, declared AS (SELECT file, loc FROM site_maps WHERE {same_site('loc', chr(39) + 'https://' + chr(39) + ' || split_part(file, chr(47), 1)')} "
    "AND (file LIKE '%/sitemap.xml' OR file LIKE '%/maps/a%' OR 'https://' || file IN (SELECT u.url FROM robots_urls u "
    "JOIN robots_fetches f ON f.host = u.host AND f.status_code = 200 WHERE u.kind = 'sitemap')))"
)
STRATEGY_CTES = (
    f"{DECLARED}, {HOME}, "
    f"hr AS (SELECT DISTINCT src_url, unnest({HOME_RAWS}) AS raw FROM m WHERE {AT_ROOT}), "
    f"hl AS (SELECT DISTINCT url FROM (SELECT src_url, {resolve('raw', 'src_url')} AS url FROM hr) z "
    f"WHERE {same_site('url', 'src_url')}), "
    "strategies AS (SELECT 'sitemaps' AS strategy, loc AS url FROM declared "
    "UNION SELECT 'robots', url FROM robots_urls WHERE kind = 'path' UNION SELECT 'homepage', url FROM hl "
    f"UNION SELECT 'patterns', {norm_fast('origin || path')} FROM ({ORIGINS}) o CROSS JOIN ({GEN_PATTERNS}) g "
    f"UNION SELECT 'search', dst_url FROM ({SEARCH_SQL}) s UNION SELECT 'api', url FROM ({API_SQL}) a)"
)
STRATEGY_TABLES = (
    "site_maps", "robots_lines", "robots_fetches", "home_pages", "search_pages", "api_probes", "locations", "categories",
)

SNAP_LINKS = (
    f"sm AS (SELECT url, step, {stripped()} AS markup FROM snapshots), "
    f"sr AS (SELECT DISTINCT url, step, unnest(flatten([{hrefs('markup', 'a')}, {hrefs('markup', 'area')}])) AS raw FROM sm), "
    f"sl AS (SELECT DISTINCT url, step, {resolve('raw', 'url')} AS dst_url FROM sr), "
    "delta AS (SELECT url, step, dst_url FROM sl a WHERE step > 0 AND NOT EXISTS (SELECT 1 FROM sl b "
    "WHERE b.url = a.url AND b.step = a.step - 1 AND b.dst_url = a.dst_url))"
)

SECONDS = "(CAST(epoch_us(max({0})) - epoch_us(min({0})) AS DOUBLE) / 1000000)"


def all_oracles() -> dict[str, str]:
    o: dict[str, str] = {}

    # Scans, sources, sinks
    o["scan_pages"] = w("site_pages") + (
        f"SELECT page_id, url, CASE WHEN {html_type('content_type')} THEN html ELSE '' END AS html FROM site_pages"
    )
    o["scan_crawl_log"] = w("crawl_log") + "SELECT * FROM crawl_log"
    o["scan_registry"] = w("registry") + "SELECT * EXCLUDE (page_id) FROM registry"
    o["read_sitemap"] = w("registry", extra=CHUNKS) + (
        "SELECT loc, lastmod, changefreq, printf('%.1f', priority) AS priority FROM chunks "
        f"WHERE {same_site('loc', q(BASE))}"
    )
    o["read_sitemap_index"] = w("registry", extra=CHUNKS) + (
        "SELECT file, loc FROM chunks JOIN files USING (sitemap_no)"
    )
    o["probe_sitemap_paths"] = (
        f"SELECT origin, origin || value AS url FROM ({ORIGINS}) o CROSS JOIN {values_of(R.SITEMAP_PATHS)}"
    )
    o["read_robots"] = w("robots_lines", extra=ROBOTS_URLS) + "SELECT host, kind, url FROM robots_urls"
    o["declared_sitemaps"] = w("site_maps", "robots_lines", "robots_fetches", extra=DECLARED) + "SELECT file, loc FROM declared"
    o["write_sitemap"] = w("registry", extra=CHUNKS) + "SELECT file, urls, first_loc, last_loc FROM files"
    o["write_sitemap_final"] = w("crawl_log", extra=LATEST) + (
        f"SELECT url AS loc, '{NOW_ISO}' AS lastmod, {changefreq_final('url')} AS changefreq, "
        f"printf('%.1f', {priority_final('url')}) AS priority FROM latest "
        "WHERE status_code = 200 AND coalesce(error_message, '') = ''"
    )
    o["write_sitemap_index"] = w("registry", extra=CHUNKS) + (
        f"SELECT '{BASE}/sitemap/' || file AS loc, '{NOW_ISO}' AS lastmod FROM files WHERE file <> 'sitemap.xml'"
    )
    o["write_robots"] = w("registry", extra=CHUNKS) + (
        "SELECT 0 AS line_no, 'User-agent: *' AS line UNION ALL SELECT 1, 'Allow: /' UNION ALL SELECT 2, '' "
        f"UNION ALL SELECT 3, 'Sitemap: {BASE}/sitemap/' || CASE WHEN (SELECT m FROM last) = 1 THEN 'sitemap.xml' "
        "ELSE 'sitemap_index.xml' END"
    )
    o["write_robots_final"] = w("crawl_log", extra=LATEST) + (
        "SELECT line_no, line FROM (SELECT 0 AS line_no, 'User-agent: *' AS line UNION ALL SELECT 1, 'Allow: /' "
        f"UNION ALL SELECT 2, 'Sitemap: {BASE}/sitemap.xml') z WHERE EXISTS (SELECT 1 FROM latest "
        "WHERE status_code = 200 AND coalesce(error_message, '') = '')"
    )
    o["write_gzip"] = w("registry", extra=CHUNKS) + "SELECT file || '.gz' AS file, urls FROM files"
    o["overwrite_sitemaps"] = w("registry", extra=VALID) + (
        "SELECT unnest(CASE WHEN n <= 50000 THEN ['robots.txt', 'sitemap.xml'] ELSE list_concat("
        "['robots.txt', 'sitemap_index.xml'], list_transform(generate_series(1, CAST(ceil(n / 50000.0) AS BIGINT)), "
        "lambda i: printf('sitemap_%03d.xml', i))) END) AS file FROM (SELECT count(*) AS n FROM valid) z"
    )
    o["export_registry_tsv"] = w("registry") + (
        'SELECT url AS "URL", crawl_status AS "Status", coalesce(CAST(nullif(status_code, 0) AS VARCHAR), \'N/A\') '
        'AS "HTTP Code", depth AS "Depth", CAST(is_dynamic AS INTEGER) AS "Dynamic" FROM registry'
    )
    o["seed_urls"] = (
        f"SELECT DISTINCT {norm('origin')} AS url, 0 AS depth, 'pending' AS crawl_status, FALSE AS is_dynamic, "
        f"100 AS priority FROM ({ORIGINS}) o"
    )
    o["reset_registry"] = w("found") + (
        f"SELECT url, depth, 'pending' AS crawl_status FROM (SELECT {norm('url')} AS url, depth, row_number() OVER "
        f"(PARTITION BY {norm('url')} ORDER BY pos) AS rn FROM found) z WHERE rn = 1"
    )

    # URL scalar functions
    o["url_split"] = (
        "SELECT page_id, lower(u.scheme) AS scheme, u.netloc AS netloc, u.path AS path, u.query AS query, "
        f"u.fragment AS fragment FROM (SELECT page_id, {parts('url')} AS u FROM pages) z"
    )
    cases = w("url_cases")
    o["url_resolve"] = cases + f"SELECT page_id, {resolve('ref', 'base')} AS url FROM url_cases"
    joined = f"(SELECT page_id, base, ref, {resolve('ref', 'base')} AS j FROM url_cases) z"
    o["url_normalize"] = cases + f"SELECT page_id, {norm('j')} AS url FROM {joined}"
    o["url_normalize_fast"] = cases + f"SELECT page_id, {norm_fast('j')} AS url FROM {joined}"
    o["url_domain"] = cases + (
        f"SELECT page_id, {domain('base')} AS domain, {domain('ref')} AS ref_domain FROM url_cases"
    )
    o["is_valid_url"] = cases + f"SELECT page_id, {valid('ref')} AS valid FROM url_cases"
    o["is_same_site"] = cases + f"SELECT page_id, {same_site('j', 'base')} AS same_site FROM {joined}"
    o["is_target_domain"] = w("site_pages") + (
        f"SELECT page_id, {target('url', STANDARD)} AS target_standard, {target('url', FINAL)} AS target_final "
        "FROM site_pages"
    )
    jobs = w("job_urls")
    o["should_skip_url"] = jobs + (
        f"SELECT id, {any_of('url', STANDARD.skip)} AS skip_standard, {any_of('url', FAST.skip)} AS skip_fast FROM job_urls"
    )
    o["is_dynamic_url"] = jobs + (
        f"SELECT id, {any_of('url', STANDARD.dynamic)} AS dynamic_standard, {any_of('url', FAST.dynamic)} AS dynamic_fast, "
        f"{any_of('url', FINAL.dynamic)} AS dynamic_final FROM job_urls"
    )
    o["is_job_related"] = jobs + f"SELECT id, {job_related('url')} AS job_related FROM job_urls"
    o["classify_url_type"] = jobs + f"SELECT id, {classify('url')} AS url_type FROM job_urls"
    o["url_priority"] = jobs + f"SELECT id, {priority('url')} AS priority FROM job_urls"
    o["url_changefreq"] = jobs + f"SELECT id, {changefreq('url')} AS changefreq FROM job_urls"
    o["url_priority_final"] = jobs + (
        f"SELECT id, {priority_final('url')} AS priority, {changefreq_final('url')} AS changefreq FROM job_urls"
    )
    o["url_priority_fast"] = jobs + (
        f"SELECT id, CAST(CASE WHEN {any_of('url', FAST.dynamic)} THEN 0.8 ELSE 0.5 END AS DOUBLE) AS priority, "
        "'weekly' AS changefreq FROM job_urls"
    )
    o["url_pattern"] = jobs + f"SELECT id, {pattern('url')} AS pattern FROM job_urls"
    o["frontier_priority"] = w("registry") + (
        "SELECT url, CAST(greatest(0, 100 - depth * 3 * 10) AS INTEGER) AS priority FROM registry"
    )
    o["crawl_status"] = w("crawl_log") + (
        f"SELECT attempt_id, {status('status_code', 'error_message')} AS crawl_status FROM crawl_log"
    )
    o["content_type_main"] = w("site_pages") + (
        f"SELECT page_id, {main_type('content_type')} AS content_type FROM site_pages"
    )
    o["is_html"] = w("site_pages") + (
        f"SELECT page_id, {html_type('content_type')} AS html_standard, contains(content_type, 'text/html') AS html_final "
        "FROM site_pages"
    )
    o["clean_text"] = (
        r"SELECT page_id, regexp_replace(regexp_replace(" + ws("html") + r", '\s+', ' ', 'g'), "
        r"'[\x00-\x1f\x7f-\x{9f}]', '', 'g') AS text FROM pages"
    )
    o["iso_lastmod"] = w("registry") + f"SELECT url, {iso('last_crawled')} AS lastmod FROM registry"

    # Link extraction
    o["links_anchor"] = raw_links(hrefs("markup", "a"))
    rel = [
        f"SELECT '{r.name}' AS rules, src_url, unnest({rel_hrefs('markup', r.link_rels)}) AS raw FROM m"
        for r in (STANDARD, FAST)
    ]
    o["links_rel"] = (
        f"{pages_cte()} SELECT rules, src_url, raw, {resolve('raw', 'src_url')} AS dst_url "
        f"FROM ({rel[0]} UNION ALL {rel[1]}) z"
    )
    o["links_area"] = raw_links(hrefs("markup", "area"))
    o["links_form"] = raw_links(form_actions("markup"))
    o["links_form_any"] = raw_links(form_actions("markup", True))
    o["links_data_attr"] = raw_links(data_urls("markup"))
    o["links_data_location"] = raw_links(data_locations("markup"))
    o["links_script"] = raw_links(script_urls("html"), same_site("dst_url", "src_url"))
    o["links_pagination"] = raw_links(pagination("markup"))
    o["links_pagination_top5"] = raw_links(pagination_top("markup"))
    o["links_company"] = raw_links(company("markup"))
    o["select_options"] = raw_links(option_paths("markup", "final"))
    o["select_options_fast"] = raw_links(option_paths("markup", "fast"))
    o["select_options_rendered"] = raw_links(option_paths("markup", "rendered"))
    o["search_option_urls"] = w("search_pages") + SEARCH_SQL
    o["extract_links"] = f"{pages_cte()}, {link_ctes(STANDARD, STANDARD_RAWS)} SELECT * FROM links"
    o["extract_links_fast"] = f"{pages_cte()}, {link_ctes(FAST, FAST_RAWS)} SELECT * FROM links"
    o["extract_links_final"] = (
        f"{pages_cte()}, {duckdb_with('locations', 'categories')}, gen_paths AS ({GEN_ALL}), "
        f"{link_ctes(FINAL, FIRST_PAGE_RAWS)} SELECT * FROM links"
    )
    o["snapshot_delta"] = w("snapshots", extra=SNAP_LINKS) + (
        ", stops AS (SELECT url, min(step) AS stop FROM (SELECT DISTINCT url, step FROM snapshots WHERE step > 0 "
        "EXCEPT SELECT url, step FROM delta) z GROUP BY url) SELECT d.url, d.step, d.dst_url FROM delta d "
        "LEFT JOIN stops s ON d.url = s.url WHERE s.stop IS NULL OR d.step < s.stop"
    )
    o["snapshot_delta_clicks"] = w("snapshots", extra=SNAP_LINKS) + "SELECT url, step, dst_url FROM delta"
    # All anchors of a container are anchors of the page: the lists of containers add nothing here.
    rendered = (
        f"flatten([{hrefs('markup', 'a')}, {hrefs('markup', 'area')}, {data_urls('markup')}, "
        f"{pagination('markup', NO_ANCHORS)}, {option_paths('markup', 'rendered')}])"
    )
    o["extract_links_rendered"] = w(
        "snapshots", extra=f"m AS (SELECT url AS src_url, step, {stripped()} AS markup FROM snapshots)"
    ) + f", {link_ctes(STANDARD, rendered)} SELECT DISTINCT src_url, dst_url FROM links"

    def meta(name: str) -> str:
        return (
            f"coalesce({attr('list_filter(' + tags('markup', 'meta') + ', lambda t: ' + attr('t', 'name') + f' = {q(name)})[1]', 'content')}, '')"
        )

    canonical = (
        f"list_filter({tags('markup', 'link')}, lambda t: list_contains("
        rf"regexp_split_to_array({ws(attr('t', 'rel'))}, '\s+'), 'canonical'))[1]"
    )
    title = ws(unescape("regexp_extract(markup, '(?is)<title[^>]*>(.*?)</title', 1)"))
    html_tag = r"regexp_extract(markup, '(?is)<html\b[^>]*>')"
    o["page_metadata"] = f"{pages_cte()} " + (
        f"SELECT page_id, src_url AS url, {title} AS title, "
        f"{meta('description')} AS description, coalesce({attr(canonical, 'href')}, '') AS canonical, "
        f"{attr(html_tag, 'lang')} AS language, {meta('last-modified')} AS last_modified FROM m"
    )
    body = r"regexp_extract(markup, '(?is)<body\b[^>]*>(.*?)(?:</body\s*>|\z)', 1)"
    o["page_text"] = f"{pages_cte()} SELECT page_id, src_url AS url, coalesce({MAIN_TEXT}, {inner_text(body)}) AS content FROM m"
    o["link_density"] = f"{pages_cte()} " + (
        f"SELECT page_id, src_url AS url, len(list_filter({tags('markup', 'a')}, lambda t: {has_attr('t', 'href')})) "
        "/ greatest(length(html) / CAST(1024.0 AS DOUBLE), CAST(1.0 AS DOUBLE)) AS link_density FROM m"
    )
    o["homepage_links"] = (
        f"{pages_cte()}, hr AS (SELECT DISTINCT src_url, unnest({HOME_RAWS}) AS raw FROM m), "
        f"hl AS (SELECT DISTINCT src_url, {resolve('raw', 'src_url')} AS dst_url FROM hr) "
        f"SELECT src_url, dst_url FROM hl WHERE {same_site('dst_url', 'src_url')}"
    )

    # Filters
    o["filter_candidates"] = (
        f"{pages_cte()}, raws AS (SELECT src_url, unnest({hrefs('markup', 'a')}) AS raw FROM m), "
        f"j AS (SELECT src_url, {resolve('raw', 'src_url')} AS a FROM raws), "
        f"n AS (SELECT src_url, {norm('a')} AS dst_url FROM j) SELECT src_url, dst_url FROM n "
        f"WHERE {target('dst_url', STANDARD)} AND NOT {any_of('dst_url', STANDARD.skip)} AND dst_url <> {norm('src_url')}"
    )
    skips = (
        f"CASE d.rules WHEN 'standard' THEN {any_of('dst_url', STANDARD.skip)} OR dst_url = {norm('src_url')} "
        f"ELSE {any_of('dst_url', FAST.skip)} OR dst_url = {norm_fast('src_url')} END"
    )
    o["filter_candidates_sites"] = (
        f"WITH {duckdb_with('sites', 'site_pages')}, "
        f"m AS (SELECT url AS src_url, {stripped()} AS markup FROM (SELECT url, html FROM pages UNION ALL SELECT url, html FROM site_pages) p), "
        f"raws AS (SELECT src_url, unnest({hrefs('markup', 'a')}) AS raw FROM m), "
        f"j AS (SELECT src_url, {resolve('raw', 'src_url')} AS a FROM raws), "
        f"n AS (SELECT DISTINCT src_url, {norm('a')} AS dst_url FROM j) SELECT src_url, dst_url, d.site, d.rules FROM n "
        f"JOIN sites s ON s.host = {domain('src_url')} JOIN sites d ON d.host = {domain('dst_url')} AND d.site = s.site WHERE NOT ({skips})"
    )
    o["route_sites"] = (
        f"WITH {duckdb_with('sites', 'job_urls')} SELECT url, site, rules, CASE WHEN CASE rules WHEN 'standard' THEN "
        f"{any_of('url', STANDARD.dynamic)} ELSE {any_of('url', FAST.dynamic)} END THEN 'dynamic' ELSE 'static' END AS route "
        f"FROM (SELECT url FROM pages UNION ALL SELECT url FROM job_urls) u JOIN sites s ON s.host = {domain('url')}"
    )
    o["valid_urls"] = w("registry", extra=VALID) + "SELECT url, status_code, depth FROM valid"
    o["valid_urls_final"] = w("crawl_log", extra=LATEST) + (
        "SELECT url, status_code FROM latest WHERE status_code = 200 AND coalesce(error_message, '') = ''"
    )
    o["robots_rules"] = w("robots_lines", extra=ROBOTS_RULES) + (
        "SELECT host, CAST(group_no AS BIGINT) AS group_no, line_no AS rule_no, (kind <> 'disallow' OR value = '') AS allow, "
        "CASE WHEN kind <> 'other' THEN value END AS path FROM rg WHERE kind IN ('allow', 'disallow', 'other') "
        "AND state = 'agent'"
    )
    o["robots_agents"] = w("robots_lines", extra=ROBOTS_RULES) + (
        "SELECT host, CAST(group_no AS BIGINT) AS group_no, lower(value) AS agent FROM rg WHERE kind = 'agent'"
    )
    o["robots_allowed"] = w(
        "robots_lines", "robots_fetches", "site_pages", "job_urls",
        extra=robots_verdict("sitebot", "SELECT url FROM site_pages UNION ALL SELECT url FROM job_urls"),
    ) + (
        "SELECT url, CASE WHEN f.status_code IN (401, 403) OR f.status_code >= 500 THEN FALSE "
        "WHEN f.status_code BETWEEN 400 AND 499 OR f.status_code = 0 THEN TRUE ELSE allowed END AS allowed "
        f"FROM verdicts v LEFT JOIN robots_fetches f ON f.host = {domain('v.url')}"
    )
    o["robots_blocked"] = w(
        "robots_lines", "site_pages", extra=robots_verdict("otherbot", "SELECT url FROM site_pages")
    ) + "SELECT url, 403 AS status_code, 'Disallowed by robots.txt' AS error_message FROM verdicts WHERE NOT allowed"
    o["route_static_dynamic"] = jobs + (
        f"SELECT id, url, CASE WHEN {any_of('url', STANDARD.dynamic)} THEN 'dynamic' ELSE 'static' END AS route FROM job_urls"
    )

    # Joins
    o["new_urls"] = w("found", "registry", extra=FRESH) + "SELECT url, pos, parent_url, depth FROM fresh"
    o["uncrawled"] = w("crawl_log", extra=LATEST) + (
        f"SELECT DISTINCT url FROM site_pages WHERE url NOT IN (SELECT url FROM latest WHERE {status('status_code', 'error_message')} = 'success')"
    )
    o["apply_results"] = w("registry", "crawl_log", extra=LATEST_NORM) + (
        f"SELECT r.url, {applied('status_code')}, {applied('content_type')}, {NEW_STATUS}, {applied('error_message')}, "
        f"{applied('response_time')}, {iso('CASE WHEN l.url IS NOT NULL THEN l.fetched_at ELSE r.last_crawled END')} "
        "AS last_crawled FROM registry r LEFT JOIN latest l ON r.url = l.url"
    )
    o["dequeue_done"] = w("frontier", "crawl_log", extra=LATEST_NORM) + (
        f"SELECT url, priority, is_processing FROM frontier WHERE url NOT IN (SELECT url FROM latest "
        f"WHERE {status('status_code', 'error_message')} = 'success')"
    )
    o["replace_results"] = w("crawl_log", extra=LATEST) + (
        f"SELECT url, status_code, is_dynamic FROM latest WHERE url NOT IN (SELECT url FROM site_pages WHERE {any_of('url', STANDARD.dynamic)}) "
        f"UNION ALL SELECT url, 200, TRUE FROM site_pages WHERE {any_of('url', STANDARD.dynamic)}"
    )
    o["type_lookup"] = jobs + (
        f"SELECT DISTINCT {classify('url')} AS url_type, url, {priority('url')} AS priority, {changefreq('url')} AS changefreq FROM job_urls"
    )
    o["parent_lineage"] = w("registry") + (
        "SELECT c.url, c.depth, c.parent_url, p.depth AS parent_depth, p.crawl_status AS parent_status, "
        "c.depth = p.depth + 1 AS depth_follows FROM registry c LEFT JOIN registry p ON c.parent_url = p.url"
    )
    o["candidate_cross"] = generated(pairs(("/{category}-jobs-in-{location}",), None))
    o["links_in_corpus"] = (
        f"{pages_cte()}, {link_ctes(STANDARD, STANDARD_RAWS)} SELECT * FROM links "
        f"WHERE dst_url IN (SELECT {norm('url')} FROM site_pages)"
    )

    # Aggregations
    crawl = (
        "SELECT count(*) AS total_urls_discovered, count(*) FILTER (WHERE crawl_status = 'success') AS successful_crawls, "
        "count(*) FILTER (WHERE crawl_status = 'error') AS failed_crawls, "
        "count(*) FILTER (WHERE crawl_status = 'skipped') AS skipped_urls, "
        "count(*) FILTER (WHERE crawl_status = 'success' AND is_dynamic) AS dynamic_pages_crawled, "
        "count(*) FILTER (WHERE crawl_status = 'success' AND NOT is_dynamic) AS static_pages_crawled, "
        "count(*) FILTER (WHERE crawl_status IN ('success', 'error', 'skipped')) AS total_urls_crawled FROM registry"
    )
    o["crawl_stats"] = w("registry") + crawl
    o["status_counts"] = w("registry") + "SELECT crawl_status, count(*) AS urls FROM registry GROUP BY crawl_status"
    o["dynamic_counts"] = w("registry") + (
        "SELECT is_dynamic, count(*) AS urls FROM registry WHERE crawl_status = 'success' GROUP BY is_dynamic"
    )
    o["queue_size"] = w("frontier") + (
        "SELECT count(*) FILTER (WHERE NOT is_processing) AS queue_size, count(*) AS pending FROM frontier"
    )
    o["success_rate"] = w("registry") + (
        "SELECT CASE WHEN total_urls_crawled > 0 THEN CAST(successful_crawls AS DOUBLE) / total_urls_crawled * 100 ELSE 0.0 END "
        "AS success_rate, CAST(total_urls_crawled AS DOUBLE) / greatest(total_urls_discovered, 1) * 100 AS coverage_rate "
        f"FROM ({crawl}) z"
    )
    o["throughput"] = w("crawl_log") + (
        f"SELECT crawled, seconds, CASE WHEN seconds > 0 THEN crawled / seconds ELSE 0.0 END AS urls_per_second "
        f"FROM (SELECT count(*) AS crawled, {SECONDS.format('fetched_at')} AS seconds FROM crawl_log) z"
    )
    o["final_stats"] = w("job_urls", "crawl_log") + (
        f", d AS (SELECT DISTINCT url FROM (SELECT url FROM job_urls UNION ALL SELECT url FROM site_pages) z), "
        f"a AS (SELECT count(*) AS total_discovered, count(*) FILTER (WHERE {job_related('url')}) AS job_related_urls, "
        "count(*) FILTER (WHERE contains(lower(url), 'browse-jobs')) AS browse_jobs_urls FROM d), "
        "b AS (SELECT count(DISTINCT url) AS total_crawled, count(DISTINCT url) FILTER (WHERE coalesce(error_message, '') <> '') "
        f"AS total_failed, {SECONDS.format('fetched_at')} AS total_time FROM crawl_log) "
        "SELECT total_discovered, total_crawled, total_failed, job_related_urls, browse_jobs_urls, "
        "CAST(total_crawled AS DOUBLE) / greatest(total_discovered, 1) * 100 AS success_rate, total_time, "
        "total_crawled / greatest(total_time, 1.0) AS urls_per_second FROM a CROSS JOIN b"
    )
    o["depth_breakdown"] = w("registry") + (
        f"SELECT depth, count(*) AS urls, count(last_crawled) AS crawled, {SECONDS.format('last_crawled')} AS seconds "
        "FROM registry GROUP BY depth"
    )
    o["pattern_counts"] = jobs + f"SELECT {pattern('url')} AS pattern, count(*) AS urls FROM job_urls GROUP BY 1"
    fields = "count(*) AS total_urls, count(lastmod) AS has_lastmod, count(changefreq) AS has_changefreq, count(priority) AS has_priority"
    o["sitemap_stats"] = w("registry", extra=CHUNKS) + f"SELECT sitemap_no, {fields} FROM chunks GROUP BY sitemap_no"
    # What the writer puts around the values: a declaration, the root, four and eight blanks before tags.
    def line(name: str, value: str) -> str:
        escaped = f"replace({value}, '&', '&amp;')"
        return f"coalesce(9 + {2 * len(name) + 5} + strlen({escaped}), 0)"

    per_row = (
        f"10 + 11 + {line('loc', 'loc')} + {line('lastmod', 'lastmod')} + {line('changefreq', 'changefreq')} "
        f"+ {line('priority', 'CAST(CAST(priority AS DECIMAL(3,1)) AS VARCHAR)')}"
    )
    around = len(f'<?xml {X.XML_DECLARATION}?>\n<urlset xmlns="{R.SITEMAP_NAMESPACE}">') + len("\n</urlset>")
    size = f"({around} + sum({per_row})) / 1048576.0"
    o["sitemap_file_stats"] = w("registry", extra=CHUNKS) + (
        f"SELECT file, {fields}, CAST({size} AS DOUBLE) AS file_size_mb FROM chunks JOIN files USING (sitemap_no) GROUP BY file"
    )
    for name in ("priority", "changefreq"):
        o[f"{name}_dist"] = w("registry", extra=CHUNKS) + (
            f"SELECT sitemap_no, {name}, count(*) AS urls FROM chunks GROUP BY sitemap_no, {name}"
        )
    index_row = f"14 + 15 + {line('loc', 'loc')} + {line('lastmod', q(NOW_ISO))}"
    index_around = len(f'<?xml {X.XML_DECLARATION}?>\n<sitemapindex xmlns="{R.SITEMAP_NAMESPACE}">') + len("\n</sitemapindex>")
    o["validate_sitemap"] = w("registry", extra=CHUNKS) + (
        f"SELECT file, 'urlset' AS kind, count(*) AS urls, TRUE AS valid, CAST({size} AS DOUBLE) AS file_size_mb "
        "FROM chunks JOIN files USING (sitemap_no) GROUP BY file UNION ALL "
        f"SELECT 'sitemap_index.xml', 'index', count(*), TRUE, CAST(({index_around} + sum({index_row})) / 1048576.0 AS DOUBLE) "
        f"FROM (SELECT '{BASE}/sitemap/' || file AS loc FROM files) z HAVING count(*) > 1"
    )
    o["link_union_per_page"] = (
        f"{pages_cte()}, {link_ctes(STANDARD, STANDARD_RAWS)} SELECT m.src_url, CAST(count(l.dst_url) AS INTEGER) "
        "AS unique_urls_found FROM m LEFT JOIN links l ON m.src_url = l.src_url GROUP BY m.src_url"
    )
    o["discovery_by_strategy"] = w(*STRATEGY_TABLES, extra=STRATEGY_CTES) + (
        "SELECT strategy, count(*) AS urls FROM strategies GROUP BY strategy UNION ALL "
        "SELECT 'all', count(DISTINCT url) FROM strategies"
    )

    # First-wins, ranks, top-k
    o["dedupe_first"] = w("found") + (
        f"SELECT url, min(pos) AS pos FROM (SELECT {norm('url')} AS url, pos FROM found) z WHERE {valid('url')} GROUP BY url"
    )
    o["first_parent"] = w("found") + (
        "SELECT url, depth, parent_url FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY depth, added_at, parent_url) "
        f"AS rn FROM (SELECT {norm('url')} AS url, depth, added_at, parent_url FROM found) y) z WHERE rn = 1"
    )
    o["pattern_first"] = jobs + (
        "SELECT url, pattern, row_number() OVER (PARTITION BY pattern ORDER BY url) > 1 AS is_duplicate "
        f"FROM (SELECT DISTINCT url, {pattern('url')} AS pattern FROM job_urls) z"
    )
    o["topk_per_class"] = jobs + (
        ", d AS (SELECT DISTINCT url FROM job_urls), c AS (SELECT url, CASE WHEN NOT contains(lower(url), 'browse-jobs') THEN 'other' "
        "WHEN ends_with(url, '/browse-jobs') THEN 'base' WHEN contains(url, 'category=') AND NOT contains(url, 'location=') THEN 'category' "
        "WHEN contains(url, 'location=') AND NOT contains(url, 'category=') THEN 'location' END AS render_class FROM d "
        f"WHERE {any_of('url', FINAL.dynamic)}), "
        "r AS (SELECT url, render_class, CAST(row_number() OVER (PARTITION BY render_class ORDER BY url) AS INTEGER) AS rn FROM c "
        "WHERE render_class IS NOT NULL) SELECT url, render_class, rn FROM r WHERE rn <= CASE render_class WHEN 'base' THEN 1 "
        "WHEN 'category' THEN 3 WHEN 'location' THEN 3 ELSE 5 END"
    )
    o["chunk_sitemaps"] = w("registry", extra=CHUNKS) + "SELECT loc, sitemap_no FROM chunks"
    o["latest_result"] = w("crawl_log", extra=LATEST) + "SELECT * FROM latest"
    order = "ORDER BY priority DESC, added_at, url"
    o["fetch_schedule"] = w("frontier") + (
        f"SELECT url, host, (row_number() OVER (PARTITION BY host {order}) - 1) * CAST(0.5 AS DOUBLE) AS start_after "
        f"FROM (SELECT *, {domain('url')} AS host FROM frontier) z"
    )
    o["retry_schedule"] = w("crawl_log") + (
        "SELECT attempt_id, url, failure_no, CASE WHEN failure_no <= 3 THEN CAST(pow(2, failure_no - 1) AS DOUBLE) END AS wait, "
        "failure_no > 3 AS gave_up FROM (SELECT attempt_id, url, row_number() OVER (PARTITION BY url ORDER BY fetched_at, attempt_id) "
        "AS failure_no FROM crawl_log WHERE coalesce(error_message, '') <> '') z"
    )
    o["batch_frontier"] = w("frontier") + (
        f"SELECT url, CAST((row_number() OVER ({order}) - 1) // 10 AS BIGINT) AS batch_no FROM frontier WHERE NOT is_processing"
    )
    o["next_urls"] = w("frontier") + (
        f"SELECT url, priority FROM frontier WHERE NOT is_processing {order} LIMIT 25"
    )
    o["sort_urls"] = w("registry") + "SELECT depth, url FROM registry ORDER BY depth, url"
    o["topn_dims"] = w("locations") + (
        f"SELECT origin, CAST(rn - 1 AS INTEGER) AS pos, value AS location FROM ({ORIGINS}) o CROSS JOIN "
        "(SELECT value, row_number() OVER (ORDER BY pos) AS rn FROM locations) l WHERE rn <= 15"
    )

    # Set operations
    o["union_strategies"] = w(*STRATEGY_TABLES, extra=STRATEGY_CTES) + "SELECT DISTINCT url FROM strategies"
    o["merge_discovered"] = w("found", "registry") + (
        f"SELECT url FROM registry UNION SELECT {norm('url')} FROM found"
    )
    o["diff_urls"] = w("snapshots", extra=SNAP_LINKS) + (
        "SELECT dst_url AS url FROM sl WHERE step = 4 EXCEPT SELECT dst_url FROM sl WHERE step = 1"
    )
    o["dedupe_set"] = jobs + "SELECT DISTINCT url FROM job_urls"

    # Generators
    o["gen_location"] = generated(GEN_LOCATION)
    o["gen_category"] = generated(GEN_CATEGORY)
    o["gen_type_level"] = generated(GEN_TYPE_LEVEL)
    o["gen_salary"] = generated(GEN_SALARY)
    o["gen_combo"] = generated(GEN_COMBO)
    o["gen_patterns"] = generated(GEN_PATTERNS)
    o["gen_search_params"] = generated(GEN_SEARCH)
    o["gen_api_params"] = w("api_probes", "locations", "categories") + API_SQL
    o["gen_all"] = generated(GEN_ALL)

    # Discovery and registry
    o["bfs_depth"] = (
        f"WITH RECURSIVE {duckdb_with('link_edges')}, b(id, depth) AS (SELECT min(page_id), 0 FROM pages UNION "
        "SELECT e.dst, b.depth + 1 FROM b JOIN link_edges e ON e.src = b.id WHERE b.depth < 5) "
        "SELECT id AS node, min(depth) AS depth FROM b GROUP BY id"
    )
    o["bfs_pages"] = (
        f"WITH RECURSIVE {duckdb_with('site_pages', 'registry')}, m AS (SELECT url AS src_url, {stripped()} AS markup FROM site_pages), "
        f"{link_ctes(STANDARD, STANDARD_RAWS)}, e AS (SELECT {norm('src_url')} AS src, dst_url AS dst FROM links), "
        "b(url, depth) AS (SELECT url, 0 FROM registry WHERE parent_url IS NULL UNION "
        "SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.url WHERE b.depth < (SELECT count(*) FROM registry)) "
        "SELECT url, min(depth) AS depth FROM b GROUP BY url"
    )
    o["registry_add"] = w("found", "registry", extra=FRESH) + (
        "SELECT url, depth, parent_url, crawl_status, is_dynamic FROM registry UNION ALL "
        "SELECT url, depth, parent_url, 'pending', is_dynamic FROM fresh"
    )
    o["registry_add_frontier"] = w("found", "registry", "frontier", extra=FRESH) + (
        "SELECT url, priority, is_processing FROM frontier UNION ALL SELECT url, priority, FALSE FROM fresh"
    )
    o["registry_mark_crawled"] = w("registry", "crawl_log", extra=LATEST_NORM) + (
        f"SELECT r.url, {applied('status_code')}, {NEW_STATUS}, {applied('error_message')}, {applied('response_time')}, "
        f"{iso('CASE WHEN l.url IS NOT NULL THEN l.fetched_at ELSE r.updated_at END')} AS updated_at "
        "FROM registry r LEFT JOIN latest l ON r.url = l.url"
    )
    skipped = f"SELECT {norm('url')} FROM site_pages WHERE NOT {html_type('content_type')}"
    o["registry_mark_skipped"] = w("registry", "site_pages") + (
        f"SELECT url, CASE WHEN url IN ({skipped}) THEN 'skipped' ELSE crawl_status END AS crawl_status, "
        f"CASE WHEN url IN ({skipped}) THEN 'not HTML' ELSE error_message END AS error_message FROM registry"
    )
    o["registry_claim"] = w("frontier") + (
        f"SELECT url, is_processing OR url IN (SELECT url FROM frontier WHERE NOT is_processing {order} LIMIT 25) "
        "AS is_processing FROM frontier"
    )
    o["registry_clear_processing"] = w("frontier") + "SELECT url, FALSE AS is_processing FROM frontier"
    a_round = (
        f"{pages_cte('registry', 'crawl_log', 'frontier')}, "
        f"{LATEST}, {link_ctes(STANDARD, STANDARD_RAWS)}, "
        "res AS (SELECT l.*, CAST(p.page_id % 6 AS INTEGER) AS depth FROM latest l JOIN site_pages p ON p.url = l.url), "
        f"cand AS (SELECT k.dst_url AS url, r.url AS parent_url, r.depth + 1 AS depth, r.fetched_at AS added_at, "
        f"{any_of('k.dst_url', STANDARD.dynamic)} AS is_dynamic FROM res r JOIN links k ON k.src_url = r.url WHERE r.depth < 5), "
        "fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY depth, added_at, parent_url) AS rn FROM cand) z "
        "WHERE rn = 1 AND url NOT IN (SELECT url FROM registry)), "
        f"marks AS (SELECT * EXCLUDE (rn2) FROM (SELECT {norm('url')} AS url, status_code, error_message, row_number() OVER "
        f"(PARTITION BY {norm('url')} ORDER BY fetched_at DESC, attempt_id DESC) AS rn2 FROM res) z WHERE rn2 = 1) "
    )
    o["process_results"] = a_round + (
        f"SELECT r.url, r.depth, r.parent_url, {NEW_STATUS}, {applied('status_code')}, r.is_dynamic "
        "FROM registry r LEFT JOIN marks l ON l.url = r.url UNION ALL "
        "SELECT url, depth, parent_url, 'pending', NULL, is_dynamic FROM fresh"
    )
    o["process_results_frontier"] = a_round + (
        "SELECT url, priority FROM frontier WHERE url NOT IN (SELECT url FROM marks) UNION ALL "
        "SELECT url, CAST(greatest(0, 100 - 10 * (depth - 1)) AS INTEGER) FROM fresh"
    )
    o["crawl_run"] = (
        f"WITH RECURSIVE {duckdb_with('site_pages', 'registry', 'crawl_log')}, {LATEST_NORM}, "
        f"m AS (SELECT url AS src_url, {stripped()} AS markup FROM site_pages), "
        f"{link_ctes(STANDARD, STANDARD_RAWS)}, e AS (SELECT {norm('src_url')} AS src, dst_url AS dst FROM links "
        f"WHERE {norm('src_url')} IN (SELECT url FROM latest)), "
        "b(url, depth) AS (SELECT url, 0 FROM registry WHERE parent_url IS NULL UNION "
        "SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.url WHERE b.depth < 5), "
        "d AS (SELECT url, min(depth) AS depth FROM b GROUP BY url) SELECT d.url, d.depth, "
        f"CASE WHEN l.url IS NULL THEN 'pending' ELSE {status('l.status_code', 'l.error_message')} END AS crawl_status, "
        "l.status_code FROM d LEFT JOIN latest l ON l.url = d.url"
    )
    o["crawl_run_final"] = (
        f"WITH RECURSIVE {duckdb_with('site_pages', 'crawl_log', 'locations', 'categories')}, gen_paths AS ({GEN_ALL}), "
        f"{LATEST_NORM.replace(norm('url'), norm_fast('url'))}, "
        f"m AS (SELECT url AS src_url, html, {stripped()} AS markup FROM site_pages), {link_ctes(FINAL, FINAL_RAWS)}, "
        f"e AS (SELECT {norm_fast('src_url')} AS src, dst_url AS dst FROM links WHERE {norm_fast('src_url')} IN "
        "(SELECT url FROM latest WHERE coalesce(error_message, '') = '')), "
        f"b(url, depth) AS (SELECT {q(FINAL.base_urls[0])}, 0 UNION SELECT {norm_fast('min(url)')}, 0 FROM site_pages "
        f"WHERE {target('url', FINAL)} UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.url WHERE b.depth < 4), "
        "d AS (SELECT url, min(depth) AS depth FROM b GROUP BY url) "
        "SELECT d.url, d.depth, l.status_code FROM d LEFT JOIN latest l ON l.url = d.url"
    )
    o["build_entries"] = w("registry", extra=CHUNKS) + "SELECT loc, lastmod, changefreq, priority FROM chunks"
    o["build_sitemap"] = w("registry", extra=CHUNKS) + "SELECT loc, lastmod, changefreq, priority, sitemap_no FROM chunks"

    # Streaming
    newer = (
        ", newer AS (SELECT l.* FROM latest l LEFT JOIN registry r ON r.url = l.url "
        "WHERE r.last_crawled IS NULL OR l.fetched_at > r.last_crawled)"
    )
    o["stream_registry"] = w("registry", "crawl_log", extra=LATEST_NORM + newer) + (
        f"SELECT coalesce(r.url, l.url) AS url, coalesce(r.depth, 0) AS depth, {NEW_STATUS}, {applied('status_code')}, "
        f"{applied('error_message')}, {applied('response_time')}, {iso('coalesce(r.discovered_at, s.first_at)')} AS discovered_at, "
        f"{iso('CASE WHEN l.url IS NOT NULL THEN l.fetched_at ELSE r.updated_at END')} AS updated_at "
        "FROM registry r FULL JOIN newer l ON r.url = l.url LEFT JOIN (SELECT url, min(fetched_at) AS first_at FROM clog GROUP BY url) s "
        "ON s.url = l.url"
    )
    o["stream_new_urls"] = w("crawl_log") + f"SELECT DISTINCT {norm('url')} AS url FROM crawl_log"
    o["stream_pattern_first"] = w("crawl_log") + (
        f"SELECT {pattern('url')} AS pattern, min(url) AS url FROM crawl_log GROUP BY 1"
    )
    o["stream_progress"] = w("crawl_log") + (
        f"SELECT {iso('h')} AS window_start, crawled, succeeded, CAST(succeeded AS DOUBLE) / crawled * 100 AS success_rate FROM ("
        f"SELECT date_trunc('hour', fetched_at) AS h, count(*) AS crawled, count(*) FILTER (WHERE {status('status_code', 'error_message')} "
        "= 'success') AS succeeded FROM crawl_log GROUP BY 1) z"
    )
    o["stream_progress_closed"] = w("crawl_log") + (
        f"SELECT {iso('h')} AS window_start, crawled, succeeded FROM ("
        f"SELECT date_trunc('hour', fetched_at) AS h, count(*) AS crawled, count(*) FILTER (WHERE {status('status_code', 'error_message')} "
        "= 'success') AS succeeded FROM crawl_log GROUP BY 1) z "
        "WHERE h + INTERVAL 1 HOUR <= (SELECT max(fetched_at) FROM crawl_log) - INTERVAL 1 HOUR"
    )
    return o
