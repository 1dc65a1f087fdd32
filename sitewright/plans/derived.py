"""Input tables derived from the given ones, in SQL that Spark and DuckDB share.

The given pages only hold plain anchors on many hosts, so these views add the
markup, fetch outcomes and robots lines the operators work on. Every table grows
with the given tables. ``NAME(sources)`` texts use ``{table}`` placeholders; ``{n}``
is the number of pages.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession


def site_url(i: str, normalized: bool = False) -> str:
    """SQL for the URL of page number ``i`` on one of five sites."""
    tails = (
        ("", "", ".html", "?page=2&ref=x", "", "?a=1&b=2")
        if normalized
        else ("", "/", ".html", "?page=2&ref=x", "#top", "?b=2&a=1")
    )
    hosts = (
        "https://www.example.com", "https://example.com", "https://www.example.org",
        "http://example.org", "https://blog.example.net",
    )
    paths = ("/p", "/jobs/", "/blog/", "/company/", "/category/", "/banking-jobs-in-", "/jobs/list-")
    cases = [
        f"CASE {i} % {len(v)} "
        + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(v))
        + " END"
        for v in (hosts, paths, tails)
    ]
    return f"({cases[0]} || {cases[1]} || CAST({i} AS STRING) || {cases[2]})"


def _s(expr: str) -> str:
    return f"' || CAST({expr} AS STRING) || '"


MARKUP = (
    "'<meta name=\"description\" content=\"Page " + _s("page_id") + " &amp; more\">"
    "<meta name=\"last-modified\" content=\"2024-01-" + _s("page_id % 28 + 1") + "\">"
    "<link rel=\"canonical\" href=\"' || url || '\"><link rel=\"alternate home\" href=\" /alt/"
    + _s("page_id") + " \"><link rel=\"stylesheet\" href=\"/s.css\">"
    "<link rel=\"next\" href=\"/list/" + _s("page_id + 1") + "/\">"
    "<map><area href=\"/map/" + _s("page_id % 50") + "\"></map><area href=\"#x\">"
    "<form action=\"/search\" method=\"GET\"><select name=\"job_location\">"
    "<option value=\"0\">-</option><option value=\"all\">any</option>"
    "<option value=\"new-york\">x</option><option value=\"leeds\">y</option></select>"
    "<select name=\"sector\"><option value=\"retail banking\">z</option></select>"
    "<select name=\"contract_type\"><option value=\"part-time\">p</option></select>"
    "<select><option value=\"c" + _s("page_id % 7") + "\">c</option></select></form>"
    "<form action=\"/login\" method=\"post\"></form><form action=\" /find \"></form>"
    "<select name=\"city\"><option value=\"los-angeles\">l</option></select>"
    "<a data-url=\"/d/" + _s("page_id % 5") + "\" href=\"#x\">z</a>"
    "<div data-href=\"/dh/" + _s("page_id % 3") + "\" data-location=\" old-town \">t</div>"
    "<a href=''?b=2&amp;a=1''>q</a><a href=\"../up/./x/\">u</a><a href=\"mailto:a@b.c\">m</a>"
    "<a rel=\"next\" href=\"/page/" + _s("page_id") + "/\">2</a>"
    "<nav class=\"pagination big\"><ul><li><a href=\"/l?page=1\">1</a></li></ul><div><div><a href=\"/l?page=2\">2</a>"
    "</div></div><a href=\"/l?page=3\">3</a><section><a href=\"/l?page=4\">go</a></section><a>5</a>"
    "<a href=\"/l?page=6\">further</a></nav><a href=\"/l?page=7\">outside</a>"
    "<span class=\"pager\"><i><a href=\"/older/" + _s("page_id % 6") + "\">Older</a></i><a href=\"/oldest\">Oldest</a></span>"
    "<a class=\"btn next-page\" href=\"/np/" + _s("page_id") + "\">more</a>"
    "<span data-page=\"3\" href=\"/dp/3\">3</span><a href=\"/n" + _s("page_id % 4") + "\"> NEXT </a>"
    "<a href=\"/company/" + _s("page_id % 20") + "\">City <b>x</b> Bank</a>"
    "<a href=\"/employer/" + _s("page_id % 7") + "\">Acme</a>"
    "<a href=\"/brochure/" + _s("page_id") + ".PDF\">b</a>"
    "<script>var u = \"/api/jobs/" + _s("page_id % 9") + "\"; var o = ( url: \"/go/"
    + _s("page_id") + "\", href: ''http://www.example.com/js/" + _s("page_id % 4")
    + "'' ); window.location = \"/wl\";</script>"
    "<!-- <a href=\"/hidden\">h</a> -->"
    "<a href=\"' || " + site_url("(2 * page_id + 1)") + " || '\">n1</a>"
    "<a href=\"' || " + site_url("(2 * page_id + 2)") + " || '\">n2</a>"
    "<a href=\"' || " + site_url("((3 * page_id + 7) % {n})") + " || '\">n3</a>'"
    " || CASE page_id % 3 WHEN 0 THEN '<main class=\"x\">Main <div>one <div>two</div></div>"
    "<section>three</section> <i>text</i> " + _s("page_id") + "</main>' WHEN 1 THEN '<div class=\"content wide\">"
    "Content &amp; more <div>deep</div><section>er</section> " + _s("page_id") + "</div>' ELSE '' END"
)

#: Start tags of the anchors inside the containers of MARKUP, as SQL lists.
CONTAINED = {
    "pagination": "['<a href=\"/l?page=1\">', '<a href=\"/l?page=2\">', '<a href=\"/l?page=3\">', '<a href=\"/l?page=4\">', "
    "'<a>', '<a href=\"/l?page=6\">']",
    "pager": "['<a href=\"/older/" + _s("page_id % 6") + "\">', '<a href=\"/oldest\">']",
}
#: Text of the main container of MARKUP.
MAIN_TEXT = (
    "CASE page_id % 3 WHEN 0 THEN 'Main one twothree text " + _s("page_id") + "' "
    "WHEN 1 THEN 'Content & more deeper " + _s("page_id") + "' END"
)

SITE_PAGES = (
    "SELECT page_id, url, html || " + MARKUP + " AS html, "
    "CASE page_id % 7 WHEN 0 THEN 'application/pdf' WHEN 1 THEN '' "
    "WHEN 2 THEN 'application/xhtml+xml' WHEN 3 THEN 'TEXT/HTML' "
    "ELSE ' text/html ; charset=utf-8' END AS content_type "
    "FROM (SELECT page_id, html, " + site_url("page_id") + " AS url FROM {pages}) p"
)

CRAWL_LOG = """
SELECT e.event_id AS attempt_id, p.url, e.ts AS fetched_at,
  CASE WHEN e.event_type = 'error' THEN CASE e.event_id % 3 WHEN 0 THEN 404 WHEN 1 THEN 500 ELSE 0 END
       WHEN e.event_type = 'signup' THEN 301 ELSE 200 END AS status_code,
  CASE e.event_id % 7 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/html; charset=utf-8'
       ELSE 'TEXT/HTML' END AS content_type,
  CASE WHEN e.event_type = 'error' AND e.event_id % 3 = 2 THEN 'timeout'
       WHEN e.event_id % 11 = 0 THEN '' END AS error_message,
  (e.event_type IN ('click', 'purchase')) AS is_dynamic, e.value / 100 AS response_time
FROM (SELECT ev.event_id, ev.ts, ev.event_type, ev.value, ev.event_id % {n} AS pid FROM {events} ev) e
JOIN {site_pages} p ON p.page_id = e.pid
"""

REGISTRY = (
    "SELECT page_id, " + site_url("page_id", True) + " AS url, "
    "TIMESTAMP '2024-01-01 00:00:00' + page_id * INTERVAL '1' MINUTE AS discovered_at, "
    "CASE WHEN s IN ('success', 'error') THEN TIMESTAMP '2024-02-01 00:00:00' "
    "+ page_id * INTERVAL '37' SECOND END AS last_crawled, "
    "CASE WHEN s IN ('success', 'error') THEN CASE page_id % 8 WHEN 3 THEN 301 WHEN 5 THEN 404 "
    "WHEN 6 THEN 500 WHEN 7 THEN 0 ELSE 200 END END AS status_code, "
    "CASE WHEN s IN ('success', 'error') THEN 'text/html' END AS content_type, "
    "(page_id % 3 = 0) AS is_dynamic, CAST(page_id % 6 AS INT) AS depth, "
    "CASE WHEN page_id > 0 THEN " + site_url("CAST((page_id - 1 - (page_id - 1) % 2) / 2 AS BIGINT)", True)
    + " END AS parent_url, s AS crawl_status, "
    "CASE WHEN s = 'error' AND page_id % 8 = 7 THEN 'timeout' END AS error_message, "
    "CASE WHEN s IN ('success', 'error') THEN CAST(page_id AS DOUBLE) / 100 END AS response_time, "
    "CASE WHEN s <> 'pending' THEN TIMESTAMP '2024-02-01 00:00:00' END AS updated_at "
    "FROM (SELECT page_id, CASE WHEN page_id % 10 = 7 THEN 'skipped' WHEN page_id % 10 = 9 THEN 'pending' "
    "WHEN page_id % 8 IN (5, 6, 7) THEN 'error' ELSE 'success' END AS s FROM {pages}) p"
)

FRONTIER = (
    "SELECT url, CAST(100 - 10 * (page_id % 4) AS INT) AS priority, "
    "TIMESTAMP '2024-01-01 00:00:00' + (page_id % 17) * INTERVAL '1' HOUR AS added_at, "
    "(page_id % 9 = 0) AS is_processing FROM {registry} "
    "WHERE crawl_status = 'pending' OR page_id % 5 <> 1"
)

# Of the pages found, every other one is numbered beyond the given pages, so no registry row has it.
FOUND = (
    "SELECT 3 * page_id AS pos, " + site_url("(page_id + page_id % 2 * {n})") + " || CASE WHEN page_id % 6 = 0 THEN '#f' "
    "ELSE '' END AS url, " + site_url("(page_id % 10)", True) + " AS parent_url, "
    "CAST(page_id % 5 AS INT) AS depth, (page_id % 2 = 0) AS is_dynamic, "
    "CAST(100 - 10 * (page_id % 5) AS INT) AS priority, "
    "TIMESTAMP '2024-03-01 00:00:00' + (page_id % 100) * INTERVAL '1' MINUTE AS added_at FROM {pages} "
    "UNION ALL SELECT 3 * page_id + 1, 'https://www.example.com/jobs/' || CAST(page_id % 40 AS STRING) "
    "|| CASE WHEN page_id % 2 = 0 THEN '/' ELSE '' END, " + site_url("(page_id % 15)", True)
    + ", CAST(page_id % 4 AS INT), TRUE, 50, "
    "TIMESTAMP '2024-03-01 00:00:00' + (page_id % 50) * INTERVAL '1' MINUTE FROM {pages} "
    "UNION ALL SELECT 3 * page_id + 2, CASE page_id % 3 WHEN 0 THEN 'invalid-url' WHEN 1 THEN 'ftp://h/x' "
    "ELSE 'https://example.com/a?z=1&y=' || CAST(page_id % 9 AS STRING) || '&y=a+b%20c' END, "
    + site_url("(page_id % 12)", True) + ", CAST(page_id % 3 AS INT), FALSE, 10, "
    "TIMESTAMP '2024-03-01 00:00:00' + (page_id % 70) * INTERVAL '1' MINUTE FROM {pages}"
)

JOB_URLS = """
SELECT c_custkey AS id, 'https://www.example.com' || CASE c_custkey % 13 WHEN 0 THEN '' WHEN 1 THEN '/jobs-in-' || loc
  WHEN 2 THEN '/' || cat || '-jobs-in-' || loc
  WHEN 3 THEN '/browse-jobs?category=' || cat || '&location=' || loc
  WHEN 4 THEN '/jobs/' || cat WHEN 5 THEN '/jobs/' || CAST(c_custkey AS STRING)
  WHEN 6 THEN '/company/' || cat WHEN 7 THEN '/blog/' || loc WHEN 8 THEN '/Category/' || cat
  WHEN 9 THEN '/brochure/' || loc || '.PDF' WHEN 10 THEN '/browse-jobs' || CASE WHEN c_custkey % 2 = 0
    THEN '?location=' || loc || '&category=' ELSE '' END
  WHEN 11 THEN '/search?category=' || cat ELSE '/about/' || cat || '/' END AS url
FROM (SELECT c.c_custkey, lower(n.n_name) AS loc, lower(c.c_mktsegment) AS cat
      FROM {customer} c JOIN {nation} n ON n.n_nationkey = c.c_nationkey) x
"""

REFERENCES = ("//h/p", "?q", "#f", "../..", "../../../x", "./y/", "x//y//", "/", "/a//b/",
              "?b=2&a=1&a=0", "?a&b=&=c&&d=%41", "?q=a+b%20c~*", "?x=%C3%A9", "/a b/?c d=e", "..",
              "../g/../h/.", "/./g/..", "/x.pdf?y", "x/?/", "http://other.com/z/", "HTTP://Up.COM/p",
              "g;x=1", "mailto:a@b.c")

URL_CASES = (
    "SELECT page_id, url AS base, CASE page_id % " + str(len(REFERENCES)) + " "
    + " ".join(f"WHEN {k} THEN '{r}'" for k, r in enumerate(REFERENCES))
    + " END AS ref FROM {pages}"
)

LINK_EDGES = """
SELECT page_id AS src, 2 * page_id + 1 AS dst FROM {pages} WHERE 2 * page_id + 1 < {n}
UNION SELECT page_id, 2 * page_id + 2 FROM {pages} WHERE 2 * page_id + 2 < {n}
UNION SELECT page_id, (3 * page_id + 7) % {n} FROM {pages}
"""

SNAPSHOTS = (
    "SELECT url, step, '<a href=\"/n/" + _s("page_id") + "/0\">0</a><area href=\"../m\">' "
    "|| CASE WHEN step >= 1 AND page_id % 4 >= 1 THEN '<a href=\"/n/" + _s("page_id") + "/1\">1</a>' ELSE '' END "
    "|| CASE WHEN step >= 2 AND page_id % 4 >= 2 THEN '<a href=\"/n/" + _s("page_id") + "/2\">x</a>' ELSE '' END "
    "|| CASE WHEN step >= 3 AND page_id % 4 >= 3 THEN '<a href=\"/n/" + _s("page_id") + "/3\">x</a>' ELSE '' END "
    "|| CASE WHEN step >= 4 THEN '<a href=\"/late/" + _s("page_id") + "\">x</a>' ELSE '' END "
    "|| CASE WHEN step >= 2 THEN '<span data-page=\"2\" href=\"/turn/" + _s("page_id") + "\">2</span>' ELSE '' END "
    "|| CASE WHEN step = 3 THEN '<i data-link=\"/data/" + _s("page_id") + "\"></i>' ELSE '' END "
    "|| CASE WHEN step = 1 THEN '<select name=\"sector\"><option value=\"late\">l</option></select>' ELSE '' END "
    "|| CASE WHEN step = 0 THEN '<select name=\"city\"><option value=\"los-angeles\">l</option></select>' ELSE '' END "
    "AS html FROM (SELECT page_id, " + site_url("page_id") + " AS url, {steps} AS step FROM {pages}) p"
)

ROBOTS_LINES = (
    "SELECT CASE page_id % 5 WHEN 0 THEN 'www.example.com' WHEN 1 THEN 'example.com' "
    "WHEN 2 THEN 'www.example.org' WHEN 3 THEN 'example.org' ELSE 'other.example.net' END AS host, "
    "page_id AS line_no, CASE CAST(page_id - page_id % 5 AS BIGINT) % 12 "
    "WHEN 0 THEN CASE WHEN page_id % 2 = 0 THEN 'User-agent: *' ELSE 'user-agent: SiteBot' END "
    "WHEN 1 THEN 'Disallow: /jobs/' || CAST(page_id % 9 AS STRING) "
    "WHEN 2 THEN 'Allow: /p' || CAST(page_id % 10 AS STRING) || ' # note: x' "
    "WHEN 3 THEN CASE WHEN page_id % 4 = 0 THEN '' ELSE '# comment: only' END "
    "WHEN 4 THEN 'Disallow: /company/' WHEN 5 THEN 'Disallow: /blog/' || CAST(page_id % 10 AS STRING) "
    "WHEN 6 THEN 'Sitemap: https://www.example.com/sm' || CAST(page_id AS STRING) || '.xml' "
    "WHEN 7 THEN 'Disallow: *x' WHEN 8 THEN 'Allow: /company/' || CAST(page_id % 10 AS STRING) "
    "WHEN 9 THEN 'Crawl-delay: 2' WHEN 10 THEN 'Disallow: /category/%' || '3' || CAST(page_id % 10 AS STRING) "
    "ELSE 'Disallow: /p' END AS line FROM {pages}"
)

ROBOTS_FETCHES = (
    "SELECT DISTINCT CASE page_id % 6 WHEN 0 THEN 'www.example.com' WHEN 1 THEN 'example.com' "
    "WHEN 2 THEN 'www.example.org' WHEN 3 THEN 'example.org' WHEN 4 THEN 'blog.example.net' ELSE 'other.example.net' END AS host, "
    "CASE page_id % 6 WHEN 2 THEN 403 WHEN 3 THEN 404 WHEN 4 THEN 503 WHEN 5 THEN 0 ELSE 200 END AS status_code FROM {pages}"
)

# Files of sitemaps as they lie below a folder of hosts: at the usual place, in an index of an index, where
# robots lines may say, and where nothing leads to.
SITE_MAPS = (
    "SELECT CASE page_id % 4 WHEN 0 THEN host || '/sitemap.xml' WHEN 1 THEN host || '/maps/a' || CAST(page_id % 3 AS STRING) || '.xml' "
    "WHEN 2 THEN 'www.example.com/sm' || CAST(page_id AS STRING) || '.xml' ELSE host || '/hidden.xml' END AS file, url AS loc "
    "FROM (SELECT page_id, url, CASE page_id % 5 WHEN 0 THEN 'www.example.com' WHEN 1 THEN 'example.com' WHEN 2 THEN 'www.example.org' "
    "WHEN 3 THEN 'example.org' ELSE 'blog.example.net' END AS host FROM {registry} WHERE crawl_status = 'success') r"
)
SITE_INDEXES = (
    "SELECT DISTINCT substr(file, 1, position('/' IN file)) || CASE page_id % 2 WHEN 0 THEN 'wp-sitemap.xml' ELSE 'maps/all.xml' END AS file, "
    "'https://' || substr(file, 1, position('/' IN file)) || 'maps/' || CASE WHEN page_id % 2 = 0 THEN 'all' "
    "ELSE 'a' || CAST(page_id % 3 AS STRING) END || '.xml' AS loc "
    "FROM {site_maps} m CROSS JOIN (SELECT 0 AS page_id UNION ALL SELECT 1 UNION ALL SELECT 3 UNION ALL SELECT 5) k "
    "WHERE file LIKE '%/sitemap.xml'"
)
# Every host of the corpus, one site a registered name, under one of two rule sets.
SITES = (
    "SELECT host, regexp_replace(host, '^(www|m|blog|shop)[.]', '') AS site, "
    "CASE WHEN length(regexp_replace(host, '^(www|m|blog|shop)[.]', '')) % 2 = 0 THEN 'standard' ELSE 'fast' END AS rules FROM ("
    "SELECT DISTINCT lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host FROM {pages} "
    "UNION SELECT DISTINCT lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) FROM {site_pages}) h"
)
HOME_PAGES = (
    "SELECT page_id, 'https://h' || CAST(page_id AS STRING) || '.example.net' || CASE page_id % 4 "
    "WHEN 0 THEN '' WHEN 1 THEN '/' WHEN 2 THEN '/?q=1' ELSE '/about' END AS url, html FROM {site_pages}"
)

API_PROBES = (
    "SELECT url || CASE page_id % 4 WHEN 0 THEN '/api/jobs' WHEN 1 THEN '/api/search' "
    "WHEN 2 THEN '/ajax/jobs' ELSE '/api/other' END AS url, "
    "CAST(CASE WHEN page_id % 5 = 0 THEN 404 ELSE 200 END AS INT) AS status_code, "
    "CASE WHEN page_id % 3 = 0 THEN 'text/html' ELSE 'application/json; charset=utf-8' END AS content_type "
    "FROM (SELECT page_id, 'https://h' || CAST(page_id % 50 AS STRING) || '.example.net' AS url FROM {pages}) p"
)

SEARCH_PAGES = (
    "SELECT page_id, 'https://h' || CAST(page_id AS STRING) || '.example.net' || CASE page_id % 5 "
    "WHEN 0 THEN '/search' WHEN 1 THEN '/jobs' WHEN 2 THEN '/find-jobs' WHEN 3 THEN '/job-search' "
    "ELSE '/about' END AS url, html FROM {site_pages}"
)

LOCATIONS = "SELECT n_nationkey AS pos, lower(n_name) AS value FROM {nation}"
CATEGORIES = (
    "SELECT row_number() OVER (ORDER BY value) AS pos, value "
    "FROM (SELECT DISTINCT lower(c_mktsegment) AS value FROM {customer}) s"
)

# Derived tables in an order that has every source before its use.
TEXTS = {
    "site_pages": SITE_PAGES,
    "crawl_log": CRAWL_LOG,
    "registry": REGISTRY,
    "frontier": FRONTIER,
    "found": FOUND,
    "job_urls": JOB_URLS,
    "url_cases": URL_CASES,
    "link_edges": LINK_EDGES,
    "snapshots": SNAPSHOTS,
    "robots_lines": ROBOTS_LINES,
    "robots_fetches": ROBOTS_FETCHES,
    "site_maps": SITE_MAPS,
    "site_indexes": SITE_INDEXES,
    "home_pages": HOME_PAGES,
    "sites": SITES,
    "api_probes": API_PROBES,
    "search_pages": SEARCH_PAGES,
    "locations": LOCATIONS,
    "categories": CATEGORIES,
}
GIVEN = ("pages", "events", "nation", "customer")


def sources_of(text: str) -> list[str]:
    return [t for t in (*GIVEN, *TEXTS) if "{" + t + "}" in text]


def duckdb_with(*names: str) -> str:
    """A WITH clause that defines the named derived tables for DuckDB."""
    wanted: list[str] = []

    def need(name: str) -> None:
        for s in sources_of(TEXTS[name]):
            if s in TEXTS:
                need(s)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        need(name)
    values = {t: t for t in (*GIVEN, *TEXTS)}
    values |= {"n": "(SELECT count(*) FROM pages)", "steps": "CAST(unnest(generate_series(0, 4)) AS INTEGER)"}
    return ", ".join(f"{name} AS ({TEXTS[name].format(**values)})" for name in wanted)


class Inputs:
    """The given and derived tables of one data folder, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    @cached_property
    def page_count(self) -> int:
        """From the parquet footers: no data is read."""
        return self.given("pages").count()

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def derived(self, name: str) -> DataFrame:
        text = TEXTS[name]
        tables = {s: self[s] for s in sources_of(text)}
        keys = {s: "{" + s + "}" for s in tables}
        text = text.format(
            **keys,
            n=self.page_count if "{n}" in text else "",
            steps="explode(sequence(0, 4))",
        )
        return self.spark.sql(text, **tables)

    def __getitem__(self, name: str) -> DataFrame:
        return self.derived(name) if name in TEXTS else self.given(name)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TEXTS or name in GIVEN:
            return self[name]
        raise AttributeError(name)
