from pyspark.sql import functions as F

from sitewright.functions import html as H
from sitewright.operators import generate as G
from sitewright.operators import links as L
from sitewright.operators import snapshots as N
from sitewright.rules import FAST, FINAL, STANDARD
from sitewright.sources.tables import scan_pages

SITE = "https://www.example.com"


def pages(spark, *htmls, url=SITE + "/start"):
    rows = [(i, f"{url}{i or ''}", h) for i, h in enumerate(htmls)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def dsts(df):
    return sorted(r.dst_url for r in df.collect())


def raws(df):
    return sorted(r.raw for r in df.collect())


def test_only_own_links(spark):
    html = '<a href="/page1">1</a><a href="/page2">2</a><a href="https://external.com/page">x</a>'
    assert dsts(L.extract_links(pages(spark, html))) == [SITE + "/page1", SITE + "/page2"]


def test_anchor_rules(spark):
    html = (
        "<A HREF = '/up'>x</A><a href=/bare>x</a><a href=\" /pad \">x</a><a href='#x'>x</a>"
        "<a href='mailto:a@b'>x</a><a href='JavaScript:x'>x</a><a data-href='/no'>x</a><abbr href='/no'>"
        "<!-- <a href='/hidden'>x</a> --><script>'<a href=\"/js\">'</script>"
        "<a href='/e?a=1&amp;b=&#x41;&#66;&quot;'>x</a><a href=''>x</a>"
    )
    assert raws(L.links_anchor(pages(spark, html))) == [
        "/bare", '/e?a=1&b=AB"', "/pad", "/up", "JavaScript:x"]


def test_rel_area_form(spark):
    html = (
        "<link rel='shortcut canonical' href='/c'><link rel='stylesheet' href='/s'>"
        "<link rel=next href='/n'><area href='/a'><area href='#q'>"
        "<form action='/get'></form><form method='POST' action='/post'></form>"
        "<form method='Get' action=' /g2 '></form><form method='' action='/none'></form>"
    )
    p = pages(spark, html)
    assert raws(L.links_rel(p, STANDARD)) == ["/c", "/n"]
    assert raws(L.links_rel(p, FAST)) == ["/c"]
    assert raws(L.links_area(p)) == ["/a"]
    assert raws(L.links_form(p)) == ["/g2", "/get"]
    assert raws(L.links_form(p, any_method=True)) == [" /g2 ", "/get", "/none", "/post"]


def test_data_attributes(spark):
    html = "<i data-url='' data-href='/h' data-link='/l'></i><b data-location=' x y '></b><u data-url='/u'></u>"
    p = pages(spark, html)
    assert raws(L.links_data_attr(p)) == ["/h", "/u"]
    assert raws(L.links_data_location(p)) == ["/jobs-in-x y"]


def test_script_urls(spark):
    html = (
        "<script>var a = \"/api/jobs\", b = 'search-me'; o = {url: '/u1', href : \"http://www.example.com/h1\"};"
        " window.location = '/w1'; c = 'https://other.com/jobs'</script>"
    )
    assert dsts(L.links_script(pages(spark, html))) == [
        "http://www.example.com/h1", SITE + "/api/jobs", SITE + "/u1", SITE + "/w1"]


def test_pagination(spark):
    anchors = "".join(f"<a href='/l?page={i}'>p</a>" for i in range(1, 8))
    html = (
        f"<nav class='x pagination'>{anchors}</nav><nav class='pagination-info'><a href='/no'>n</a></nav>"
        "<a rel='next' href='/nx'>go</a><a href='/12'> <b>12</b> </a><a href='/pv'>Prev</a>"
        "<a href='/ar'>→</a><i class='next-page' href='/i'></i><i data-page='1'></i>"
    )
    p = pages(spark, html)
    assert raws(L.links_pagination(p)) == sorted(
        [f"/l?page={i}" for i in range(1, 8)] + ["/nx", "/12", "/pv", "/ar", "/i"])
    assert raws(L.links_pagination_top(p)) == sorted([f"/l?page={i}" for i in range(1, 6)] + ["/nx"])


def test_containers_end_at_their_own_tag(spark):
    html = [
        "<div class='content'><div>one</div>two</div>three",
        "<section id=content><p>a<div>b</section>c",
        "<main/>x<body>y</body>",
        "<div class='a content-x'><b>n</b></div><body>z</body>",
        "<title><div class=main></title><body>q <div class='x main'>w<br>v<img src='a>b'></b>u",
        "<div class='main' title='</div>'>in</div>out",
        "<p><div class=content>left <div>open</p> end",
        "<main></main><body>not this</body>",
    ]
    text = {r.page_id: r.content for r in L.page_text(pages(spark, *html)).collect()}
    assert [text[i] for i in range(len(html))] == ["onetwo", "ab", "y", "z", "wvu", "in", "left open", ""]
    html = (
        "<div class='pagination'><ul><li><a href=/1>x</a></li></ul><div class=pager><a href=/2>y</a></div><a href=/3>y</a></div>"
        "<a href=/no>z</a><span class='pager'><i><a href=/4>w</a></i></span><a href=/not>k</a>"
        "<ul class='x pagination'><li><a href=/5>q</a><li><a href=/6>q</a></ul><a href=/nor>r</a>"
    )
    assert raws(L.links_pagination(pages(spark, html))) == [f"/{i}" for i in range(1, 7)]
    assert raws(L.links_pagination_top(pages(spark, html))) == [f"/{i}" for i in range(1, 7)]


def test_tokens_are_the_page(spark):
    from pyspark.sql import functions as F
    from sitewright.functions import tree

    html = ["a<b", "<div class='x", "<!doctype html><p>1 < 2 <3</p>", "<textarea><p></textarea>", "", "</x></ y>", "<a href='>'>t</a>"]
    rows = pages(spark, *html).select("html", tree.tokens(F.col("html")).alias("t")).collect()
    assert all("".join(r.t) == r.html for r in rows)


def test_company(spark):
    html = (
        "<a href='/company/1'>Big Bank</a><a href='/company/2'><b>Bank</b></a>"
        "<a href='/employer/3'>Fund</a><a href='/x'>bank</a><a href='/company/4'>Banking</a>"
    )
    assert raws(L.links_company(pages(spark, html))) == ["/company/1", "/employer/3"]


SELECTS = (
    "<form><select name='Job_City'><option value='0'>-</option><option value='all'>a</option>"
    "<option value=' new-york '>n</option><option>none</option><option value='leeds'>l</option></select>"
    "<select name='industry'><option value='it'>i</option></select></form>"
    "<select name='location'><option value='out-side'>o</option><option value='all-x'>a</option></select>"
)


def test_select_variants(spark):
    p = pages(spark, SELECTS)
    assert raws(L.links_select(p, "final")) == sorted([
        "/jobs-in-new-york", "/browse-jobs?location=new-york", "/jobs-in-leeds",
        "/browse-jobs?location=leeds", "/it-jobs", "/browse-jobs?category=it"])
    assert raws(L.links_select(p, "fast")) == ["/jobs-in-new-york", "/new-york-jobs"]
    assert raws(L.links_select(p, "rendered")) == sorted([
        "/jobs-in-out-side", "/out-side-jobs", "/jobs-in-all-x", "/all-x-jobs", "/it-jobs"])


def test_search_options(spark):
    df = spark.createDataFrame(
        [(0, SITE + "/search", SELECTS + "<form><select><option value='a b'>x</select></form>"),
         (1, SITE + "/other", SELECTS)],
        "page_id bigint, url string, html string")
    got = dsts(L.search_option_urls(df))
    assert SITE + "/search?q=a+b" in got and SITE + "/search?industry=it" in got
    assert SITE + "/search?Job_City=+new-york+" in got
    assert all(u.startswith(SITE + "/search?") for u in got) and len(got) == 4


def test_extract_variants_differ(spark):
    html = "<area href='/area'><form action='/find'></form><i data-location='x'></i><link rel=next href='/n'>" + SELECTS
    p = pages(spark, html)
    assert dsts(L.extract_links(p, STANDARD)) == [SITE + "/area", SITE + "/n"]
    fast = dsts(L.extract_links(p, FAST))
    assert SITE + "/find" in fast and SITE + "/jobs-in-x" in fast and SITE + "/area" not in fast
    d = G.literal_dimensions(spark, ["leeds"], ["banking", "risk"])
    final = dsts(L.extract_links(p, FINAL, d))
    assert SITE + "/banking-jobs-in-leeds" in final and SITE + "/jobs?salary=100k+" in final
    assert SITE + "/it-jobs" in final and len(final) == len(set(final))
    off_site = pages(spark, html, url="https://elsewhere.net/start")
    assert dsts(L.extract_links(off_site, FINAL, d)) == []


def test_page_does_not_link_to_itself(spark):
    html = "<a href='/start/'>s</a><a href='?'>s</a><a href='/other'>o</a>"
    assert dsts(L.extract_links(pages(spark, html))) == [SITE + "/other"]


def test_metadata_text_density(spark):
    html = (
        "<html lang='fr'><head><title> A &amp; B </title><meta content='d' name='description'>"
        "<link rel='canonical' href='/c'></head><body><style>x</style><div id=main>In <b>here</b></div>"
        "<a href='/x'>l</a></body></html>"
    )
    p = pages(spark, html, "<body>plain <i>text</i></body>", "")
    meta = {r.page_id: r for r in L.page_metadata(p).collect()}
    assert (meta[0].title, meta[0].description, meta[0].canonical, meta[0].language, meta[0].last_modified) == (
        "A & B", "d", "/c", "fr", "")
    assert meta[2].title == "" and meta[2].description == ""
    text = {r.page_id: r.content for r in L.page_text(p).collect()}
    assert text == {0: "In here", 1: "plain text", 2: ""}
    density = {r.page_id: r.link_density for r in L.link_density(p).collect()}
    assert density[0] == 1.0 and density[2] == 0.0
    big = pages(spark, "<a href='/x'>l</a>" * 100 + "y" * 3000)
    want = 100 / ((18 * 100 + 3000) / 1024)
    assert abs(L.link_density(big).first().link_density - want) < 1e-9


def test_scan_pages_keeps_whole_bodies(spark):
    long = "x" * 1_000_010
    df = spark.createDataFrame(
        [(0, "u", long, "text/html"), (1, "u", "abc", "image/png"), (2, "u", "abc", None)],
        "page_id bigint, url string, html string, content_type string")
    whole = {r.page_id: len(r.html) for r in scan_pages(df).collect()}
    cut = {r.page_id: len(r.html) for r in scan_pages(df, body_limit=1_000_000).collect()}
    assert whole == {0: 1_000_010, 1: 0, 2: 0} and cut == {0: 1_000_000, 1: 0, 2: 0}


def test_extraction_is_one_narrow_stage(spark):
    plan = L.extract_links(pages(spark, "<a href='/x'>"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_entities(spark):
    texts = {
        "a&#233;&#x20AC;&amp;lt;&#0;&bogus;": "aé€&lt;�&bogus;",
        "&#38;lt;&amp;#65;&lt;&AMP;": "&lt;&#65;<&",
        "x&y": "x&y",
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.u for r in df.select("t", H.unescape(F.col("t")).alias("u")).collect()}
    assert got == texts


def snapshots(spark, url, sizes):
    return [
        (url, s, "".join(f"<a href='/i{k}'>x</a>" for k in range(n))) for s, n in enumerate(sizes)
    ]


def test_snapshot_delta(spark, no_broadcast):
    rows = snapshots(spark, SITE + "/a", [2, 3, 3, 5]) + snapshots(spark, SITE + "/b", [1, 2, 4, 4])
    df = spark.createDataFrame(rows, "url string, step int, html string")
    for hot in (1, 10**6):
        got = sorted((r.url[-1], r.step, r.dst_url[-2:]) for r in N.snapshot_delta(df, hot_rows=hot).collect())
        assert got == [("a", 1, "i2"), ("b", 1, "i1"), ("b", 2, "i2"), ("b", 2, "i3")]
    clicks = N.snapshot_delta(df, stop_on_empty=False)
    assert clicks.filter("url like '%/a' and step = 3").count() == 2
    links = N.extract_links_rendered(df).filter(F.col("src_url") == SITE + "/a")
    assert dsts(links) == [f"{SITE}/i{k}" for k in range(5)]


def test_tags_and_attributes_are_read_as_browsers_do(spark):
    html = (
        """<a title="see href=/wrong now" href="/right">x</a><a class="b"href="/close">x</a><a title="a>b" href="/gt">x</a>"""
        """<a title='it"s' HREF=/plain>x</a><a data-x="href='/no'" href = '/spaced'>x</a><a href="/first" href="/second">x</a><a/href="/slash">x</a>"""
    )
    assert raws(L.links_anchor(pages(spark, html))) == sorted(["/right", "/close", "/gt", "/plain", "/spaced", "/first", "/slash"])
    found = L.links_data_attr(pages(spark, """<div title="data-url=/no" data-url="/yes?a>b">t</div><p title="data-url='/no'">t</p>"""))
    assert raws(found) == ["/yes?a>b"]


def test_all_entities_are_decoded_once(spark):
    html = "<title>caf&eacute; &pound;5 &ndash; x &amp;lt; &#60; &#x3E; &#0; &#99999999; &nosuch; &lt&#59; AT&T; &CounterClockwiseContourIntegral;</title>"
    got = L.page_metadata(pages(spark, html)).first().title
    assert got == "café £5 – x &lt; < > � � &nosuch; &lt; AT&T; ∳"


def test_homepage_links_of_every_page(spark):
    rows = [("https://www.example.com/", '<a href="/a">a</a>'), ("https://www.example.com/about?q=1", '<a href="/b">b</a>')]
    df = spark.createDataFrame(rows, "url string, html string")
    assert sorted(map(tuple, L.homepage_links(df).collect())) == [(u, "https://www.example.com/" + x) for (u, _), x in zip(rows, "ab")]
    assert [r.src_url for r in L.homepage_links(L.base_pages(df)).collect()] == [rows[0][0]]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_snapshot_joins_are_shuffled_by_rows(spark, monkeypatch):
    monkeypatch.setattr("sitewright.operators.skew.ROWS_PER_TASK", 2, raising=False)
    html = ['<a href="/0">0</a>', '<a href="/0">0</a><a href="/1">1</a>', '<a href="/2">2</a>']
    df = spark.createDataFrame([("http://h/p", k, h) for k, h in enumerate(html)], "url string, step int, html string")
    clicks = N.snapshot_delta(df, stop_on_empty=False)
    assert "Broadcast" not in _plan(clicks) and "SortMergeJoin" in _plan(clicks)
    assert sorted((r.step, r.dst_url[-2:]) for r in clicks.collect()) == [(1, "/1"), (2, "/2")]


def test_snapshot_stops_are_not_broadcast(spark):
    df = spark.createDataFrame([("http://h/p", k, f'<a href="/{k // 2}">x</a>') for k in (0, 1, 2, 3)], "url string, step int, html string")
    scrolls = N.snapshot_delta(df)
    plan = _plan(scrolls)
    assert plan.count("SortMergeJoin") >= 2  # stops with the steps that brought links, then links with stops
    assert scrolls.collect() == []
