"""Robots rules and verdicts against the standard library's parser."""

import random
from urllib.robotparser import RobotFileParser

import pytest

from sitewright.operators import robots as B
from sitewright.sources import sitemap_files as X

TEXTS = {
    "order": "User-agent: *\nAllow: /a/b\nDisallow: /a\nDisallow: /c%20d\n",
    "groups": "User-agent: SiteBot\nUser-agent: Other\nDisallow: /x # c\n\nUser-agent: *\nDisallow: /\n",
    "late": "User-agent: *\nDisallow: /p\n\nUser-agent: site\nDisallow: /q\nUser-agent: *\nDisallow: /r\n",
    "blank": "User-agent: *\n\nDisallow: /lost\n\nUser-agent: *\nDisallow: /kept\n",
    "allowall": "User-agent: *\nDisallow:\nDisallow: /x\n",
    "delay": "User-agent: sitebot\nCrawl-delay: 5\n\nUser-agent: *\nDisallow: /\n",
    "none": "# nothing\nSitemap: https://h/s.xml\nDisallow: /x\n",
    "query": "User-Agent: *\nDisallow: /s?q=1\nDisallow: /é\n",
    "empty": "",
}
PATHS = ["", "/", "/a", "/a/b/c", "/a/x", "/c d/e", "/c%20d", "/x", "/p1", "/q", "/r", "/lost", "/kept",
         "/s?q=12", "/s?q=2", "/s", "/%C3%A9t", "/é"]


def lines(spark, texts):
    rows = [(h, i, ln) for h, t in texts.items() for i, ln in enumerate(t.splitlines())]
    return spark.createDataFrame(rows, "host string, line_no int, line string")


def expected(texts, agent):
    out = {}
    for host, text in texts.items():
        parser = RobotFileParser()
        parser.parse(text.splitlines())
        for path in PATHS:
            url = f"http://{host}{path}"
            out[url] = parser.can_fetch(agent, url)
    return out


def verdicts(spark, texts, agent, block=B.BLOCK, **kw):
    urls = spark.createDataFrame([(f"http://{h}{p}",) for h in texts for p in PATHS], "url string")
    rules = B.parse_robots(lines(spark, texts), block)
    return {r.url: r.allowed for r in B.robots_allowed(urls, rules, agent, **kw).collect()}


@pytest.mark.parametrize("agent", ["SiteBot/1.0", "*", "stranger"])
def test_equal_to_robotparser(spark, agent):
    assert verdicts(spark, TEXTS, agent) == expected(TEXTS, agent)


def test_hot_hosts_and_random_files(spark, no_broadcast):
    rng = random.Random(3)

    def text():
        out = []
        for _ in range(rng.randint(0, 14)):
            out.append(rng.choice([
                "User-agent: *", "User-agent: SiteBot", "user-agent: zed", "", "# c", "Allow: /a/b", "Disallow: /a",
                "Disallow: /", "Allow: /x", "Disallow: /s?q", "Disallow:", "Crawl-delay: 3", "Disallow: /c%20d"]))
        return "\n".join(out)

    texts = {f"h{i}.com": text() for i in range(25)}
    want = expected(texts, "SiteBot")
    assert verdicts(spark, texts, "SiteBot", hot_rows=3) == want
    # Blocks of three lines: groups and states carry over from block to block.
    assert verdicts(spark, texts, "SiteBot", block=3) == want


def test_blocked(spark):
    urls = spark.createDataFrame([("http://order/a/z",), ("http://order/a/b",)], "url string")
    v = B.robots_allowed(urls, B.parse_robots(lines(spark, TEXTS)), "x")
    assert [tuple(r) for r in B.blocked_results(v).collect()] == [
        ("http://order/a/z", 403, "Disallowed by robots.txt")]


def test_fetch_policy(spark):
    df = spark.createDataFrame([(c,) for c in (200, 401, 403, 404, 500, 0)], "c int")
    got = [r[0] for r in df.select(B.robots_fetch_policy("c")).collect()]
    assert got == ["rules", "none", "none", "all", "none", "all"]


def test_fetch_policy_decides_before_rules(spark, tmp_path):
    hosts = {"ok.com": 200, "shut.com": 403, "login.com": 401, "none.com": 404, "down.com": 503, "away.com": 0, "unknown.com": None}
    text = lines(spark, {h: "User-agent: *\nDisallow: /no" for h in hosts})
    assert X.write_robots_files(text, str(tmp_path)) == sorted(f"{h}/robots.txt" for h in hosts)
    read = X.read_robots_lines(spark, str(tmp_path))
    fetches = spark.createDataFrame([(h, c) for h, c in hosts.items() if c is not None], "host string, status_code int")
    urls = spark.createDataFrame([(f"http://{h}/{p}",) for h in [*hosts, "other.com"] for p in ("yes", "no")], "url string")
    for hot_rows in (500_000, 2):
        got = B.robots_allowed(urls, B.parse_robots(read), "x", hot_rows, fetches).collect()
        closed = {r.url for r in got if not r.allowed}
        assert len(got) == 16 and closed == {
            "http://ok.com/no", "http://unknown.com/no", *(f"http://{h}/{p}" for h in ("shut.com", "login.com", "down.com") for p in ("yes", "no"))}


def test_urls_from_file(spark, tmp_path):
    (tmp_path / "www.example.com").mkdir()
    (tmp_path / "www.example.com" / "robots.txt").write_text(
        "User-agent: *\r\nDisallow: /private/\nallow: rel/x\nDisallow: /\nDisallow: *.pdf\nDisallow: /d.pdf\n"
        "Sitemap: https://cdn.net/s.xml \nDisallow:\n")
    got = B.robots_urls(X.read_robots_lines(spark, str(tmp_path)))
    assert sorted((r.kind, r.url) for r in got.collect()) == [
        ("path", "https://www.example.com/private/"), ("path", "https://www.example.com/rel/x"),
        ("sitemap", "https://cdn.net/s.xml")]
