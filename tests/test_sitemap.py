import gzip
import os
import xml.etree.ElementTree as ET
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sitewright.operators import sitemap as S
from sitewright.plans import queries
from sitewright.sources import sitemap_files as X

SITE = "https://www.example.com"
NS = "{http://www.sitemaps.org/schemas/sitemap/0.9}"
NOW = "2024-06-01 12:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def registry(spark, paths, last=datetime(2024, 1, 1, 12)):
    rows = [(SITE + p, last, 200, "success") for p in paths]
    return spark.createDataFrame(rows, "url string, last_crawled timestamp, status_code int, crawl_status string")


def entries(spark, paths):
    return S.build_entries(registry(spark, paths))


SAMPLE = ["", "/jobs", "/jobs/123"]


def test_entry(spark):
    rows = {r["loc"]: r for r in entries(spark, SAMPLE).collect()}
    home = rows[SITE]
    assert (home.priority, home.changefreq, home.lastmod) == (1.0, "daily", "2024-01-01T12:00:00+00:00")
    assert rows[SITE + "/jobs/123"].priority == 0.6


def test_single_file_and_shape(spark, tmp_path):
    out = str(tmp_path / "site")
    assert X.write_site(entries(spark, ["/a?x=1&y=<2>"]), out, SITE, now()) == ["sitemap.xml"]
    assert sorted(f for f in os.listdir(out) if not f.startswith(".")) == ["robots.txt", "sitemap.xml"]
    root = ET.parse(out + "/sitemap.xml").getroot()
    assert root.tag == NS + "urlset" and len(root) == 1
    got = {c.tag.replace(NS, ""): c.text for c in root[0]}
    assert got == {"loc": SITE + "/a?x=1&y=<2>", "lastmod": "2024-01-01T12:00:00+00:00",
                   "changefreq": "weekly", "priority": "0.5"}
    text = open(out + "/robots.txt").read()
    assert text == f"User-agent: *\nAllow: /\n\nSitemap: {SITE}/sitemap/sitemap.xml\n"


def test_missing_lastmod_is_left_out(spark, tmp_path):
    out = str(tmp_path / "site")
    df = S.build_entries(registry(spark, ["/a"], None))
    X.write_site(df, out, SITE, now())
    assert "lastmod" not in open(out + "/sitemap.xml").read()


def test_split_into_files_with_index(spark, tmp_path):
    out = str(tmp_path / "site")
    names = X.write_site(entries(spark, [f"/page{i}" for i in range(100)]), out, SITE, now(), 2, gzip=True)
    assert names == [f"sitemap_{i:03d}.xml" for i in range(1, 51)]
    locs = []
    for n in names:
        root = ET.parse(f"{out}/{n}").getroot()
        assert len(root) <= 2
        found = [u.find(NS + "loc").text for u in root]
        locs += found
        with gzip.open(f"{out}/{n}.gz", "rt") as f:
            zipped = ET.fromstring(f.read())
        assert [u.find(NS + "loc").text for u in zipped] == found
    assert locs == sorted(SITE + f"/page{i}" for i in range(100))
    index = ET.parse(out + "/sitemap_index.xml").getroot()
    assert index.tag == NS + "sitemapindex" and len(index) == 50
    assert index[0].find(NS + "loc").text == SITE + "/sitemap/sitemap_001.xml"
    assert index[0].find(NS + "lastmod").text == "2024-06-01T12:00:00+00:00"
    assert open(out + "/robots.txt").read().endswith(f"Sitemap: {SITE}/sitemap/sitemap_index.xml\n")
    report = X.validate_sitemaps(spark, out + "/sitemap*.xml", 2).collect()
    assert len(report) == 51 and all(r.valid for r in report)
    assert [r.kind for r in report if r.file == "sitemap_index.xml"] == ["index"]
    listed = X.read_indexed_sitemaps(spark, out + "/sitemap_index.xml", out, SITE + "/sitemap")
    assert listed.count() == 100
    sizes = {r.file: r.file_size_mb for r in X.file_sizes(spark, out + "/sitemap_0*.xml").collect()}
    assert sizes["sitemap_001.xml"] == os.path.getsize(out + "/sitemap_001.xml") / 1048576


def test_split_count(spark):
    df = entries(spark, SAMPLE + [p + "/x" for p in SAMPLE])
    assert S.sitemap_files(S.chunk_sitemaps(df, 2)).count() == 3


def test_cleanup_keeps_other_files(spark, tmp_path):
    out = tmp_path / "site"
    out.mkdir()
    for n in ("sitemap_old.xml", "sitemap_index_old.xml", "other_file.txt"):
        (out / n).write_text("x")
    X.overwrite_sitemaps(spark, str(out))
    assert os.listdir(out) == ["other_file.txt"]


def test_no_rows_no_files(spark, tmp_path):
    out = str(tmp_path / "site")
    os.mkdir(out)
    assert X.write_site(entries(spark, []), out, SITE, now()) == []
    assert [f for f in os.listdir(out) if "sitemap" in f or "robots" in f] == []


FILES = {
    "good.xml": '<?xml version="1.0"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://www.example.com/a </loc></url></urlset>',
    "noloc.xml": '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><lastmod>x</lastmod></url></urlset>',
    "ftp.xml": '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>ftp://h/x</loc></url></urlset>',
    "root.xml": "<other><url><loc>http://h/x</loc></url></other>",
    "nons.xml": "<urlset><url><loc>http://h/x</loc></url></urlset>",
    "cut.xml": '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>http://h/x</loc></url><url>',
    "many.xml": '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' + "<url><loc>http://h/x</loc></url>" * 4 + "</urlset>",
    "empty.xml": '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"></urlset>',
    "index.xml": '<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>http://h/s.xml</loc></sitemap></sitemapindex>',
}


def test_validation_by_kind(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_text(text)
    got = {r.file: r.valid for r in X.validate_sitemaps(spark, str(tmp_path) + "/*.xml", 3).collect()}
    assert got == {
        "good.xml": True, "noloc.xml": False, "ftp.xml": False, "root.xml": False, "nons.xml": False,
        "cut.xml": False, "many.xml": False, "empty.xml": True, "index.xml": True}


def test_read_keeps_site_urls(spark, tmp_path):
    (tmp_path / "s.xml").write_text(
        '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
        "<url><loc> https://example.com/a?x=1&amp;y=2 </loc></url><url><loc>https://www.example.com/b</loc></url>"
        "<url><loc>https://www.example.com/c.pdf</loc></url><url><loc>https://other.com/d</loc></url></urlset>")
    rows = X.read_sitemap(spark, str(tmp_path / "s.xml"))
    got = sorted(r.url for r in X.sitemap_locations(rows, SITE).collect())
    assert got == ["https://example.com/a?x=1&y=2", "https://www.example.com/b"]


def test_final_output(spark, tmp_path):
    rows = [(SITE + "/", 200, None), (SITE + "/browse-jobs", 200, ""), (SITE + "/x", 301, None), (SITE + "/y", 200, "e")]
    df = spark.createDataFrame(rows, "url string, status_code int, error_message string")
    e = S.build_entries_final(df, now())
    assert sorted((r["loc"], r.priority, r.changefreq) for r in e.collect()) == [
        (SITE + "/", 1.0, "weekly"), (SITE + "/browse-jobs", 0.9, "daily")]
    files = S.sitemap_files(S.chunk_sitemaps(e))
    X.write_robots(S.robots_txt_final(files, SITE + "/"), str(tmp_path))
    assert (tmp_path / "robots.txt").read_text() == f"User-agent: *\nAllow: /\nSitemap: {SITE}/sitemap.xml\n"


    split = S.robots_txt_final(S.sitemap_files(S.chunk_sitemaps(e, 1)), SITE).collect()
    assert split[2].line == f"Sitemap: {SITE}/sitemap_index.xml"


def test_final_site_of_several_sitemaps(spark, tmp_path):
    rows = [(f"{SITE}/p{i}", 200, None) for i in range(3)]
    df = spark.createDataFrame(rows, "url string, status_code int, error_message string")
    X.write_site_final(S.build_entries_final(df, now()), str(tmp_path), SITE, now(), 2)
    assert (tmp_path / "robots.txt").read_text() == f"User-agent: *\nAllow: /\nSitemap: {SITE}/sitemap.xml\n"
    index = X.read_sitemap_index(spark, str(tmp_path / "sitemap.xml")).collect()
    assert sorted(r["loc"] for r in index) == [f"{SITE}/sitemap_001.xml", f"{SITE}/sitemap_002.xml"]
    found = X.read_sitemap(spark, str(tmp_path / "sitemap*.xml")).collect()
    assert sorted(r["loc"] for r in found) == [r[0] for r in rows]


def test_final_robots_lines_at_any_number_of_sitemaps(spark, monkeypatch):
    monkeypatch.setattr(queries.S, "sitemap_files", lambda chunks: chunks.sparkSession.range(2).withColumn("filename", F.lit("x")))
    lines = queries.all_queries()["write_robots_final"](spark, "/root/testdata/sf0.001").collect()
    assert [r.line for r in lines] == ["User-agent: *", "Allow: /", f"Sitemap: {SITE}/sitemap.xml"]


def test_root_tag_over_several_lines(spark, tmp_path):
    space = "http://www.sitemaps.org/schemas/sitemap/0.9"
    (tmp_path / "a.xml").write_text(f'<?xml version="1.0"?>\n<urlset\n  xmlns:x="http://x"\n  xmlns="{space}"\n>\n<url><loc>{SITE}/</loc></url>\n</urlset>\n')
    (tmp_path / "b.xml").write_text(f'<urlset\nxmlns="{space}">\n<url><loc>{SITE}/</loc></url>\n')
    got = {r.file: (r.kind, r.valid) for r in X.validate_sitemaps(spark, str(tmp_path / "*.xml")).collect()}
    assert got == {"a.xml": ("urlset", True), "b.xml": ("urlset", False)}


def test_validation_opens_each_file_once(spark, tmp_path):
    (tmp_path / "a.xml").write_text(FILES["good.xml"])
    with gzip.open(tmp_path / "b.xml.gz", "wt") as f:
        f.write("<!-- > --><?x y?>" + FILES["good.xml"].split("?>\n")[1])
    (tmp_path / "c.xml").write_text(FILES["cut.xml"])
    report = X.validate_sitemaps(spark, str(tmp_path))
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
    got = {r.file: (r.urls, r.valid, r.file_size_mb) for r in report.collect()}
    size = lambda n: os.path.getsize(tmp_path / n) / 1048576
    assert got == {"a.xml": (1, True, size("a.xml")), "b.xml.gz": (1, True, size("b.xml.gz")), "c.xml": (1, False, size("c.xml"))}
    stats = {r.file: r.total_urls for r in X.sitemap_file_stats(spark, str(tmp_path)).collect()}
    assert stats == {"a.xml": 1, "b.xml.gz": 1, "c.xml": 1}


def test_unlisted_files_stay_unread(spark, tmp_path):
    space = "http://www.sitemaps.org/schemas/sitemap/0.9"
    (tmp_path / "index.xml").write_text(f'<sitemapindex xmlns="{space}"><sitemap><loc>{SITE}/a.xml</loc></sitemap></sitemapindex>')
    (tmp_path / "a.xml").write_text(f'<urlset xmlns="{space}"><url><loc>{SITE}/1</loc></url></urlset>')
    (tmp_path / "unlisted.xml").write_text("x")
    os.chmod(tmp_path / "unlisted.xml", 0)
    scans = []
    read = X.sitemap_documents
    try:
        X.sitemap_documents = lambda s, paths: scans.append([os.path.basename(p) for p in paths]) or read(s, paths)
        rows = X.read_indexed_sitemaps(spark, str(tmp_path / "index.xml"), str(tmp_path), SITE)
        assert [r["loc"] for r in rows.collect()] == [SITE + "/1"]
    finally:
        X.sitemap_documents = read
    assert scans == [["index.xml"], ["a.xml"]]


def test_declared_sitemaps_of_many_hosts(spark, tmp_path):
    rows = [("a.com/sitemap.xml", "https://a.com/1"), ("a.com/sitemap.xml", "https://b.com/not-own"), ("b.com/m/x.xml", "https://b.com/2"),
            ("b.com/lost.xml", "https://b.com/3"), ("c.com/sm.xml", "https://c.com/4")]
    X.write_files(spark.createDataFrame(rows, "file string, loc string"), str(tmp_path), "url", "urlset")
    index = [("b.com/i.xml", "https://b.com/m/x.xml"), ("b.com/i.xml", "https://b.com/missing.xml"), ("c.com/j.xml", "https://b.com/i.xml")]
    X.write_files(spark.createDataFrame(index, "file string, loc string"), str(tmp_path), "sitemap", "sitemapindex")
    urls = ["https://a.com/sitemap.xml", "https://C.com/j.xml", "https://nobody.com/sitemap.xml", "ftp://c.com/sm.xml", None]
    got = X.read_declared_sitemaps(spark, str(tmp_path), spark.createDataFrame([(u,) for u in urls], "url string"))
    assert sorted((r["name"], r["host"], r["loc"]) for r in got.collect()) == [
        ("a.com/sitemap.xml", "a.com", "https://a.com/1"), ("b.com/m/x.xml", "b.com", "https://b.com/2")]
    none = X.read_declared_sitemaps(spark, str(tmp_path), spark.createDataFrame([("https://z.com/",)], "url string"))
    assert none.collect() == []


def test_index_of_many_sitemaps(spark, tmp_path):
    files = spark.range(1, 121).selectExpr("id AS sitemap_no", "format_string('sitemap_%03d.xml', id) AS filename", "1L AS urls")
    names = X.write_sitemap_index(S.sitemap_index(files, SITE, now()), str(tmp_path), 50)
    assert names == [f"sitemap_index_{i:03d}.xml" for i in (1, 2, 3)]
    listed = [u.find(NS + "loc").text for n in names for u in ET.parse(tmp_path / n).getroot()]
    assert listed == [f"{SITE}/sitemap/sitemap_{i:03d}.xml" for i in range(1, 121)]
    lines = [r.line for r in S.robots_txt(files, SITE, 50).orderBy("line_no").collect()]
    assert lines[3:] == [f"Sitemap: {SITE}/sitemap/{n}" for n in names]


def test_runs_leave_no_files_of_earlier_ones(spark, tmp_path):
    out = str(tmp_path)
    for _ in range(2):
        X.write_site(entries(spark, SAMPLE), out, SITE, now(), 1, gzip=True)
        assert len(list(tmp_path.glob("sitemap_0*.xml.gz"))) == 3
    X.write_site(entries(spark, SAMPLE), out, SITE, now())
    assert sorted(p.name for p in tmp_path.glob("sitemap*")) == ["sitemap.xml"]


def test_listed_children_of_any_name_and_depth(spark, tmp_path):
    import gzip

    space = "http://www.sitemaps.org/schemas/sitemap/0.9"
    urls = lambda *names: f'<urlset xmlns="{space}">' + "".join(f"<url><loc>{SITE}/{n}</loc></url>" for n in names) + "</urlset>"
    index = lambda *files: f'<sitemapindex xmlns="{space}">' + "".join(f"<sitemap><loc>{SITE}/maps/{f}</loc></sitemap>" for f in files) + "</sitemapindex>"
    (tmp_path / "old").mkdir()
    (tmp_path / "index.xml").write_text(index("post-sitemap.xml", "old/index.xml", "zipped.xml.gz"))
    (tmp_path / "old" / "index.xml").write_text(index("old/post-sitemap.xml", "index.xml"))
    (tmp_path / "post-sitemap.xml").write_text(urls("a"))
    (tmp_path / "old" / "post-sitemap.xml").write_text(urls("b", "c"))
    (tmp_path / "zipped.xml.gz").write_bytes(gzip.compress(urls("d").encode()))
    (tmp_path / "unlisted.xml").write_text(urls("e"))
    (tmp_path / "old" / "zipped.xml").write_text(urls("f"))
    rows = X.read_indexed_sitemaps(spark, str(tmp_path / "index.xml"), str(tmp_path), SITE + "/maps")
    assert sorted(r["loc"].removeprefix(SITE) for r in rows.collect()) == ["/a", "/b", "/c", "/d"]


def test_stats_and_distributions(spark):
    chunks = S.chunk_sitemaps(entries(spark, SAMPLE), 2)
    got = {r.sitemap_no: tuple(r)[1:] for r in S.sitemap_stats(chunks).collect()}
    assert got == {1: (2, 2, 2, 2), 2: (1, 1, 1, 1)}
    dist = {(r.sitemap_no, r.changefreq): r.urls for r in S.value_distribution(chunks, "changefreq").collect()}
    assert dist == {(1, "daily"): 2, (2, "daily"): 1}


@pytest.mark.parametrize("per_file", [1, 7, 1000])
def test_chunks_follow_url_order(spark, per_file):
    paths = [f"/p{i * 37 % 101}" for i in range(101)]
    chunks = S.chunk_sitemaps(entries(spark, paths), per_file).collect()
    ordered = sorted(SITE + p for p in paths)
    assert {r["loc"]: r.sitemap_no for r in chunks} == {u: i // per_file + 1 for i, u in enumerate(ordered)}


def test_named_files_are_placed_by_tasks(spark, tmp_path, monkeypatch):
    def refuse(*_):
        raise AssertionError("a file passed through the driver")

    monkeypatch.setattr(X, "_move", refuse)
    monkeypatch.setattr(X, "_part_files", refuse)
    odd = "https://a.com/x?a=1&b=<é>\"'"
    rows = [(f"a.com/m{i % 40}.xml", f"https://a.com/{i}", None if i % 2 else "2024-01-01") for i in range(200)] + [("a.com/m0.xml", odd, None)]
    (tmp_path / "a.com").mkdir()
    (tmp_path / "a.com" / "m0.xml").write_text("old")
    (tmp_path / "a.com" / ".m0.xml.crc").write_bytes(b"crc\0" + bytes(8))  # checksums of the old file
    names = X.write_files(spark.createDataFrame(rows, "file string, loc string, lastmod string"), str(tmp_path), "url", "urlset")
    assert names == sorted({r[0] for r in rows}) and sorted(p.name for p in tmp_path.iterdir()) == ["a.com"]
    got = [(f"a.com/{f.name}", *(u.findtext(NS + c) for c in ("loc", "lastmod"))) for f in (tmp_path / "a.com").glob("*.xml")
           for u in ET.parse(f).getroot()]
    assert sorted(got, key=str) == sorted(rows, key=str)
    space = "http://www.sitemaps.org/schemas/sitemap/0.9"
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="{space}">'
    blocks = "".join(f"\n    <url>\n        <loc>https://a.com/{i}</loc>\n        <lastmod>2024-01-01</lastmod>\n    </url>" for i in range(2, 200, 40))
    assert (tmp_path / "a.com" / "m2.xml").read_text() == head + blocks + "\n</urlset>"
    read = X.read_sitemap(spark, str(tmp_path / "a.com")).collect()
    assert sorted(r["loc"] for r in read) == sorted(r[1] for r in rows)


@pytest.mark.parametrize("gzipped", [False, True])
def test_mounted_and_remote_folders_get_the_same_files(spark, tmp_path, gzipped):
    lines = spark.createDataFrame([("a b%2F", "é"), ("a b%2F", None), ("c", "y")], "k string, line string").coalesce(1)
    found = []
    for write in (X._write_mounted, X._write_remote):
        out = tmp_path / write.__name__
        (out / "_staging").mkdir(parents=True)
        staging = out / "_staging" if write is X._write_mounted else out / "_staging" / "new"
        names = write(lines, str(staging), str(out), lambda key, files: f"{key.replace('%2F', '_')}{files}.txt" + gzipped * ".gz", "\n", gzipped)
        body = [(gzip.decompress if gzipped else bytes)((out / n).read_bytes()) for n in sorted(names)]
        found.append((sorted(names), body))
    assert found[0] == found[1] and found[0][1] == ["é\n\n".encode(), b"y\n"]
