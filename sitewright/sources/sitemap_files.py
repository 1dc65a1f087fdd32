"""Sitemap, index and robots.txt files: write, read, check."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import url as U
from ..functions.html import strip_ws, unescape
from ..operators import sitemap as S
from ..operators.skew import ranked
from ..rules import MAX_URLS_PER_SITEMAP, SITEMAP_NAMESPACE
from ..session import materialize, shuffle_partitions

URL_ROWS = "loc string, lastmod string, changefreq string, priority string, _corrupt string"
INDEX_ROWS = "loc string, lastmod string"
SITEMAP_FILES = "/sitemap{.xml,_[0-9]*.xml}"
MOVE_THREADS = 16
XML_DECLARATION = 'version="1.0" encoding="UTF-8"'


def _hadoop(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def _part_files(spark: SparkSession, folder: str, depth: int) -> list[tuple[str, str]]:
    """(parent folder name, path) of data files ``depth`` levels below ``folder``."""
    fs, root = _hadoop(spark, folder + "/*" * depth)
    found = fs.globStatus(root) or []
    paths = [s.getPath() for s in found]
    return [
        (p.getParent().getName(), p.toString()) for p in paths if p.getName().startswith("part-")
    ]


def _move(spark: SparkSession, source: str, target: str) -> None:
    fs, src = _hadoop(spark, source)
    _, dst = _hadoop(spark, target)
    fs.delete(dst, False)  # some file systems refuse to replace a file
    if not fs.rename(src, dst):
        raise OSError(f"could not move {source} to {target}")


def _drop(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def overwrite_sitemaps(spark: SparkSession, out_dir: str) -> None:
    """Drop ``sitemap*.xml`` and their gzip twins of an earlier run; other files stay."""
    fs, pattern = _hadoop(spark, out_dir + "/sitemap*.xml{,.gz}")
    for status in fs.globStatus(pattern) or []:
        fs.delete(status.getPath(), False)


def _xml_rows(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "sitemap_no",
        "loc",
        "lastmod",
        "changefreq",
        F.format_string("%.1f", "priority").alias("priority"),
    )


def _element(name: str) -> Column:
    """The element of a column, nothing for null."""
    text = F.col(name).cast("string")
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), ("]]>", "]]&gt;"), ("\r", "&#xd;")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return F.coalesce(F.concat(F.lit(f"\n        <{name}>"), text, F.lit(f"</{name}>")), F.lit(""))


def _xml_lines(rows: DataFrame, key: str, order: list[Column], row_tag: str, root_tag: str) -> DataFrame:
    """``(key, value)``: the markup of one XML file per ``key``, a file in one partition and in order.

    Columns but ``key`` are elements. Every value lacks its last ``>``, which ends a line in place of a newline: the
    files end with their root element.
    """
    elements = [_element(c) for c in rows.columns if c != key]
    head = f'<?xml {XML_DECLARATION}?>\n<{root_tag} xmlns="{SITEMAP_NAMESPACE}">'
    in_file = Window.partitionBy(key).orderBy(*order)
    value = F.concat(
        F.when(F.row_number().over(in_file) == 1, F.lit(head)).otherwise(""),
        F.lit(f"\n    <{row_tag}>"),
        *elements,
        F.lit(f"\n    </{row_tag}"),
        F.when(F.lead(F.lit(1)).over(in_file).isNull(), F.lit(f">\n</{root_tag}")).otherwise(""),
    )
    return rows.repartition(shuffle_partitions(rows.sparkSession), key).select(key, value.alias("value"))


def write_sitemaps(chunks: DataFrame, out_dir: str, gzip: bool = False) -> list[str]:
    """One XML file per ``sitemap_no``; returns the file names.

    A sitemap is one task's work of at most 50,000 rows. Part files are then given
    their protocol names, a metadata step per file.
    """
    lines = _xml_lines(_xml_rows(chunks), "sitemap_no", [F.asc("loc")], "url", "urlset")
    suffix = ".xml.gz" if gzip else ".xml"

    def name(number: str, files: int) -> str:
        return ("sitemap" if files == 1 else f"sitemap_{int(number):03d}") + suffix

    return _write_keyed(lines, out_dir, name, ">", gzip)


def _write_single(df: DataFrame, target: str, fmt: str, **options: str) -> None:
    """A small table (an index, robots lines) as one file of the given name."""
    spark = df.sparkSession
    staging = f"{target}-staging-{uuid.uuid4().hex}"
    df.coalesce(1).write.format(fmt).options(**options).save(staging)
    for _, path in _part_files(spark, staging, 1):
        _drop(spark, target)
        _move(spark, path, target)
    _drop(spark, staging)


def write_sitemap_index(index: DataFrame, out_dir: str, per_file: int = MAX_URLS_PER_SITEMAP) -> list[str]:
    """Index files of at most ``per_file`` rows each, written in parallel; returns their names.

    One index is ``sitemap_index.xml``, several carry numbers.
    """
    # Length first: the order of the numbers in the names.
    numbered = ranked(index, [F.length("loc").asc(), F.asc("loc")]).withColumn("no", S.block_of("rn", per_file))
    last = numbered.agg(F.max("no").alias("m")).scalar()
    rows = numbered.select(S.index_name("no", last).alias("file"), "loc", "lastmod")
    return write_files(rows, out_dir, "sitemap", "sitemapindex")


def write_robots(lines: DataFrame, out_dir: str) -> str:
    target = f"{out_dir}/robots.txt"
    _write_single(lines.orderBy("line_no").select("line"), target, "text")
    return target


def write_site(
    entries: DataFrame,
    out_dir: str,
    base_url: str,
    now: Column,
    per_file: int = MAX_URLS_PER_SITEMAP,
    gzip: bool = False,
) -> list[str]:
    """Number, write, index: the whole output of a run. No rows, no files."""
    spark = entries.sparkSession
    overwrite_sitemaps(spark, out_dir)
    chunks = S.chunk_sitemaps(entries, per_file)
    names = write_sitemaps(chunks, out_dir)
    if not names:
        return []
    if gzip:
        write_sitemaps(chunks, out_dir, gzip=True)
    files = S.sitemap_files(chunks)
    if len(names) > 1:
        write_sitemap_index(S.sitemap_index(files, base_url, now), out_dir)
    write_robots(S.robots_txt(files, base_url), out_dir)
    return names


def write_site_final(
    entries: DataFrame, out_dir: str, base_url: str, now: Column, per_file: int = MAX_URLS_PER_SITEMAP
) -> list[str]:
    """The output of the final rules, at the site root. No rows, no files.

    ``sitemap.xml``, which robots.txt names, is the lone sitemap or the index of the numbered ones.
    """
    chunks = S.chunk_sitemaps(entries, per_file)
    names = write_sitemaps(chunks, out_dir)
    if not names:
        return []
    files = S.sitemap_files(chunks)
    if len(names) > 1:
        index = S.sitemap_index(files, base_url, now, folder="").withColumn("file", F.lit("sitemap.xml"))
        write_files(index.select("file", "loc", "lastmod"), out_dir, "sitemap", "sitemapindex")
    write_robots(S.robots_txt_final(files, base_url, index="sitemap.xml"), out_dir)
    return names


def read_sitemap(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows of ``urlset`` files: ``(file, loc, lastmod, changefreq, priority)``."""
    rows = (
        spark.read.format("xml")
        .option("rowTag", "url")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .schema(URL_ROWS)
        .load(paths)
    )
    return _sitemap_rows(rows)


def _sitemap_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("_metadata.file_path").alias("file"),
        strip_ws(F.col("loc")).alias("loc"),
        "lastmod",
        "changefreq",
        "priority",
        F.col("_corrupt").isNotNull().alias("malformed"),
    )


def sitemap_locations(rows: DataFrame, base_url: str) -> DataFrame:
    """Distinct URLs of sitemap rows that belong to the site."""
    return (
        rows.filter(U.is_same_site("loc", F.lit(base_url)))
        .select(F.col("loc").alias("url"))
        .distinct()
    )


def read_sitemap_index(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return (
        spark.read.format("xml")
        .option("rowTag", "sitemap")
        .schema(INDEX_ROWS)
        .load(paths)
        .select(strip_ws(F.col("loc")).alias("loc"), "lastmod")
    )


def _below(path: Column, folder: str) -> Column:
    """Path of a file below a folder, without scheme and host."""
    plain = r"^[a-z]+:(?://[^/]*)?/*"
    root = re.sub(plain, "/", folder.rstrip("/"))
    return F.substring(F.regexp_replace(path, plain, "/"), len(root) + 2, 1 << 30)


def _follow(spark: SparkSession, folder: str, starts: DataFrame, child: Column) -> DataFrame:
    """Documents of the files that ``starts(name)`` names, and of those that indexes among them list, level by level.

    The names of a level meet the folder's listing first, and only files that are there and new are opened, each
    once. Their paths pass through the driver, as the file index of any scan does. ``child`` is the name
    that a listed location stands for.
    """
    files = materialize(listing(spark, folder).select("path", "name"), "listing")
    level, levels, seen = starts.select("name").distinct(), [], None
    while True:
        fresh = files.join(level, "name", "left_semi")
        if seen is not None:
            fresh = fresh.join(seen, "name", "left_anti")
        fresh = materialize(fresh, "level")
        paths = [r["path"] for r in fresh.toLocalIterator()]
        if not paths:
            break
        found = materialize(sitemap_documents(spark, paths).withColumn("name", _below(F.col("file"), folder)), "documents")
        levels.append(found)
        seen = fresh.select("name") if seen is None else seen.union(fresh.select("name"))
        listed = found.select(F.explode("sitemaps.loc").alias("loc"))
        level = listed.select(child.alias("name")).filter(F.col("name").isNotNull()).distinct()
    if not levels:
        return sitemap_documents(spark, []).withColumn("name", F.lit(""))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def _rows_of(documents: DataFrame) -> DataFrame:
    return documents.select("file", "name", "malformed", F.explode("urls").alias("u")).select(
        "file", "name", strip_ws(F.col("u.loc")).alias("loc"), "u.lastmod", "u.changefreq", "u.priority", "malformed"
    )


def read_indexed_sitemaps(
    spark: SparkSession, index_path: str, folder: str, base_url: str
) -> DataFrame:
    """Rows of the sitemaps that an index lists, directly or by further indexes.

    ``folder`` holds what lies below ``base_url``, whatever the files are called,
    gzipped ones too; files that no index lists stay unread.
    """
    base = base_url.rstrip("/") + "/"
    loc = strip_ws(F.col("loc"))
    child = F.when(loc.startswith(base), F.substring(loc, len(base) + 1, 1 << 30))
    start = spark.range(1).select(_below(F.lit(index_path), folder).alias("name"))
    documents = _follow(spark, folder, start, child)
    return _rows_of(documents.filter(F.col("kind") == "urlset")).drop("name")


def _host_path(url: Column) -> Column:
    """Where the file of a URL lies in a folder of hosts."""
    return U.let(
        U.url_split(url),
        lambda u: F.when(u.scheme.isin("http", "https"), F.concat(F.lower(u.netloc), F.when(u.path == "", "/").otherwise(u.path))),
    )


def read_declared_sitemaps(spark: SparkSession, folder: str, declared: DataFrame) -> DataFrame:
    """Rows ``(file, host, loc, ...)`` of all sitemaps that ``declared(url)`` names, indexes followed to the end.

    ``folder`` holds fetched files as ``host/path``. Declared URLs are lines of robots.txt, the usual
    places, or any other; those that were not fetched are passed over. Locations count if they belong to the
    site of their file.
    """
    starts = declared.select(_host_path(F.col("url")).alias("name")).filter(F.col("name").isNotNull())
    rows = _rows_of(_follow(spark, folder, starts, _host_path(strip_ws(F.col("loc")))))
    host = F.substring_index("name", "/", 1)
    return rows.withColumn("host", host).filter(U.is_same_site("loc", F.concat(F.lit("https://"), "host")))


def read_robots_lines(spark: SparkSession, folder: str) -> DataFrame:
    """robots.txt files of all hosts, ``folder/host/robots.txt``, as ``(host, line_no, line)``.

    One scan; a file is read whole, as one record, and its host is the name of its folder.
    """
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "robots.txt")
        .text(folder, wholetext=True)
        .select(
            F.element_at(F.split("_metadata.file_path", "/"), -2).alias("host"),
            F.posexplode(F.split("value", r"\r\n|\r|\n", -1)).alias("line_no", "line"),
        )
    )


def write_files(rows: DataFrame, out_dir: str, row_tag: str, root_tag: str) -> list[str]:
    """XML rows to the files that their column ``file`` names, below ``out_dir``; returns the names.

    A file is one task's work; renaming is a metadata step per file.
    """
    lines = _xml_lines(rows, "file", [F.length("loc").asc(), F.asc("loc")], row_tag, root_tag)
    return _write_keyed(lines, out_dir, lambda name, _: name, ">")


def write_robots_files(lines: DataFrame, out_dir: str) -> list[str]:
    """Lines ``(host, line_no, line)`` to ``out_dir/host/robots.txt``."""
    placed = (
        lines.repartition(shuffle_partitions(lines.sparkSession), "host")
        .sortWithinPartitions("host", "line_no")
        .select("host", "line")
    )
    return _write_keyed(placed, out_dir, lambda host, _: f"{host}/robots.txt", "\n")


def _write_keyed(lines: DataFrame, out_dir: str, name_of: Callable[[str, int], str], end: str, gzip: bool = False) -> list[str]:
    """Lines ``(key, line)``, a key in one partition and in order, each closed by ``end``, to one text file per key; returns the names.

    ``name_of`` gets the key and the number of files. Files are written aside and get their names when all are whole.
    """
    spark = lines.sparkSession
    staging = f"{out_dir}/_staging-{uuid.uuid4().hex}"
    fs, root = _hadoop(spark, staging)
    if fs.getUri().getScheme() == "file":
        fs.mkdirs(root)
        target = _hadoop(spark, out_dir)[1].toUri().getPath()
        names = _write_mounted(lines, root.toUri().getPath(), target, name_of, end, gzip)
    else:
        names = _write_remote(lines, staging, out_dir, name_of, end, gzip)
    _drop(spark, staging)
    return sorted(names)


def _write_mounted(
    lines: DataFrame, staging: str, target: str, name_of: Callable[[str, int], str], end: str, gzip: bool
) -> list[str]:
    """Files on a mounted file system: tasks write and rename them, each file opened once and without a folder of its own.

    Hadoop's local file system starts processes for every file and folder it makes.
    """

    def write(batches):
        import gzip as gz
        import hashlib
        import os
        import uuid

        import pyarrow as pa

        attempt = uuid.uuid4().hex

        def aside(key):
            return os.path.join(staging, f"{attempt}-{hashlib.sha256(key.encode()).hexdigest()}")

        out, last = None, None
        for batch in batches:
            begun = []
            for key, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != last:
                    if out is not None:
                        out.close()
                    out = gz.open(aside(key), "wb") if gzip else open(aside(key), "wb")
                    last = key
                    begun.append(key)
                out.write(((line or "") + end).encode())
            paths = [aside(key) for key in begun]
            yield pa.RecordBatch.from_arrays([pa.array(begun, pa.string()), pa.array(paths, pa.string())], ["key", "path"])
        if out is not None:
            out.close()

    def move(share):
        import os

        for path, name in share:
            there = os.path.join(target, name)
            if not os.path.exists(path):
                continue  # moved by an earlier attempt
            parent, leaf = os.path.split(there)
            os.makedirs(parent, exist_ok=True)
            sums = os.path.join(parent, f".{leaf}.crc")
            if os.path.exists(sums):
                os.remove(sums)  # of a file that is replaced
            os.replace(path, there)

    spark = lines.sparkSession
    keyed = lines.toDF("key", "value").select(F.col("key").cast("string"), "value")
    written = keyed.mapInArrow(write, "key string, path string").collect()
    named = [(r["path"], name_of(r["key"], len(written))) for r in written]
    if named:
        spark.sparkContext.parallelize(named, min(len(named), shuffle_partitions(spark))).foreachPartition(move)
    return [name for _, name in named]


def _write_remote(
    lines: DataFrame, staging: str, out_dir: str, name_of: Callable[[str, int], str], end: str, gzip: bool
) -> list[str]:
    """Files on any Hadoop file system: a folder per key, its one data file then moved by the driver's threads."""
    spark = lines.sparkSession
    key, value = lines.columns
    writer = lines.select(key, F.col(value).alias("value")).write.partitionBy(key).option("lineSep", end)
    if gzip:
        writer = writer.option("compression", "gzip")
    writer.text(staging)
    fs, _ = _hadoop(spark, out_dir)
    parts = _part_files(spark, staging, 2)
    names = [(name_of(unquote(folder.split("=", 1)[1]), len(parts)), path) for folder, path in parts]
    for parent in {name.rpartition("/")[0] for name, _ in names}:
        fs.mkdirs(_hadoop(spark, f"{out_dir}/{parent}")[1])
    with ThreadPoolExecutor(MOVE_THREADS) as pool:
        for move in [pool.submit(_move, spark, path, f"{out_dir}/{name}") for name, path in names]:
            move.result()
    return [name for name, _ in names]


DOCUMENT = (
    "url array<struct<loc:string,lastmod:string,changefreq:string,priority:string>>, "
    "sitemap array<struct<loc:string,lastmod:string>>, _corrupt string"
)


def sitemap_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Files of both kinds in one scan: ``(file, bytes, kind, malformed, urls, sitemaps)``.

    A file is one record (50 MB by the protocol) and is opened once, plain or gzipped. ``kind`` is that of the root
    element in the sitemap namespace, else ``other``. Of a malformed file the rows that
    are whole are kept.
    """
    space = SITEMAP_NAMESPACE.replace(".", r"\.")

    def root(name: str) -> Column:
        return F.col("value").rlike(rf"""(?s)^[^<]*+(?:<\?.*?\?>\s*+|<!--.*?-->\s*+|<![^>]*+>\s*+)*+<(?:\w+:)?{name}\b[^>]*xmlns(?::\w+)?\s*=\s*["']{space}["']""")

    def whole(name: str) -> Column:
        return F.regexp_extract_all("value", F.lit(rf"(?s)<((?:\w+:)?){name}(?=[\s>])[^>]*>.*?</\1{name}\s*>"), F.lit(0))

    def field(block: Column, name: str) -> Column:
        found = F.regexp_extract(block, rf"(?s)<(?:\w+:)?{name}(?=[\s>])[^>]*>(.*?)</", 1)
        return F.nullif(strip_ws(unescape(F.regexp_replace(found, r"<!\[CDATA\[|\]\]>", ""))), F.lit("")).alias(name)

    def rescued(name: str, *fields: str) -> Column:
        return F.transform(whole(name), lambda b: F.struct(*(field(b, f) for f in fields)))

    parsed = F.from_xml("value", DOCUMENT, {"columnNameOfCorruptRecord": "_corrupt", "ignoreNamespace": "true"})
    files = spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"), "value", parsed.alias("x")
    )
    bad = F.col("x._corrupt").isNotNull()
    rows = F.when(bad, rescued("url", "loc", "lastmod", "changefreq", "priority")).otherwise(F.col("x.url"))
    listed = F.when(bad, rescued("sitemap", "loc", "lastmod")).otherwise(F.col("x.sitemap"))
    return files.select(
        "file",
        "bytes",
        F.when(root("urlset"), "urlset").when(root("sitemapindex"), "index").otherwise("other").alias("kind"),
        bad.alias("malformed"),
        F.coalesce(rows, F.array().cast("array<struct<loc:string,lastmod:string,changefreq:string,priority:string>>")).alias("urls"),
        F.coalesce(listed, F.array().cast("array<struct<loc:string,lastmod:string>>")).alias("sitemaps"),
    )


def _name(file: str = "file") -> Column:
    return F.element_at(F.split(file, "/"), -1)


def _megabytes() -> Column:
    return (F.col("bytes") / F.lit(1048576.0)).alias("file_size_mb")


def validate_sitemaps(
    spark: SparkSession, paths: str | list[str], per_file: int = MAX_URLS_PER_SITEMAP
) -> DataFrame:
    """``(file, kind, urls, valid, file_size_mb)``: each file judged by its kind, within its own row."""

    def located(rows: str) -> Column:
        return F.forall(rows, lambda r: F.coalesce(r["loc"].rlike("^https?://"), F.lit(False)))

    valid = F.when(F.col("kind") == "urlset", (F.size("urls") <= per_file) & located("urls")).otherwise(
        (F.col("kind") == "index") & located("sitemaps")
    )
    return sitemap_documents(spark, paths).select(
        _name().alias("file"),
        "kind",
        (F.size("urls") + F.size("sitemaps")).cast("long").alias("urls"),
        (~F.col("malformed") & valid).alias("valid"),
        _megabytes(),
    )


def sitemap_file_stats(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Per file: size, URLs, and how many carry each optional field; no shuffle."""

    def having(name: str) -> Column:
        return F.size(F.filter("urls", lambda u: u[name].isNotNull())).cast("long").alias(f"has_{name}")

    return sitemap_documents(spark, paths).select(
        _name().alias("file"),
        F.size("urls").cast("long").alias("total_urls"),
        _megabytes(),
        having("lastmod"),
        having("changefreq"),
        having("priority"),
    )


def listing(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """``(path, name, bytes)`` of the files below a folder, from the listing alone: no file is opened."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(folder)
        .select("path", _below(F.col("path"), folder).alias("name"), F.col("length").alias("bytes"))
    )


def file_sizes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Size per file in MB, from the listing alone."""
    return spark.read.format("binaryFile").load(paths).select(
        _name("path").alias("file"), (F.col("length") / F.lit(1048576.0)).alias("file_size_mb")
    )
