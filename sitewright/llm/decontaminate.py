"""Benchmark decontamination: documents that contain a test item, whole or in part.

Texts are lower-cased and cut into words of letters and digits; an item's shingles are its distinct
runs of ``WIDTH`` words (the whole item where it is shorter). A document contains an item if it holds
at least ``percent`` of the item's shingles.

Search by MinHash containment: the sketch of an item is its shingles of smallest hash, and a document is
a candidate if it holds one of them, however long it is. Items are partitioned by size, in powers of two; within
a part the sketch has one shingle more than a document may lack, so by the pigeonhole principle no
containing document is missed, and documents too short for a part are not looked up in it. Sketches are a few rows
an item: where they are small Spark broadcasts them and documents stay where they are; else both sides
are shuffled by hash. Candidates are then verified by the words themselves.

Null and empty texts and items have no shingles and match nothing. Rows with one id and different texts are told apart
by ``version``; equal rows count once. Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.session import materialize

WIDTH = 5
PERCENT = 80
#: Candidates of about 30 bytes that may be broadcast: 15 MB.
SMALL = 500_000


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def version(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def hashes(words: str, width: int) -> Column:
    """Hash of every run of ``width`` words."""
    run = ", ".join(f"{words}[i + {k}]" for k in range(width))
    return F.expr(
        f"if(size({words}) < {width}, cast(array() as array<bigint>), transform(sequence(0, size({words}) - {width}), i -> xxhash64({width}, {run})))"
    )


def runs(words: str, width: Column) -> Column:
    """Every run of ``width`` words as text."""
    return F.when(F.size(words) < width, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), lambda i: F.array_join(F.slice(F.col(words), i, width), " "))
    )


def item_shingles(items: DataFrame) -> DataFrame:
    """(item_id, words, width, shingles) of items that have words."""
    return (
        items.select("item_id", word_list(F.col("text")).alias("words"))
        .where(F.size("words") > 0)
        .distinct()
        .withColumn("width", F.least(F.size("words"), F.lit(WIDTH)))
        .withColumn("shingles", F.array_distinct(runs("words", F.col("width"))))
    )


def sketches(items: DataFrame, percent: int) -> DataFrame:
    """(item_id, width, hash, least): the shingles to look for and the words a document must have."""
    every = F.array_distinct(
        F.when(F.col("width") == WIDTH, hashes("words", WIDTH)).when(F.col("width") == 4, hashes("words", 4))
        .when(F.col("width") == 3, hashes("words", 3)).when(F.col("width") == 2, hashes("words", 2)).otherwise(hashes("words", 1))
    )
    part_size = F.pow(F.lit(2), F.ceil(F.log2(F.size("all")))).cast("int")  # the largest size in the item's part
    part_least = F.floor(part_size / 2).cast("int") + F.when(part_size == 1, 1).otherwise(1)
    lacking = F.floor(part_size * (100 - percent) / 100).cast("int")
    return (
        items.select("item_id", "width", F.array_sort(every).alias("all"))
        .withColumn("least", F.greatest(F.lit(1), F.ceil(F.least(part_least, F.size("all")) * percent / 100).cast("int")))
        .select("item_id", "width", "least", F.explode(F.slice("all", F.lit(1), lacking + 1)).alias("hash"))
    )


def contained(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, version, item_id, n_shared, n_shingles) of documents and the items they contain."""
    spark = docs.sparkSession
    tests = materialize(item_shingles(items), "items")
    sketch = materialize(sketches(tests, percent), "sketches")
    widths = [r.width for r in tests.select("width").distinct().collect()]  # five at most
    words = docs.select("doc_id", version(F.col("text")).alias("version"), word_list(F.col("text")).alias("words"))
    candidates = None
    for width in sorted(widths):
        each = words.select("doc_id", "version", F.size("words").alias("n"), F.explode(hashes("words", width)).alias("hash"))
        own = sketch.where(F.col("width") == width).select("item_id", "hash", "least")
        hit = each.join(own, "hash").where(F.col("n") - (width - 1) >= F.col("least")).select("doc_id", "version", "item_id")
        candidates = hit if candidates is None else candidates.union(hit)
    if candidates is None:
        return spark.createDataFrame([], "doc_id long, version long, item_id long, n_shared int, n_shingles int")
    candidates = materialize(candidates.distinct(), "candidates")
    found = candidates.join(tests.select("item_id", "width", "shingles"), "item_id")
    found = found.withColumnRenamed("doc_id", "id").withColumnRenamed("version", "v")
    if candidates.count() <= SMALL:
        ids = F.broadcast(candidates.select(F.col("doc_id").alias("id"), F.col("version").alias("v")).distinct())
    else:
        ids = candidates.select(F.col("doc_id").alias("id"), F.col("version").alias("v")).distinct()
    given = docs.select("doc_id", "text").withColumn("version", version(F.col("text")))
    same = given.doc_id.eqNullSafe(F.col("id")) & (given.version == F.col("v"))
    texts = given.join(ids, same, "left_semi").distinct()
    texts = materialize(texts.select("doc_id", "version", word_list(F.col("text")).alias("words")), "candidate-words")
    checked = texts.join(found, texts.doc_id.eqNullSafe(F.col("id")) & (texts.version == F.col("v"))).select(
        "doc_id",
        "version",
        "item_id",
        F.size(F.array_intersect("shingles", runs("words", F.col("width")))).alias("n_shared"),
        F.size("shingles").alias("n_shingles"),
    )
    return checked.where(F.col("n_shared") * 100 >= F.col("n_shingles") * percent)


def clean(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no item."""
    found = materialize(contained(docs, items, percent).select(F.col("doc_id").alias("id"), F.col("version").alias("v")).distinct(), "contaminated")
    small = found.count() <= SMALL
    given = docs.withColumn("__version", version(F.col("text")))
    same = given.doc_id.eqNullSafe(F.col("id")) & (F.col("__version") == F.col("v"))
    return given.join(F.broadcast(found) if small else found, same, "left_anti").drop("__version")
