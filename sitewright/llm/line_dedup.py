"""Line deduplication: repeated runs of lines are kept once in the whole corpus.

A text is cut at line feeds. Chunks are runs of lines whose borders follow from the lines themselves: a
border stands behind a line where the rolling hash of the last ``WINDOW`` line hashes has a given remainder modulo
``DIVISOR`` (each of ``REMAINDERS`` cuts the text once; with modulus 1 every line is a border, and from each a chunk reaches over
borders until it has ``LONG`` words or ``FINE`` lines, so that short passages are met too), and on both sides of a line of ``LONG`` words or more, a passage of its own. So the
chunks of a passage are the same wherever it stands, whatever surrounds it.

Chunks of several lines, and long lines, that occur again are compared byte by byte (they
are grouped by their text where texts of one hash differ) and all but the first, by id, version and place, are removed. Chunks may overlap: what any of them
covers goes. A line whose chunk is removed stands in the earlier occurrence, so no line is lost altogether.

Chunks are first told apart by hashes of their line hashes, a few numbers each. Texts are taken only of chunks whose hash repeats; a chunk that very many documents hold is reduced before the
shuffle, and its occurrences, without their text, meet the first one in a join that splits hot chunks. Ranges to
remove are a few numbers a document. A text of n lines costs time in proportion to n; it is one value of one task.

Every row stays, in its place. A text with nothing to remove is returned as it is; a null text stays null. A text all of whose lines
repeat becomes empty. Rows with one id and different texts are documents of their own (told apart
by a hash of the text); equal rows are one document and are treated alike. All columns pass
through, but for the names ``__id``, ``__version``, ``__gaps``, ``__last`` and ``__left``, which are used inside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitewright.operators.skew import lookup_join
from sitewright.session import materialize

WINDOW = 2
DIVISOR = 3
REMAINDERS = (0, 1)
FINE = 6
LONG = 50
_PRIME = (1 << 31) - 1
#: Documents with removals whose ranges may be broadcast: about 100 MB.
SMALL = 500_000


def chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, version, start, n, hash) of chunks of several lines and of long lines."""
    lined = (
        docs.where(F.length("text") > 0)
        .select("doc_id", F.xxhash64("text").alias("version"), F.split("text", "\n", -1).alias("lines"))
        .select(
            "doc_id",
            "version",
            F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"),
            F.transform("lines", lambda x: F.length(x) - F.length(F.translate(x, " \t", "")) + 1).alias("words"),
        )
        .withColumn("long", F.transform("words", lambda n: n >= LONG))
    )
    rolling = " + ".join(f"if(i >= {k}, pmod(hashes[greatest(i - {k}, 0)], {_PRIME}), 0) * {31**k}" for k in range(WINDOW))
    rolled = lined.withColumn("rolled", F.expr(f"transform(hashes, (h, i) -> pmod(pmod({rolling}, {_PRIME}), {DIVISOR}))"))
    for r in REMAINDERS:
        ends = F.expr(
            f"""filter(sequence(0, size(hashes) - 1), i -> i = size(hashes) - 1 or long[i] or long[i + 1] or rolled[i] = {r})"""
        )
        cut = F.expr(f"transform(ends{r}, (e, k) -> named_struct('start', if(k = 0, 0, ends{r}[k - 1] + 1), 'stop', e + 1))")
        rolled = rolled.withColumn(f"ends{r}", ends).withColumn(f"cut{r}", cut)
    # With modulus 1 every line ends at a border: chunks reach over borders until they have LONG words.
    reached = [f"aggregate(slice(words, i + 1, {n}), 0, (a, w) -> a + w) >= {LONG}" for n in range(2, FINE)]
    size = " ".join(f"when {test} then {n}" for n, test in zip(range(2, FINE), reached))
    fine = F.expr(
        f"""transform(filter(sequence(0, size(hashes) - 1), i -> not long[i] and i < size(hashes) - 1),
            i -> named_struct('start', i, 'stop', least(size(hashes), i + case {size} else {FINE} end)))"""
    )
    # One number a chunk: Spark tells distinct numbers apart by hashing, structs only pair by pair.
    coded = F.transform(F.concat(*[F.col(f"cut{r}") for r in REMAINDERS], fine), lambda c: c["start"].cast("long") * (1 << 31) + c["stop"])
    every = F.transform(
        F.array_distinct(coded),
        lambda c: F.struct(F.shiftright(c, 31).cast("int").alias("start"), c.bitwiseAND((1 << 31) - 1).cast("int").alias("stop")),
    )
    taken = F.expr(
        """transform(filter(cut, c -> c.stop - c.start > 1 or long[c.start]),
            c -> named_struct('start', c.start, 'n', c.stop - c.start, 'hash', xxhash64(slice(hashes, c.start + 1, c.stop - c.start))))"""
    )
    return rolled.withColumn("cut", every).select("doc_id", "version", F.explode(taken).alias("c")).select("doc_id", "version", "c.*")


def _hint(side: DataFrame) -> DataFrame:
    return F.broadcast(side) if side.count() <= SMALL else side


def _with_text(docs: DataFrame, again: DataFrame) -> DataFrame:
    """(place, n, hash, text) of chunks; only documents that have such chunks are cut again."""
    wanted = materialize(
        again.groupBy(F.col("doc_id").alias("id"), F.col("version").alias("v")).agg(F.collect_list(F.struct("start", "n", "hash")).alias("wanted")), "wanted"
    )
    full = F.expr(
        """transform(wanted, c -> named_struct('start', c.start, 'n', c.n, 'hash', c.hash,
            'text', array_join(slice(lines, c.start + 1, c.n), '\n')))"""
    )
    given = docs.select("doc_id", "text").withColumn("version", F.xxhash64("text"))
    same = given.doc_id.eqNullSafe(F.col("id")) & (given.version == F.col("v"))
    return (
        given.join(_hint(wanted), same)
        .select("doc_id", "version", "wanted", F.split("text", "\n", -1).alias("lines"))
        .select("doc_id", "version", F.explode(full).alias("c"))
        .select(F.struct("doc_id", "version", "c.start").alias("place"), "c.n", "c.hash", "c.text")
    )


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, version, start, stop): lines to remove; ranges of a document may overlap."""
    each = materialize(chunks(docs), "places")
    place = F.struct("doc_id", "version", "start")
    # Equal rows give equal places, so the least and the greatest differ only where the chunk really occurs again.
    shared = (
        each.select("hash", place.alias("p")).groupBy("hash").agg(F.min("p").alias("a"), F.max("p").alias("b")).where("not (a <=> b)").select("hash")
    )
    again = materialize(_with_text(docs, each.join(shared, "hash").distinct()), "chunks")
    # Chunks of one hash have one text, but for collisions: then places meet the first one without any text.
    heads = materialize(
        again.groupBy("hash").agg((F.min("text") == F.max("text")).alias("one"), F.min("place").alias("first")).withColumnRenamed("hash", "__hash"), "heads"
    )
    met = lookup_join(again.select("hash", "place", "n"), heads.where("one").drop("one"), "hash", "__hash", "inner", ["place"]).drop("__hash")
    collided = heads.where("not one").select(F.col("__hash").alias("hash"))
    if not collided.isEmpty():
        mixed = again.join(collided, "hash")
        first = mixed.groupBy("hash", "text").agg(F.min("place").alias("first"))
        met = met.unionByName(mixed.join(first, ["hash", "text"]).select("hash", "place", "n", "first"))
    met = met.where("place <> first")
    return met.select("place.doc_id", "place.version", "place.start", (F.col("place.start") + F.col("n")).alias("stop")).distinct()


def remove_repeats(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` with the text that is left, and ``lines_removed``."""
    doc = Window.partitionBy("doc_id", "version")
    reached = F.coalesce(F.max("stop").over(doc.orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gaps = (
        repeats(docs)
        .withColumn("from", reached)
        .groupBy("doc_id", "version")
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("start") > F.col("from"), F.struct("from", F.col("start").alias("to"))))).alias("__gaps"),
            F.max("stop").alias("__last"),
        )
        .withColumnsRenamed({"doc_id": "__id", "version": "__version"})
    )
    gaps = materialize(gaps, "gaps")
    given = docs.drop("lines_removed")
    same = given.doc_id.eqNullSafe(F.col("__id")) & (F.xxhash64(given.text) == F.col("__version"))
    joined = given.join(_hint(gaps), same, "left")
    lines = F.split("text", "\n", -1)
    # The one-element array binds the lines, so that a text is cut once and not for every gap.
    kept = F.flatten(
        F.transform(
            F.array(lines),
            lambda given: F.concat(
                F.flatten(F.transform("__gaps", lambda g: F.slice(given, g["from"] + 1, g["to"] - g["from"]))),
                F.slice(given, F.col("__last") + 1, F.greatest(F.size(given) - F.col("__last"), F.lit(0))),
            ),
        )
    )
    changed = F.col("__last").isNotNull()
    left = joined.withColumn("__left", F.when(changed, kept))
    return left.select(
        *[F.when(changed, F.array_join("__left", "\n")).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in given.columns],
        F.when(changed, F.size(lines) - F.size("__left")).otherwise(0).alias("lines_removed"),
    )
