"""Personal data: base patterns that always count, and further spans chosen by boosted trees.

Base kinds (email, ip, card, phone) are found by fixed patterns, leftmost and non-overlapping within a kind, and checked
(parts up to 255, Luhn, number of digits); what fails is dropped. On top, generators of high recall
propose spans that may overlap anything: addresses in disguise (``mail``), any run of seven or more digits
with separators (``number``), long strings with digits (``secret``). Gradient-boosted trees score every proposal from its format and
its surroundings. Nobody labels such spans, so the trees learn from what is certain: a proposal is
positive if it meets a checked base span, has the shape of an access key, stands behind a cue such as ``password=``, is
an address with a bracketed "at" or a number behind a cue of contact or account such as ``tel:``.
Whether a check succeeded is no feature. A threshold for each generator is calibrated on a fifth of
the documents that the trees don't see: the lowest score down to which at least ``PRECISION`` of the proposals at every
score are positive. Proposals above it that meet no base span are added.

All candidates are counted, in all documents; the counts go to the driver as a table of at most
``LARGEST`` rows (the product of the feature ranges). Positions are sums of the lengths of pieces, so texts are scanned and never
shuffled: only spans and one row per document are. All is DataFrame code.

Very long texts and matches are scanned once, without recursion; no pattern has a length limit. Positions are code points, ends exclusive. A null or empty text has no spans; every row is
returned, repeated ones too; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewright.llm import boost
from sitewright.llm.common import texts
from sitewright.session import materialize

KINDS = ["email", "ip", "card", "phone", "mail", "number", "secret"]
BASE = KINDS[:4]
# The guards and possessive quantifiers change no match; they keep long runs from being scanned again and again, and
# repeated groups from being matched by recursion, which a very long match would not survive.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "mail": r"(?i)(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++ ?(?:@|[(\[{] ?at ?[)\]}]) ?[\p{L}\p{N}-]++(?: ?(?:\.|[(\[{] ?dot ?[)\]}]) ?[\p{L}\p{N}-]++)++",
    "number": r"(?<![\p{L}\p{N}])[+(]{0,2}[0-9](?:[\x20().:/_-]{0,2}[0-9]){6,}+(?![\p{L}\p{N}])",
    "secret": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{16,}+",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
SECRET_CUE = r"(?i)(?:password|passwd|pwd|token|secret|api[_-]?key)[\x20\x22'=:]*$"
CONTACT_CUE = r"(?i)(?:tel|phone|call|fax|mobile|mail|contact|card|iban|account)[\x20.:#]*$"
PRECISION = 0.97
AROUND = 24
FEATURES = {"generator": 3, "length": 6, "digits": 5, "capitals": 3, "marks": 16, "ahead": 4, "behind": 4, "cue": 3}
LARGEST = 207_360


def _luhn(match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    reverse = F.reverse(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda a, i: a + F.when(i % 2 == 1, F.substring(reverse, i, F.lit(1)).cast("int")).otherwise(
            (F.substring(reverse, i, F.lit(1)).cast("int") * 2) % 10 + F.when(F.substring(reverse, i, F.lit(1)).cast("int") > 4, 1).otherwise(0)
        ),
    )
    return F.when(n.between(12, 19), total % 10 == 0).otherwise(False)


def valid(kind: Column, match: Column) -> Column:
    n_digits = F.length(F.regexp_replace(match, "[^0-9]", ""))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))
        .when(kind == "card", _luhn(match))
        .when(kind == "phone", n_digits.between(9, 15))
        .otherwise(False)
    )


def _proposals(kind: str) -> Column:
    """Matches of a kind, each with the length of the gap before it and what surrounds it."""
    pattern = F.lit(PATTERNS[kind])
    found = F.regexp_extract_all("text", pattern, F.lit(0))
    # The pair is bound in a one-element array, so that a text is cut once and not for every match.
    both = F.array(F.struct(F.split("text", PATTERNS[kind], -1).alias("gaps"), found.alias("found")))
    rows = F.flatten(
        F.transform(
            both,
            lambda b: F.transform(
                b["found"],
                lambda m, i: F.struct(
                    F.lit(kind).alias("kind"),
                    i.alias("i"),
                    F.length(b["gaps"][i]).alias("gap"),
                    m.alias("match"),
                    F.right(b["gaps"][i], F.lit(AROUND)).alias("before"),
                    F.left(b["gaps"][i + 1], F.lit(1)).alias("after"),
                ),
            ),
        )
    )
    there = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+"))}.get(kind, F.lit(True))
    nothing = F.array().cast("array<struct<kind:string,i:int,gap:int,match:string,before:string,after:string>>")
    return F.when(there, rows).otherwise(nothing)


def candidates(docs: DataFrame) -> DataFrame:
    """A row per match (row, doc_id, kind, start, end, match, before, after, base), and one without kind per document."""
    document = F.array(F.struct(*[F.lit(None).cast(t).alias(c) for c, t in (("kind", "string"), ("i", "int"), ("gap", "int"), ("match", "string"), ("before", "string"), ("after", "string"))]))
    each = (
        texts(docs)
        .withColumn("row", F.monotonically_increasing_id())
        .select("row", "doc_id", F.explode(F.concat(document, *[_proposals(k) for k in KINDS])).alias("c"))
        .select("row", "doc_id", "c.*")
    )
    so_far = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    length = F.length("match")
    placed = each.withColumn("end", F.sum(F.col("gap") + length).over(so_far)).withColumn("start", F.col("end") - length)
    return placed.select("row", "doc_id", "kind", "start", "end", "match", "before", "after", F.coalesce(valid(F.col("kind"), F.col("match")), F.lit(False)).alias("base"))


def _share(pattern: str, parts: int) -> Column:
    left = F.length(F.regexp_replace("match", pattern, ""))
    return F.floor((F.length("match") - left) * parts / F.length("match")).cast("int")


def _features() -> dict[str, Column]:
    has = lambda p: F.col("match").rlike(p).cast("int")
    ahead = F.right("before", F.lit(1))
    kind_of = lambda c, last: F.when((c == "") | c.rlike(r"\s"), 0).when(c.rlike(r"[\p{L}\p{N}]"), 1).when(c.rlike(last), 2).otherwise(3)
    return {
        "generator": F.when(F.col("kind") == "mail", 0).when(F.col("kind") == "number", 1).otherwise(2),
        "length": F.least(F.lit(5), F.greatest(F.lit(0), F.floor(F.log2(F.length("match"))).cast("int") - 2)),
        "digits": _share("[0-9]", 4),
        "capitals": _share("[A-Z]", 2),
        "marks": has(r"\.") + 2 * has(r"[\x20-]") + 4 * has(r"[+()]") + 8 * has("@"),
        "ahead": kind_of(ahead, r"[=:\x22']"),
        "behind": kind_of(F.col("after"), r"[.,;!?]"),
        "cue": F.when(F.col("before").rlike(SECRET_CUE), 1).when(F.col("before").rlike(CONTACT_CUE), 2).otherwise(0),
    }


def _weighed(found: DataFrame) -> DataFrame:
    """Matches with ``meets`` (overlaps a base span), the features and the certain label."""
    by_start = Window.partitionBy("row").orderBy("start")
    base_end, base_start = F.when(F.col("base"), F.col("end")), F.when(F.col("base"), F.col("start"))
    reached = F.max(base_end).over(by_start.rangeBetween(Window.unboundedPreceding, 0))
    following = F.min(base_start).over(by_start.rangeBetween(0, Window.unboundedFollowing))
    meets = F.coalesce(reached > F.col("start"), F.lit(False)) | F.coalesce(following < F.col("end"), F.lit(False))
    certain = (
        F.when(F.col("kind") == "secret", F.col("match").rlike("^AKIA[0-9A-Z]{16}$") | F.col("before").rlike(SECRET_CUE))
        .when(F.col("kind") == "mail", ~F.contains("match", F.lit("@")))  # the pattern asks for a bracketed "at" then
        .when(F.col("kind") == "number", F.col("before").rlike(CONTACT_CUE))
        .otherwise(False)
    )
    return found.where("kind is not null").withColumn("meets", meets).withColumns(_features()).withColumn("label", (F.col("meets") | certain).cast("int"))


def model(weighed: DataFrame) -> tuple[list[boost.Tree], list[float]]:
    """Trees, and the least score for each generator."""
    names = list(FEATURES)
    held = (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0) & F.col("doc_id").isNotNull()
    counts = (
        weighed.where(~F.col("kind").isin(BASE)).groupBy(held.alias("held"), *names).agg(F.sum("label").alias("y"), F.count("*").alias("n")).collect()
    )
    rows = sorted((tuple(r[c] for c in names), float(r.y), float(r.n), r.held) for r in counts)
    trees = boost.fit([r[:3] for r in rows if not r[3]])
    limits = []
    for g in range(FEATURES["generator"]):
        scored: dict[float, list[float]] = {}
        for x, y, n, is_held in rows:
            if is_held and x[0] == g:
                s = scored.setdefault(round(boost.predict(trees, x), 9), [0.0, 0.0])
                s[0] += y
                s[1] += n
        limit = float("inf")
        for s in sorted(scored, reverse=True):
            y, n = scored[s]
            if (y + 1) / (n + 1) < PRECISION:
                break
            limit = s - 1e-6
        limits.append(limit)
    return trees, limits


def spans(docs: DataFrame) -> DataFrame:
    """(row, doc_id, kind, start, end, base) of chosen spans, and one row without kind per document."""
    found = materialize(candidates(docs), "spans")
    weighed = _weighed(found)
    trees, limits = model(weighed)
    score = boost.expression(trees, list(FEATURES)) if trees else F.lit(float("-inf"))
    limit = F.element_at(F.array(*[F.lit(x) for x in limits]), F.col("generator") + 1)
    more = weighed.where(~F.col("kind").isin(BASE) & ~F.col("meets")).withColumn("score", score).where(F.col("score") >= limit)
    chosen = weighed.where("base").select("row", "doc_id", "kind", "start", "end", "base").union(more.select("row", "doc_id", "kind", "start", "end", "base"))
    return found.where("kind is null").select("row", "doc_id", "kind", "start", "end", "base").union(chosen)


def per_document(found: DataFrame) -> DataFrame:
    """Counts, digest and list of spans of every document."""
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct("start", order.alias("o"), "end", F.concat_ws(":", "kind", "start", "end").alias("s"))
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["s"]), ",")
    return (
        found.groupBy("row", "doc_id")
        .agg(
            *[F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in BASE],
            F.count("kind").alias("n_spans"),
            F.count(F.when(F.col("kind").isNotNull() & ~F.col("base"), 1)).alias("n_added"),
            F.sha2(listed(F.when(F.col("base"), span)), 256).alias("base_sha256"),
            listed(F.when(F.col("kind").isNotNull(), span)).alias("spans"),
        )
        .drop("row")
    )
