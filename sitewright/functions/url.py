"""URL column functions: split, resolve, normalise, test.

Every function takes and returns Columns and uses Spark built-ins only. URLs are
handled as a struct ``(scheme, netloc, path, query, fragment)`` so that one regex
pass serves all later steps; ``let`` binds an intermediate value once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import Rules, SAME_SITE_BLOCKED

# RFC 3986 appendix B, with the scheme held to its own grammar (section 3.1).
URL_REGEX = (
    r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
)
PART_NAMES = ("scheme", "netloc", "path", "query", "fragment")
DOT_SEGMENT = r"(^|/)\.\.?(/|$)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.transform(F.array(value), body)[0]


def url_parts(scheme, netloc, path, query, fragment) -> Column:
    return F.struct(
        *(c.alias(n) for n, c in zip(PART_NAMES, (scheme, netloc, path, query, fragment)))
    )


def url_split(url: Column | str) -> Column:
    """URL text to its parts. Missing parts are empty, the scheme is lower case."""
    # Leading blanks and any tab or line break are no part of a URL; a line break
    # is therefore free to serve as the separator between the matched groups.
    clean = F.regexp_replace(_col(url), r"^[\x00-\x20]+|[\t\r\n]", "")
    groups = F.split(F.regexp_replace(clean, URL_REGEX, "$1\n$2\n$3\n$4\n$5"), "\n", -1)
    return let(
        groups,
        lambda g: url_parts(F.lower(g[0]), g[1], g[2], g[3], g[4]),
    )


def unsplit_parts(u: Column) -> Column:
    """Parts back to text; an empty query or fragment leaves no ``?`` or ``#``."""
    path = F.when(
        (u.netloc != "") & (u.path != "") & ~u.path.startswith("/"), F.concat(F.lit("/"), u.path)
    ).otherwise(u.path)
    authority = (
        F.when(u.netloc != "", F.concat(F.lit("//"), u.netloc))
        .when(u.path.startswith("//"), F.lit("//"))
        .when(
            u.scheme.isin("http", "https", "ftp", "file")
            & ((u.path == "") | u.path.startswith("/")),
            F.lit("//"),
        )
        .otherwise(F.lit(""))
    )
    return F.concat(
        F.when(u.scheme != "", F.concat(u.scheme, F.lit(":"))).otherwise(F.lit("")),
        authority,
        path,
        F.when(u.query != "", F.concat(F.lit("?"), u.query)).otherwise(F.lit("")),
        F.when(u.fragment != "", F.concat(F.lit("#"), u.fragment)).otherwise(F.lit("")),
    )


def _fold_dots(path: Column) -> Column:
    segments = F.split(path, "/", -1)
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    ends_on_dots = F.element_at(segments, -1).isin(".", "..")
    return F.array_join(
        F.when(ends_on_dots, F.concat(folded, F.array(F.lit("")))).otherwise(folded), "/"
    )


def _drop_empty_params(path: Column) -> Column:
    return F.when(
        path.endswith(";"), F.regexp_replace(path, r"(?s)^((?:.*/)?[^/;]*);$", "$1")
    ).otherwise(path)


def resolve_parts(base: Column, ref: Column) -> Column:
    """Reference parts against base parts, as RFC 3986 section 5 has it."""
    ref_path = _drop_empty_params(ref.path)
    rooted = ref.path.startswith("/")
    merged = F.when(rooted, ref_path).otherwise(
        F.regexp_replace(
            F.concat(
                F.when(base.path == "", F.lit("/")).otherwise(
                    F.regexp_replace(base.path, "[^/]*$", "")
                ),
                ref_path,
            ),
            "/{2,}",
            "/",
        )
    )
    path = F.when(ref.path == "", base.path).otherwise(
        let(
            merged,
            lambda m: let(
                F.when(m.rlike(DOT_SEGMENT), _fold_dots(m)).otherwise(m),
                lambda p: F.when(p == "", F.lit("/"))
                .when((base.netloc != "") & ~p.startswith("/"), F.concat(F.lit("/"), p))
                .otherwise(p),
            ),
        )
    )
    query = F.when((ref.path == "") & (ref.query == ""), base.query).otherwise(ref.query)
    return (
        F.when((ref.scheme != "") & (ref.scheme != base.scheme), ref)
        .when(
            ref.netloc != "",
            url_parts(base.scheme, ref.netloc, ref_path, ref.query, ref.fragment),
        )
        .otherwise(url_parts(base.scheme, base.netloc, path, query, ref.fragment))
    )


def url_resolve(ref: Column | str, base: Column | str) -> Column:
    """Absolute form of ``ref`` seen from ``base``."""
    ref, base = _col(ref), _col(base)
    joined = let(
        F.struct(url_split(base).alias("b"), url_split(ref).alias("r")),
        lambda x: F.when((x.r.scheme != "") & (x.r.scheme != x.b.scheme), ref).otherwise(
            let(resolve_parts(x.b, x.r), unsplit_parts)
        ),
    )
    return F.when(base == "", ref).when(ref == "", base).otherwise(joined)


def form_encode(text: Column) -> Column:
    """Form encoding of one key or value: ``_.-~`` stay, a blank becomes ``+``."""
    return F.replace(
        F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")
    )


def percent_decode(text: Column) -> Column:
    """Decode percent escapes, leaving a malformed escape as it stands."""
    shielded = F.replace(text, F.lit("+"), F.lit("%2B"))
    return F.try_url_decode(F.regexp_replace(shielded, r"%(?![0-9A-Fa-f]{2})", "%25"))


def form_decode(text: Column) -> Column:
    return F.try_url_decode(F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25"))


def query_pairs(query: Column) -> Column:
    """Query string to ``array<struct<k, i, v>>``; duplicate keys are legal."""
    pieces = F.filter(F.split(query, "&", -1), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p, i: F.struct(
            form_decode(F.substring_index(p, "=", 1)).alias("k"),
            i.alias("i"),
            F.when(
                F.contains(p, F.lit("=")), form_decode(F.regexp_replace(p, "(?s)^[^=]*=", ""))
            )
            .otherwise(F.lit(""))
            .alias("v"),
        ),
    )


def sorted_query(query: Column) -> Column:
    pairs = F.array_sort(query_pairs(query))
    text = F.array_join(
        F.transform(
            pairs, lambda p: F.concat(form_encode(p.k), F.lit("="), form_encode(p.v))
        ),
        "&",
    )
    return F.when(query == "", query).otherwise(text)


def _split_params(path: Column) -> Column:
    """Path to (path, params): params follow the first ``;`` of the last segment."""
    return F.struct(
        F.regexp_extract(path, r"(?s)^((?:.*/)?[^/;]*)(?:;[^/]*)?$", 1).alias("path"),
        F.regexp_extract(path, r"(?s)^(?:.*/)?[^/;]*;([^/]*)$", 1).alias("params"),
    )


def normalize_parts_standard(u: Column) -> Column:
    """No fragment, query sorted by key and re-encoded, no trailing slash."""

    def strip(path: Column) -> Column:
        return F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))

    path = F.when(
        F.contains(u.path, F.lit(";")),
        let(
            _split_params(u.path),
            lambda s: F.concat(
                strip(s.path),
                F.when(s.params != "", F.concat(F.lit(";"), s.params)).otherwise(F.lit("")),
            ),
        ),
    ).otherwise(strip(u.path))
    return let(
        url_parts(u.scheme, u.netloc, path, sorted_query(u.query), F.lit("")), unsplit_parts
    )


def normalize_parts_fast(u: Column) -> Column:
    """No fragment or params, query kept as is, trailing slash of the whole text cut."""

    def text(path: Column) -> Column:
        full = F.concat(
            u.scheme,
            F.lit("://"),
            u.netloc,
            path,
            F.when(u.query != "", F.concat(F.lit("?"), u.query)).otherwise(F.lit("")),
        )
        return let(
            full,
            lambda f: F.when(
                f.endswith("/") & (F.length(path) > 1), F.regexp_replace(f, "/+$", "")
            ).otherwise(f),
        )

    plain_path = F.when(
        F.contains(u.path, F.lit(";")), _split_params(u.path).path
    ).otherwise(u.path)
    return let(plain_path, text)


def normalize_parts(u: Column, rules: Rules) -> Column:
    if rules.normalization == "standard":
        return normalize_parts_standard(u)
    return normalize_parts_fast(u)


def url_normalize(url: Column | str, base: Column | str | None = None) -> Column:
    """Canonical text of a URL (standard rules)."""
    target = url_resolve(url, base) if base is not None else _col(url)
    return let(url_split(target), normalize_parts_standard)


def url_normalize_fast(url: Column | str, base: Column | str | None = None) -> Column:
    """Canonical text of a URL (fast rules)."""
    target = url_resolve(url, base) if base is not None else _col(url)
    return let(url_split(target), normalize_parts_fast)


def normalize(url: Column | str, rules: Rules, base: Column | str | None = None) -> Column:
    if rules.normalization == "standard":
        return url_normalize(url, base)
    return url_normalize_fast(url, base)


# The plain lookups below match one group each instead of splitting the whole URL.

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"


def url_scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(_col(url), _SCHEME, 1))


def url_domain(url: Column | str) -> Column:
    """Lower-case authority, port and user part included."""
    return F.lower(F.regexp_extract(_col(url), _NETLOC, 1))


def url_path(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), URL_REGEX, 3)


def url_origin(url: Column | str) -> Column:
    """``scheme://authority``, the scheme in lower case."""
    authority = F.regexp_extract(_col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*(://[^/?#]*)", 1)
    return F.concat(url_scheme(url), authority)


def is_valid_url(url: Column | str) -> Column:
    return _col(url).rlike(r"^(?i:https?)://[^/?#]")


def is_same_site(url: Column | str, base: Column | str) -> Column:
    """Same host give or take ``www.``, http(s), and no blocked file type."""
    url = _col(url)
    host, home = url_domain(url), url_domain(base)
    blocked = "(?i)(" + "|".join(e.replace(".", r"\.") for e in SAME_SITE_BLOCKED) + r")\z"
    return (
        (
            (host == home)
            | (host == F.concat(F.lit("www."), home))
            | (host == F.replace(home, F.lit("www."), F.lit("")))
        )
        & url_scheme(url).isin("http", "https")
        & ~url.rlike(blocked)
    )


def is_target_domain(url: Column | str, rules: Rules) -> Column:
    return url_domain(url).isin(*rules.hosts)


def _any_of(patterns: tuple[str, ...]) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def should_skip_url(url: Column | str, rules: Rules) -> Column:
    return _col(url).rlike(_any_of(rules.skip))


def is_dynamic_url(url: Column | str, rules: Rules) -> Column:
    return _col(url).rlike(_any_of(rules.dynamic))


def matches_any(url: Column | str, patterns: tuple[str, ...]) -> Column:
    return _col(url).rlike(_any_of(patterns))
