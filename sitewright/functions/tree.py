"""Page token tree: where elements end, for markup of any nesting.

A page is one array of tokens (tags, and the text between them). One fold over it keeps the names of
the open elements, so an element ends at its own end tag; an end tag closes what is still open inside, and one that fits
no open element is passed over. What is open at the end of the page ends there. The
fold stays within the page's row: nothing is shuffled, and its state is the open names, not the page.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .url import let

#: What stands between a tag's name and its end: quoted values may hold ``>``.
INSIDE = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+"""
#: Titles and text areas hold text only, whatever it looks like: one token each.
TOKEN = (
    rf"(?is)<(title|textarea)(?=[\s/>]){INSIDE}>.*?</\1\s*+>"
    rf"|</?[a-z][^\s/>]*+{INSIDE}>|[^<]++|<"
)
# Elements without an end tag.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
_TEXT_ONLY = ("title", "textarea")
_NAME = r"^</?([a-zA-Z][^\s/>]*+)"

_STATE = "struct<open:string,at:int,mark:int,begin:int,done:array<struct<begin:int,end:int>>>"


def tokens(markup: Column) -> Column:
    """Tags and texts of a page in their order; together they are the page."""
    return F.regexp_extract_all(markup, F.lit(TOKEN), F.lit(0))


def is_start(token: Column) -> Column:
    return token.rlike("^<[a-zA-Z]")


def start_tags(found: Column, name: str | None = None) -> Column:
    """Start tags among tokens, of one element or of any."""
    if name is None:
        return F.filter(found, is_start)
    return F.filter(found, lambda t: t.rlike(rf"(?i)^<{name}[\s/>]"))


def extents(found: Column, wanted: Callable[[Column], Column]) -> Column:
    """Begin and end (token numbers, both tags outside) of the outermost elements whose start tag is ``wanted``."""
    empty = F.array().cast("array<struct<begin:int,end:int>>")
    zero = F.struct(
        F.lit("/").alias("open"), F.lit(0).alias("at"), F.lit(0).alias("mark"), F.lit(0).alias("begin"), empty.alias("done")
    ).cast(_STATE)

    def state(open_: Column, at: Column, mark: Column, begin: Column, done: Column) -> Column:
        return F.struct(open_.alias("open"), at.alias("at"), mark.alias("mark"), begin.alias("begin"), done.alias("done"))

    def span(s: Column) -> Column:
        return F.array(F.struct(s["begin"].alias("begin"), s["at"].alias("end")))

    def after_start(s: Column, t: Column) -> Column:
        name = F.lower(F.regexp_extract(t, _NAME, 1))

        def opened(n: Column) -> Column:
            stays = ~n.isin(*VOID, *_TEXT_ONLY) & ~t.endswith("/>")
            names = F.concat(F.lit("/"), n, s["open"])
            enters = (s["mark"] == 0) & wanted(t)
            return F.when(
                stays,
                state(
                    names, s["at"] + 1,
                    F.when(enters, F.length(names)).otherwise(s["mark"]),
                    F.when(enters, s["at"]).otherwise(s["begin"]),
                    s["done"],
                ),
            ).otherwise(passed(s))

        return let(name, opened)

    def after_end(s: Column, t: Column) -> Column:
        # The innermost open element of the name is the first in the list of open names.
        key = F.concat(F.lit("/"), F.lower(F.regexp_extract(t, _NAME, 1)), F.lit("/"))

        def closed(k: Column) -> Column:
            names = F.when(
                F.instr(s["open"], k) > 0,
                F.substring(s["open"], F.instr(s["open"], k) + F.length(k) - 1, F.length(s["open"])),
            ).otherwise(s["open"])

            def left(rest: Column) -> Column:
                ends = F.length(rest) < s["mark"]
                return state(
                    rest, s["at"] + 1,
                    F.when(ends, F.lit(0)).otherwise(s["mark"]),
                    s["begin"],
                    F.when(ends, F.concat(s["done"], span(s))).otherwise(s["done"]),
                )

            return let(names, left)

        return let(key, closed)

    def passed(s: Column) -> Column:
        return state(s["open"], s["at"] + 1, s["mark"], s["begin"], s["done"])

    def step(s: Column, t: Column) -> Column:
        return F.when(is_start(t), after_start(s, t)).when(t.rlike("^</[a-zA-Z]"), after_end(s, t)).otherwise(passed(s)).cast(_STATE)

    def finish(s: Column) -> Column:
        return F.when(s["mark"] > 0, F.concat(s["done"], span(s))).otherwise(s["done"])

    return F.aggregate(found, zero, step, finish)


def contents(found: Column, wanted: Callable[[Column], Column]) -> Column:
    """The tokens inside each outermost element whose start tag is ``wanted``: an array an element."""
    return F.transform(
        extents(found, wanted), lambda e: F.slice(found, e["begin"] + 2, e["end"] - e["begin"] - 1)
    )
