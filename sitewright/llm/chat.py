"""Chat formatting with a reversible template, in Spark expressions only.

A conversation becomes one string::

    <|im_start|>role
    text<|im_sep|>text<|im_end|>
    <|im_start|>role
    ...

Adjacent turns of one role are merged into one block, their texts parted by ``<|im_sep|>``.
Texts and roles may hold control strings themselves: every ``<``, run of backslashes, ``|``
gets one more backslash, so ``<|`` never occurs inside them, and taking one away again gives
the text back. In a role, backslash and line feed are written ``\\b`` and ``\\n`` first.

The loss mask is a second string of as many characters: those of assistant texts (escaped,
without markers) as they are, and ``IGNORED`` for all that is not learned. That character is
written ``<|0|>`` inside texts and roles. ``read_back`` gives turns and masked text from the
output alone. All steps take time in proportion to a conversation's length.

Rows of a conversation are sorted by turn, null turns first, then role and text; repeated rows
are turns of their own. Null roles and texts count as empty; null conv_id is a conversation.
A conversation is one record of training data, so one row holds it whole; everything else is
narrow: one shuffle by conv_id. Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LEARNED = "assistant"
IGNORED = "\x00"


def escape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|"), F.lit(IGNORED), F.lit("<|0|>"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("<|0|>"), F.lit(IGNORED)), r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def format_chats(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, labels): the output, and the characters of it that are learned."""
    turns = (
        rows.select(
            "conv_id",
            F.struct(
                F.col("turn"),
                escape_role(F.coalesce(F.col("role"), F.lit(""))).alias("role"),
                escape(F.coalesce(F.col("text"), F.lit(""))).alias("text"),
            ).alias("turn"),
        )
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    )
    # Whether a turn goes on with the role before it decides what stands in front of its text.
    before = F.expr(
        f"""transform(turns, (t, i) ->
            case when i = 0 then concat('{START}', t.role, '\\n')
                 when turns[i - 1].role = t.role then '{SEP}'
                 else concat('{END}\\n{START}', t.role, '\\n') end)"""
    )
    framed = turns.select("conv_id", "turns", before.alias("fronts"))
    whole = F.expr(f"concat(array_join(transform(turns, (t, i) -> concat(fronts[i], t.text)), ''), '{END}\\n')")
    labels = F.expr(
        f"""array_join(transform(turns, (t, i) -> concat(repeat('{IGNORED}', length(fronts[i])),
            if(t.role = '{LEARNED}', t.text, repeat('{IGNORED}', length(t.text))))), '')"""
    )
    labels = F.concat(labels, F.lit(IGNORED * (len(END) + 1)))
    return framed.select("conv_id", whole.alias("formatted"), labels.alias("labels"))


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, turns, learned, formatted_chars): roles and texts as they were, and the text under the mask."""
    blocks = F.expr(f"filter(split(formatted, '{_literal(START)}'), (b, i) -> i > 0)")
    parsed = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substring(b, F.instr(b, "\n") + 1, F.length(b) - F.instr(b, "\n") - len(END) - 1), _literal(SEP)),
                lambda t: F.struct(unescape_role(F.substring_index(b, "\n", 1)).alias("role"), unescape(t).alias("text")),
            ),
        )
    )
    learned = F.array_join(F.transform(F.split("labels", r"\x00+"), unescape), "")
    return chats.select("conv_id", parsed.alias("turns"), learned.alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))


def _literal(marker: str) -> str:
    return marker.replace("|", "[|]")


def digests(read: DataFrame) -> DataFrame:
    """The figures of ``read_back`` per conversation."""
    spelled = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spelled, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
    )
