"""Chat training text from turns, by relational operators only.

The turns of a conversation are collected as structs and sorted, neighbours of
one role are merged into a block, and the blocks are joined into one text:

    <|im_start|>ROLE NEWLINE text <|im_sep|> text <|im_end|> NEWLINE ...

Control strings all begin with ``<|``.  Inside texts and roles a ``<`` that any
number of backslashes and a ``|`` follow gets one backslash more, so an escaped
text never holds ``<|``, and taking one backslash away gives the text again.  A
newline in a role becomes ``<|nl|>``.

The loss mask is a list of spans in code points of the formatted text, one for
each text of the trained roles, without the marks around it.

Only DataFrame functions: no row leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings of the template.
START = "<|im_start|>"
END = "<|im_end|>\n"
SEPARATOR = "<|im_sep|>"
ROLE_NEWLINE = "<|nl|>"

GROUP = 256  # numbers summed in one step of running_totals


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit(ROLE_NEWLINE))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit(ROLE_NEWLINE), F.lit("\n")))


def _added(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda total, x: total + x)


def running_totals(values: Column) -> Column:
    """For each number of an array the sum of those before it.

    Arrays only grow by copying, so sums are taken in groups; the work is near
    linear up to tens of thousands of numbers.
    """
    groups = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / GROUP) - 1, F.lit(0)).cast("int")),
        lambda g: F.slice(values, g * GROUP + 1, GROUP))
    none = F.array().cast("array<bigint>")

    def within(group: Column, start: Column) -> Column:
        grown = F.aggregate(
            group, F.struct(start.alias("at"), none.alias("all")),
            lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")))
        return grown["all"]

    summed = F.aggregate(
        groups, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<bigint>>").alias("all")),
        lambda acc, g: F.struct((acc["at"] + _added(g)).alias("at"), F.concat(acc["all"], F.array(within(g, acc["at"]))).alias("all")))
    return F.flatten(summed["all"])


def formatted_conversations(turns: DataFrame, trained: Sequence[str] = ("assistant",)) -> DataFrame:
    """``conv_id, formatted, loss_spans`` (array of ``begin, end``) of each conversation.

    ``turns`` has ``conv_id, turn, role, text``; other columns are ignored.  A
    null role or text is empty.  Turns come in the order of turn (null first),
    then role and text, so ties and repeated rows, which are all kept, have one
    result.  Rows without a ``conv_id`` make up one conversation without id.  An
    empty table gives no row.  A conversation is one row, so its formatted text
    has to fit Spark's limit for a string (2 GB).
    """
    rows = turns.select(
        "conv_id", F.struct(
            F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("_turn"))
    sorted_ = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    plain = sorted_.select("conv_id", F.transform("_turns", lambda t: F.struct(
        escaped_role(t["role"]).alias("role"), escaped(t["text"]).alias("text"),
        t["role"].isin(*trained).alias("trained"))).alias("_turns"))
    turn = lambda i: F.get(F.col("_turns"), i)
    starts = F.filter(F.sequence(F.lit(0), F.size("_turns") - 1), lambda i: (i == 0) | (turn(i)["role"] != turn(i - 1)["role"]))
    ends = F.concat(F.slice("_starts", F.lit(2), F.size("_starts")), F.array(F.size("_turns")))
    merged = plain.withColumn("_starts", starts).withColumn("_ends", ends).select("conv_id", F.zip_with(
        "_starts", "_ends", lambda lo, hi: F.struct(
            turn(lo)["role"].alias("role"), turn(lo)["trained"].alias("trained"),
            F.transform(F.slice("_turns", lo + 1, hi - lo), lambda t: t["text"]).alias("texts"))).alias("_blocks"))
    # In front of every text stands its separator, or its block's head and, but for the first, the end of the block before.
    pieces = F.flatten(F.transform("_blocks", lambda b, i: F.transform(b["texts"], lambda t, j: F.struct(
        F.when(j > 0, F.lit(SEPARATOR)).otherwise(
            F.concat(F.when(i > 0, F.lit(END)).otherwise(F.lit("")), F.lit(START), b["role"], F.lit("\n"))).alias("before"),
        t.alias("text"), b["trained"].alias("trained")))))
    sized = merged.select("conv_id", pieces.alias("_pieces")).select(
        "conv_id", "_pieces", running_totals(F.transform("_pieces", lambda p: (
            F.char_length(p["before"]) + F.char_length(p["text"])).cast("long"))).alias("_at"))
    spans = F.transform(F.filter(F.arrays_zip("_pieces", "_at"), lambda x: x["_pieces"]["trained"]), lambda x: F.struct(
        (x["_at"] + F.char_length(x["_pieces"]["before"])).alias("begin"),
        (x["_at"] + F.char_length(x["_pieces"]["before"]) + F.char_length(x["_pieces"]["text"])).alias("end")))
    text = F.concat(F.array_join(F.transform("_pieces", lambda p: F.concat(p["before"], p["text"])), ""), F.lit(END))
    return sized.select("conv_id", text.alias("formatted"), spans.alias("loss_spans"))


def parsed_conversations(formatted: DataFrame) -> DataFrame:
    """``conv_id, formatted, turns`` (array of ``role, text``), ``loss_texts``, read back from formatted text and mask alone."""
    cut = F.split("formatted", r"<\|im_start\|>")
    blocks = F.transform(F.slice(cut, F.lit(2), F.size(cut)), lambda b: F.struct(
        F.substring_index(b, "\n", 1).alias("role"),
        F.split(F.substring(b, F.instr(b, F.lit("\n")) + 1, F.char_length(b) - F.instr(b, F.lit("\n")) - len(END)),
                r"<\|im_sep\|>").alias("texts")))
    turns = F.flatten(F.transform(blocks, lambda b: F.transform(b["texts"], lambda t: F.struct(
        unescaped_role(b["role"]).alias("role"), unescaped(t).alias("text")))))
    trained = F.transform("loss_spans", lambda s: unescaped(
        F.substring(F.col("formatted"), (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int"))))
    return formatted.select("conv_id", "formatted", turns.alias("turns"), trained.alias("loss_texts"))
