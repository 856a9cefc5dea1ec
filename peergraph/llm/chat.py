"""Chat formatting as relational expressions.

The turns of a conversation are collected as structs and sorted; adjacent turns of the same role share one header;
segments are concatenated. A block is ``<|im_start|>role``, a line end, the texts with ``<|im_sep|>`` between merged
ones, ``<|im_end|>`` and a line end. In roles and texts, one backslash is put between ``<`` (with any backslashes
after it) and ``|``, so no control string can come from a text, and taking it out again gives the text back. A line
end in a role is written ``<|nl|>``.

A conversation is one output row, so one task holds one conversation's turns, as the result itself requires.

Defined cases: null roles and texts are empty; turns are ordered by turn (null first), then role, then text, so
ties and repeated rows have one result; a null conversation id is a conversation; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

START, SEP, END, LINE = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n", "<|nl|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def format_conversations(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans): loss_spans are the [start, end) code points of each trained role's text in formatted."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_turns = F.transform(F.array_sort(F.collect_list(row)), lambda t: F.struct(F.replace(escape(t.role), F.lit("\n"), F.lit(LINE)).alias("role"), escape(t.text).alias("text")))
    grouped = turns.groupBy("conv_id").agg(sorted_turns.alias("turns"))

    def segment(t: Column, i: Column) -> Column:
        before, after = F.get("turns", i - 1).role, F.get("turns", i + 1).role
        head = F.when(before.eqNullSafe(t.role), F.lit(SEP)).otherwise(F.concat(F.lit(START), t.role, F.lit("\n")))
        return F.struct(head.alias("head"), t.text.alias("text"), F.when(after.eqNullSafe(t.role), F.lit("")).otherwise(F.lit(END)).alias("tail"), (t.role == trained).alias("trained"))

    cut = grouped.select("conv_id", F.transform("turns", segment).alias("segments"))

    def add(acc: Column, s: Column) -> Column:
        start = acc.at + F.length(s["head"])
        end = start + F.length(s["text"])
        spans = F.when(s["trained"], F.concat(acc.spans, F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"))))).otherwise(acc.spans)
        return F.struct((end + F.length(s["tail"])).cast("long").alias("at"), spans.alias("spans"))

    def moved(s: Column, at: Column) -> Column:
        return F.struct((s.start + at).alias("start"), (s.end + at).alias("end"))

    spans = common.running(F.col("segments"), "cast(array() as array<struct<start:bigint,end:bigint>>)", add, moved)
    formatted = F.array_join(F.transform("segments", lambda s: F.concat(s["head"], s["text"], s["tail"])), "")
    return cut.select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"))


def blocks(formatted: Column) -> Column:
    """The formatted string's blocks, without their ends."""
    return F.filter(F.split(formatted, r"\Q" + END.replace("\n", r"\E\n")), lambda b: b != "")


def parse(formatted: Column) -> Column:
    """The turns read back: array of (role, text), merged turns apart again."""

    def of_block(block: Column) -> Column:
        role = unescape(F.replace(F.substring_index(F.substring(block, F.lit(len(START) + 1), F.length(block)), "\n", 1), F.lit(LINE), F.lit("\n")))
        rest = F.regexp_replace(block, r"^[^\n]*\n", "")
        return F.transform(F.split(rest, r"\Q" + SEP + r"\E"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks(formatted), of_block))


def under_mask(formatted: Column, loss_spans: Column) -> Column:
    """The unescaped text under the mask: each masked stretch, concatenated."""
    return F.array_join(F.transform(loss_spans, lambda s: unescape(F.substring(formatted, (s.start + 1).cast("int"), (s.end - s.start).cast("int")))), "")
