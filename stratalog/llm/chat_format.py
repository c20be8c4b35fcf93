"""Chat formatting with Spark expressions only.

Template: each run of turns with one role is a block ``[role]text<sep>text</s>``; blocks stand one
after another. Inside roles and texts the characters of control strings are escaped, so that none
can appear there: ``\\`` as ``\\\\``, ``<`` as ``\\l``, ``[`` as ``\\b``, ``]`` as ``\\d``.
The loss mask is a list of [start, end) code points of the formatted string: the texts of the
roles trained on, without the marks.

Defined cases: null texts and roles count as empty; turns are ordered by turn (nulls first), then
role, then text; repeated rows are turns of their own; rows with null conv_id form a conversation
of their own; an empty table gives an empty table; further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEP, END = "<sep>", "</s>"


def escape(text: Column) -> Column:
    for plain, code in (("\\", "\\\\"), ("<", "\\l"), ("[", "\\b"), ("]", "\\d")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    """Escaped backslashes come first from the left, so splitting at them keeps codes whole."""

    def rest(part: Column) -> Column:
        for plain, code in (("<", "\\l"), ("[", "\\b"), ("]", "\\d")):
            part = F.replace(part, F.lit(code), F.lit(plain))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\"), rest), "\\")


def format_chat(turns: DataFrame, *, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, loss_mask array<struct<start, end>> for each conversation."""
    empty = F.lit("")
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")).alias("t"))
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    def piece(t: Column, i: Column) -> Column:
        before = F.get("ts", i - 1)["role"]
        mark = F.concat(F.lit("["), escape(t["role"]), F.lit("]"))
        head = F.when(i == 0, mark).when(before == t["role"], F.lit(SEP)).otherwise(F.concat(F.lit(END), mark))
        return F.struct(head.alias("head"), escape(t["text"]).alias("body"), t["role"].isin(*trained_roles).alias("trained"))

    pieces = sorted_turns.select("conv_id", F.transform("ts", piece).alias("ps"))
    spans = F.aggregate(
        "ps",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("mask")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["head"]) + F.length(p["body"])).cast("long").alias("at"),
            F.when(
                p["trained"],
                F.concat(a["mask"], F.array(F.struct((a["at"] + F.length(p["head"])).cast("long").alias("start"), (a["at"] + F.length(p["head"]) + F.length(p["body"])).cast("long").alias("end")))),
            )
            .otherwise(a["mask"])
            .alias("mask"),
        ),
        lambda a: a["mask"],
    )
    text = F.concat(F.array_join(F.transform("ps", lambda p: F.concat(p["head"], p["body"])), ""), F.lit(END))
    return pieces.select("conv_id", text.alias("formatted"), spans.alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role, text>>, loss_text, from conv_id, formatted, loss_mask."""

    def block(b: Column) -> Column:
        mark = F.substring_index(b, "]", 1)
        role = unescape(F.substr(mark, F.lit(2)))
        return F.transform(F.split(F.substr(b, F.length(mark) + 2), SEP), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    blocks = F.split("formatted", END)
    turns = F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), block))
    loss = F.array_join(F.transform("loss_mask", lambda m: unescape(F.substr("formatted", (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")))), "")
    return formatted.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), F.length("formatted").alias("formatted_chars"))
