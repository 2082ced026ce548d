"""Chat formatting with DataFrame expressions only.

Turn structs of a conversation are collected and sorted by (turn, role, text); adjacent turns of
one role are merged into a block. A block is ``<|start|>role<|text|>a<|turn|>b<|end|>``; the marks
between merged turns keep them apart, so the table can be read back. Control strings inside roles
and texts are escaped with ``ESC`` and one character, which :func:`unescape` undoes exactly.

Null or empty text gives an empty text, null role an empty role; a null turn sorts first. Repeated
rows stay repeated turns. Rows with a null conv_id form one conversation with a null id. An empty
table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from methylspark.llm.tables import let

START, TEXT, TURN, END = "<|start|>", "<|text|>", "<|turn|>", "<|end|>"
#: Escape character, and the control strings it stands before as a digit. Fixed values.
ESC = "␛"
CONTROL = [START, TEXT, TURN, END, "<s>", "</s>", "[INST]", "[/INST]"]


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit(ESC), F.lit(ESC + "0"))
    for k, mark in enumerate(CONTROL, 1):
        out = F.replace(out, F.lit(mark), F.lit(f"{ESC}{k}"))
    return out


def unescape(text: Column) -> Column:
    out = text
    for k, mark in enumerate(CONTROL, 1):
        out = F.replace(out, F.lit(f"{ESC}{k}"), F.lit(mark))
    return F.replace(out, F.lit(ESC + "0"), F.lit(ESC))


def format_chats(conversations: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """``(conv_id, formatted, loss_spans)``: one row per conversation.

    ``loss_spans`` are [start, end) in code points of ``formatted``: one per turn of ``learn_role``.
    """
    turns = conversations.select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"),
                            F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    blocks = sorted_turns.select("conv_id", let(F.col("t"), _blocks).alias("blocks"))
    pieces = blocks.select("conv_id", F.flatten(F.transform(
        "blocks", lambda b: _pieces(b, learn_role))).alias("pieces"))
    spans = F.aggregate(
        "pieces", F.struct(F.lit(0).alias("at"),
                           F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.char_length(p["s"])).alias("at"),
            F.when(p["loss"], F.array_append(acc["spans"], F.struct(
                acc["at"].alias("start"), (acc["at"] + F.char_length(p["s"])).alias("end"))))
            .otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"])
    return pieces.select(
        "conv_id", F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"),
        spans.alias("loss_spans"))


def _blocks(t: Column) -> Column:
    """Maximal runs of turns of one role, as arrays of turns."""
    first = F.filter(F.sequence(F.lit(0), F.size(t) - 1),
                     lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, i - 1)["role"]))
    return let(first, lambda f: F.transform(f, lambda at, k: F.slice(
        t, at + 1, F.coalesce(F.get(f, k + 1), F.size(t)) - at)))


def _pieces(block: Column, learn_role: str) -> Column:
    """The strings of one block, each with whether it is learnt."""
    role = F.element_at(block, 1)["role"]

    def piece(s: Column, loss: Column) -> Column:
        return F.struct(s.alias("s"), loss.alias("loss"))

    no = F.lit(False)
    body = F.flatten(F.transform(block, lambda t, i: F.array(
        piece(F.when(i == 0, F.lit("")).otherwise(F.lit(TURN)), no),
        piece(escape(t["text"]), t["role"] == learn_role))))
    return F.concat(F.array(piece(F.concat(F.lit(START), escape(role), F.lit(TEXT)), no)), body,
                    F.array(piece(F.lit(END), no)))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text)."""
    def turns(block: Column) -> Column:
        # role, then texts; the block's end mark is cut off first
        inner = F.substring(block, F.lit(1), F.char_length(block) - len(END))
        role = F.substring_index(inner, TEXT, 1)
        rest = F.substring(inner, F.char_length(role) + len(TEXT) + 1, F.char_length(inner))
        return F.transform(F.split(rest, r"<\|turn\|>"), lambda x: F.struct(
            unescape(role).alias("role"), unescape(x).alias("text")))

    blocks = F.split(formatted, r"<\|start\|>")
    return F.flatten(F.transform(F.filter(blocks, lambda _, i: i > 0), turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
