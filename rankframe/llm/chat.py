"""Chat formatting: an event log of streamed deltas, edits and regenerations folded into messages, then rendered.

A turn is rendered as ``<s>[INST] role [/INST]text</s>``. A backslash inside a role or text is doubled, and every
control string gets one after its first character, so no text can end a turn or begin one, and dropping one level of
backslashes gives the text back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST]", "</s>"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
LEARNED_ROLE = "assistant"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda c, word: F.replace(c, F.lit(word), F.lit(word[0] + "\\" + word[1:])), CONTROL, doubled)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of a log (conv_id, seq, kind, turn, role, text).

    ``delta`` (also a null kind) appends to its turn's text, ``edit`` replaces all of it, ``regenerate`` discards its
    turn and all later turns as they stood; what comes after it in ``seq`` builds them anew. Events of equal ``seq``
    apply in the order of kind, then text. A turn without a remaining event is gone. A turn's role is the last one
    given for it; a null text or role is empty. Null conversations and turns are values of their own.

    Only narrow marks meet by conversation; texts meet by (conversation, turn).
    """
    log = events.select("conv_id", "turn", "seq", F.coalesce("kind", F.lit("delta")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    marks = log.groupBy("conv_id", "turn").agg(
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("regenerated"),
        F.max(F.when(F.col("kind") == "edit", F.col("seq"))).alias("edited"),
        F.max(F.when(F.col("role").isNotNull(), F.struct("seq", "role")))["role"].alias("last_role"),
    )
    so_far = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marks = marks.select(
        F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), F.max("regenerated").over(so_far).alias("regenerated"), "edited", "last_role"
    )
    both = log.join(marks, log.conv_id.eqNullSafe(marks._conv) & log.turn.eqNullSafe(marks._turn))
    seq, edit = F.col("seq"), F.col("kind") == "edit"
    alive = (F.col("regenerated").isNull() | (seq > F.col("regenerated"))) & (
        F.col("edited").isNull() | (seq > F.col("edited")) | (edit & (seq == F.col("edited")))
    )
    said = both.filter(F.col("kind").isin("delta", "edit") & alive)
    parts = F.array_sort(F.collect_list(F.struct("seq", "kind", "text")))
    return (
        said.groupBy("conv_id", "turn")
        .agg(parts.alias("parts"), F.coalesce(F.max("last_role"), F.lit("")).alias("role"))
        .select("conv_id", "turn", "role", F.array_join("parts.text", "").alias("text"))
    )


def render(messages: DataFrame) -> DataFrame:
    """One row for each conversation: ``formatted``, and ``loss``, the spans [start, end) in code points that hold the
    assistant's texts, without the markers around them."""
    turns = messages.select(
        "conv_id",
        "turn",
        F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE)).alias("head"),
        escape(F.col("text")).alias("body"),
        (F.col("role") == LEARNED_ROLE).alias("learned"),
    ).withColumns({"n_head": F.char_length("head").cast("long"), "n_body": F.char_length("body").cast("long")})
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = F.sum(F.col("n_head") + F.col("n_body") + F.lit(len(CLOSE))).over(order)
    placed = turns.withColumn("end", ends - F.lit(len(CLOSE))).select(
        "conv_id",
        F.struct("turn", F.concat("head", "body", F.lit(CLOSE)).alias("text")).alias("piece"),
        F.when(F.col("learned"), F.struct((F.col("end") - F.col("n_body")).alias("start"), "end")).alias("span"),
    )
    gathered = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list("piece")).alias("pieces"), F.array_sort(F.collect_list("span")).alias("loss"))
    return gathered.select("conv_id", F.array_join("pieces.text", "").alias("formatted"), "loss")


def read_back(formatted: Column) -> Column:
    """The turns of a rendered conversation as an array of (role, text)."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda piece: piece != "")

    def turn(piece: Column) -> Column:
        at = F.instr(piece, MIDDLE)
        role = F.substring(piece, F.lit(len(OPEN) + 1), at - F.lit(len(OPEN) + 1))
        text = F.substring(piece, at + F.lit(len(MIDDLE)), F.char_length(piece))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def learned_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(
        F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), ""
    )
