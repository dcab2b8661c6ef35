"""Rendering of turn tables as training texts (P7), for conversations of any
length.

Turns are parted by ranges of (conversation, turn), so a conversation with many turns
lies in several partitions, one after the other. Each partition joins its
own part of a conversation to one string; the parts of a conversation, one row for each
partition it lies in, are joined in order at the end. Only that last join
sees a whole conversation, as does the row that it makes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chat import message, render_chat


def _joined(parts: str) -> Column:
    """The texts of an array of (order, text), in order."""
    return F.array_join(F.transform(F.array_sort(parts), lambda p: p["text"]), "")


def render_turns(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 parts: int | None = None) -> DataFrame:
    """(conversation, n_turns, text): every conversation's turns in order as
    one chat text. Turns of equal number follow one another by role, then text; null
    roles and texts are empty. ``parts`` is the number of ranges, the session's
    shuffle partitions by default."""
    piece = render_chat(F.array(message(F.coalesce(role, F.lit("")), F.coalesce(text, F.lit("")))))
    # a narrow order: ties of (conversation, turn) may lie in two partitions, so the order is total
    order = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.xxhash64(text).alias("hash"))
    pieces = turns.select(F.col(conversation), order.alias("o"), piece.alias("text"))
    n = parts or int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = pieces.repartitionByRange(n, conversation, "o").withColumn("part", F.spark_partition_id())
    # rows of a part are in one task already: a group is one range's share of a conversation
    chunks = ranged.groupBy(conversation, "part").agg(
        F.count(F.lit(1)).alias("n"), _joined(F.collect_list(F.struct("o", "text"))).alias("text"))
    whole = chunks.groupBy(conversation).agg(
        F.sum("n").alias("n_turns"), F.collect_list(F.struct("part", "text")).alias("chunks"))
    return whole.select(conversation, "n_turns", _joined("chunks").alias("text"))
