"""Chat formatting with collapse of cumulative snapshots.

A chat logged after every turn leaves conversations that are prefixes of longer
ones. Every prefix of every conversation gets a rolling hash over its turns; a
conversation whose whole hash is a proper prefix of another, or the whole of one
with a lower id, is dropped by anti-join. What stays is rendered.

Defined results: turns are ordered by (turn, role, text), nulls first; null role
and text render as empty, yet differ from empty when conversations are compared;
rows of a null conversation id form one conversation; an empty table gives an
empty result; exact copies keep the lowest id (null lowest). Texts of any length are
hashed and rendered whole; a chat is one value, so a conversation must fit in a task.
Only the four named columns are read, so further ones have no part in the result,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LANES = ("_p0", "_p1", "_p2", "_p3")


def prefix_hashes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each turn: its place from 1, and four 32-bit lanes that hash all turns up to it.

    A lane is the running sum of the hashes of (place, role, text), so it rolls
    forward turn by turn in the window and never holds the turns themselves.
    """
    order = W.partitionBy(conv).orderBy(*[F.col(c).asc_nulls_first() for c in (turn, role, text)])
    rolling = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    place = F.row_number().over(order)
    half = lambda h, high: F.shiftrightunsigned(h, 32) if high else h.bitwiseAND(F.lit(0xFFFFFFFF))
    said = [F.col("_place"), F.col(role).isNull(), F.col(role), F.col(text).isNull(), F.col(text)]
    return (
        turns.select(conv, turn, role, text)
        .withColumn("_place", place)
        .withColumn("_h0", F.xxhash64(F.lit(1), *said))
        .withColumn("_h1", F.xxhash64(F.lit(2), *said))
        .withColumns({lane: F.sum(half(F.col(f"_h{i // 2}"), i % 2)).over(rolling) for i, lane in enumerate(LANES)})
        .drop("_h0", "_h1")
    )


def maximal_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Ids and turn counts of the conversations that no other one continues or repeats."""
    prefixes = prefix_hashes(turns, conv, turn, role, text)
    last = prefixes.groupBy(conv).agg(F.max(F.struct("_place", *LANES)).alias("_whole"))
    whole = last.select(conv, F.col("_whole._place").alias("_place"), *[F.col(f"_whole.{x}").alias(x) for x in LANES])
    # equal conversations become one row here, before the join, so that no hash is hot in it
    distinct = whole.groupBy("_place", *LANES).agg(F.min(F.struct(F.col(conv).isNotNull().alias("known"), F.col(conv).alias("id"))).alias("_first"), F.count("*").alias("n_copies"))
    # a proper prefix ends before its conversation does
    proper = (
        prefixes.withColumn("_n", F.count("*").over(W.partitionBy(conv)))
        .where(F.col("_place") < F.col("_n"))
        .groupBy("_place", *LANES)
        .agg(F.lit(1).alias("_some"))
    )
    return distinct.join(proper, ["_place", *LANES], "left_anti").select(
        F.col("_first.id").alias(conv), F.col("_place").cast("long").alias("n_turns"), F.col("n_copies").cast("long").alias("n_copies")
    )


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("<|im_end|>"))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One rendered text for each maximal conversation: conversation id, n_turns, n_copies, chat."""
    keep = maximal_conversations(turns, conv, turn, role, text).withColumnRenamed(conv, "_conv")
    rows = turns.select(conv, turn, role, text).join(keep, F.col(conv).eqNullSafe(F.col("_conv")), "inner")
    return (
        rows.groupBy(conv, "n_turns", "n_copies")
        .agg(F.sort_array(F.collect_list(F.struct(turn, role, text))).alias("_turns"))
        .select(conv, "n_turns", "n_copies", F.array_join(F.transform("_turns", lambda t: render_turn(t[role], t[text])), "\n").alias("chat"))
    )
