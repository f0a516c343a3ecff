"""Chat formatting of logged conversations, after collapsing cumulative snapshots.

A log that saves a conversation after every turn holds it many times, each save a prefix of the next.
Every turn gets the rolling hash of the turns up to it: the exclusive-or, over a running window, of two
64-bit hashes of (place, role, text).  A conversation whose full hash equals a proper prefix hash of another
one goes, by an anti-join on distinct hashes; of equal conversations that with the smallest conv_id stays.
Only then are turns put together and rendered.

Defined results: turns are ordered by (turn, role, text); exactly repeated rows count once; rows with a null
conv_id belong to no conversation and are left out; a null role or text renders as empty (but hashes apart
from an empty one); a null turn sorts first; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, place, n_turns, h1, h2): rolling hashes of the turns so far."""
    turns = turns.select("conv_id", "turn", "role", "text").filter(F.col("conv_id").isNotNull()).distinct()
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = turns.withColumn("place", F.row_number().over(order))
    said = [F.col("place"), F.col("role").isNull(), F.col("text").isNull(), F.col("role"), F.col("text")]
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("conv_id")
    return turns.select(
        "conv_id", "turn", "role", "text", "place",
        F.count("*").over(whole).alias("n_turns"),
        F.bit_xor(F.xxhash64(F.lit(1), *said)).over(upto).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit(2), *said)).over(upto).alias("h2"),
    )


def maximal(hashes: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_copies of the conversations that no other one extends."""
    full = hashes.filter(F.col("place") == F.col("n_turns"))
    # partial aggregation first: a conversation logged many times, or a very common opening, is one row a task
    full = full.groupBy("h1", "h2", "n_turns").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    prefixes = hashes.filter(F.col("place") < F.col("n_turns")).select("h1", "h2", F.col("place").alias("n_turns")).distinct()
    return full.join(prefixes.hint("merge"), ["h1", "h2", "n_turns"], "left_anti").select("conv_id", "n_turns", "n_copies")


def rendered(turns: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, n_copies, chat."""
    from tempestry.llm.common import cut

    hashes = cut(prefix_hashes(turns))
    kept = maximal(hashes)
    said = F.struct("place", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    lines = F.transform(F.array_sort(F.collect_list(said)), lambda s: F.concat(F.lit("<|"), s.role, F.lit("|>\n"), s.text, F.lit("\n")))
    chats = hashes.join(kept.select("conv_id").hint("merge"), "conv_id", "left_semi").groupBy("conv_id").agg(F.array_join(lines, "").alias("chat"))
    return kept.join(chats.hint("merge"), "conv_id").select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.col("n_copies").cast("long").alias("n_copies"), "chat")
