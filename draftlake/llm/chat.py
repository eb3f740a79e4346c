"""Chat formatting after collapsing cumulative snapshots.

A logged conversation is often followed by longer ones that start with the same turns.
A rolling hash over the turns gives every prefix a key; an anti-join drops each
conversation whose whole key is a proper prefix of another one, of equal conversations the
smallest id stays, and what stays is rendered turn by turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.llm.common import Scratch
from draftlake.operators.ordered import running

# ---------------------------------------------------------------- fixed values
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
PARTS = 4  # 31-bit sums that make up a prefix key
# ---------------------------------------------------------- end of fixed values


def _terms() -> dict[str, Column]:
    """Hashes of (place, role, text) cut to 31 bits, so that sums of any length stay exact."""
    said = ["place", F.col("role").isNull(), "role", F.col("said").isNull(), "said"]
    halves = [F.xxhash64(F.lit(seed), *said) for seed in range(PARTS)]
    return {f"h{k}": F.shiftrightunsigned(h, 33) for k, h in enumerate(halves)}


def prefixes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every turn with its place in its conversation and the rolling hash up to it.

    Both are running sums over range slices, so one conversation may hold any share of the
    rows.  Turns are ordered by number, then role and text.
    """
    rows = turns.select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("said")
    ).where(F.col("conv_id").isNotNull())
    # Repeated rows are the same turn logged twice; nulls come first in the order.
    rows = rows.distinct().withColumns({"_turn": F.coalesce("turn", F.lit(-(1 << 62))), "_role": F.coalesce("role", F.lit("")), "_said": F.coalesce("said", F.lit("")), "_null": F.col("role").isNotNull().cast("int") * 2 + F.col("said").isNotNull().cast("int")})
    order = ["_turn", "_role", "_said", "_null"]
    placed = running(rows, ["conv_id"], order, {"place": F.lit(1).cast("long")})
    rolled = running(placed, ["conv_id"], ["place"], _terms())
    return rolled.select("conv_id", "turn", "place", "role", "said", *[f"h{k}" for k in range(PARTS)])


def maximal(scratch: Scratch, rolled: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that are no proper prefix of another."""
    key = ["place", *[f"h{k}" for k in range(PARTS)]]
    ends = rolled.groupBy("conv_id").agg(F.max(F.struct(*key)).alias("end")).select("conv_id", "end.*")
    ends = scratch.keep("ends", ends)
    whole = ends.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    # One row per distinct prefix, combined ahead of the exchange: a first turn that all share is one key.
    last = ends.select("conv_id", F.col("place").alias("n_turns"))
    inner = rolled.join(last, "conv_id").where(F.col("place") < F.col("n_turns")).select(*key).distinct()
    kept = whole.join(inner, key, "left_anti")
    return kept.select("conv_id", F.col("place").alias("n_turns"), "n_copies")


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rendered turns of the maximal conversations: conv_id, n_turns, n_copies, place, rendered.

    The texts of a conversation one after the other, in the order of ``place``, are its chat
    format; a conversation is never gathered into one row, as it may be of any length.
    ``n_copies`` counts the equal conversations that the smallest id stands for.  Null roles
    and texts differ from empty ones when compared and are rendered as empty; repeated rows
    are one turn; turns without number come first; rows without conversation id belong to no
    conversation and are left out; extra columns are ignored.
    """
    scratch = Scratch(turns.sparkSession)
    rolled = scratch.keep("rolled", prefixes(turns, conv, turn, role, text))
    kept = scratch.keep("kept", maximal(scratch, rolled))
    said = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("said", F.lit("")), F.lit(CLOSE + "\n"))
    return rolled.join(kept, "conv_id").select("conv_id", "n_turns", "n_copies", "place", said.alias("rendered"))
