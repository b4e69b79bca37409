"""Preference formatting with DataFrame functions alone.

The turns that a chosen and a rejected conversation have in common at their start are rendered once,
as prompt.  What follows becomes a pair of completions with masks: an assistant's words count for
the loss, headers and other roles' words do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, written

#: Turns of a side that stand in one row; a longer pair goes on in further rows (block 1, 2, ...).
BLOCK = 4096
HEAD, TAIL = "<|{role}|>\n", "<|end|>\n"


def _head(turn: Column) -> Column:
    before, after = HEAD.split("{role}")
    return F.concat(F.lit(before), F.coalesce(turn["role"], F.lit("")), F.lit(after))


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(TAIL))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def _mask(turns: Column) -> Column:
    """Runs of characters of the rendered turns, with whether they count for the loss."""
    run = lambda text, train: F.struct(F.length(text).alias("length"), train.alias("train"))
    return F.flatten(F.transform(turns, lambda t: F.array(run(_head(t), F.lit(False)), run(_body(t), F.coalesce(t["role"] == "assistant", F.lit(False))))))


def _pieces(rows: DataFrame, block: int) -> tuple[DataFrame, bool]:
    """rows (pair_id, side, turn, role, text) with the piece that a turn stands in: its place on its side, divided by block;
    and whether there is any piece but the first.

    Places are asked for only where a side has more turns than block.  Those rows are dealt by range and
    sorted; with the row count of each partition and side, no task holds a side.
    """
    by, order = ["pair_id", "side"], ["turn", "role", "text"]
    large = written(rows.groupBy(*by).count().where(F.col("count") > block).select(*by), "chat-large")
    if large.isEmpty():
        return rows.withColumn("block", F.lit(0).cast("long")), False
    large = small(large)
    dealt = rows.join(large, by, "left_semi").repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    table = written(dealt.withColumn("mark", F.monotonically_increasing_id()), "chat-sorted")
    part = F.shiftright("mark", 33).alias("part")
    runs = table.groupBy(*by, part).agg(F.count("*").alias("rows"), F.min("mark").alias("first"))
    before = F.sum("rows").over(Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = written(runs.select(*by, "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift")), "chat-runs")
    placed = table.withColumn("part", part).join(small(runs), [*by, "part"])
    cut = placed.withColumn("block", F.floor((F.col("mark") + F.col("shift")) / F.lit(block))).select(*rows.columns, "block")
    return rows.join(large, by, "left_anti").withColumn("block", F.lit(0).cast("long")).unionByName(cut), True


def preference_pairs(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """turns (pair_id, side: 'chosen' or 'rejected', turn, role, text) to a row for each pair.

    pair_id, block, prompt, chosen, rejected, the number of turns of each, and chosen_mask and
    rejected_mask: arrays of (length, train) whose lengths sum to the completion's.  A turn
    is common if turn number, role and text are equal on both sides; repeated rows of a turn
    are turns of their own, in the order of role and text.  Null role and text render as nothing, a null turn
    number comes first; rows with a null pair_id or another side belong to no pair.  A pair of which
    one side is missing has an empty prompt.  A side's first block turns stand in the row with block 0, the next ones in
    that with block 1, and so on, whatever their numbers; a row's texts follow on those of the row before.
    """
    number = F.coalesce(F.col("turn").cast("long"), F.lit(-1))
    rows = turns.where("pair_id is not null and side in ('chosen', 'rejected')").select("pair_id", "side", number.alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    one = F.struct("turn", "role", "text")
    pieces, several = _pieces(rows, block)
    sides = pieces.groupBy("pair_id", "block").agg(*[F.sort_array(F.collect_list(F.when(F.col("side") == s, one))).alias(s) for s in ("chosen", "rejected")])
    same = F.zip_with("chosen", "rejected", lambda a, b: a.eqNullSafe(b))
    differs = F.array_position(same, F.lit(False)).cast("int")
    out = sides.withColumn("n", F.when(differs == 0, F.size(same)).otherwise(differs - 1))
    # the first row of a pair that holds a difference; in later ones nothing is common
    if several:
        whole = (F.col("n") == F.size("chosen")) & (F.col("n") == F.size("rejected"))
        more = written(out.groupBy("pair_id").agg(F.max("block").alias("last"), F.min(F.when(~whole, F.col("block"))).alias("differs_in")).where("last > 0").select(F.col("pair_id").alias("long_pair"), "differs_in"), "chat-long")
        out = out.join(small(more), F.col("pair_id") == F.col("long_pair"), "left").withColumn("n", F.when(F.col("block") > F.col("differs_in"), 0).otherwise(F.col("n")))
    rest = lambda s: F.slice(s, F.col("n") + 1, F.greatest(F.size(s) - F.col("n"), F.lit(0)))
    parts = out.select("pair_id", "block", F.slice("chosen", 1, F.col("n")).alias("p"), rest("chosen").alias("c"), rest("rejected").alias("r"))
    return parts.select(
        "pair_id", "block", _render(F.col("p")).alias("prompt"), _render(F.col("c")).alias("chosen"), _render(F.col("r")).alias("rejected"),
        F.size("p").alias("prompt_turns"), F.size("c").alias("chosen_turns"), F.size("r").alias("rejected_turns"),
        _mask(F.col("c")).alias("chosen_mask"), _mask(F.col("r")).alias("rejected_mask"),
    )


def mask_text(mask: str) -> Column:
    """A mask as text: length:0 or length:1, separated by commas."""
    return F.array_join(F.transform(mask, lambda m: F.concat(m["length"].cast("string"), F.lit(":"), m["train"].cast("int").cast("string"))), ",")


def swapped_endings(conversations: DataFrame) -> DataFrame:
    """Preference turns from plain conversations (conv_id, turn, role, text).

    Each conversation is the chosen side of a pair.  On the rejected side the turns of its last number are those of its
    neighbour, the conversation whose id differs in the lowest bit (nothing, if there is none).  Rows that repeat a turn
    number stay side by side; a null turn number comes first, and is the last one of a conversation without others.  Rows with
    a null conv_id are left out; null roles and texts stay null; an empty table gives no rows; other columns are ignored.
    """
    c = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("pair_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    ends = c.groupBy("pair_id").agg(F.max("turn").alias("end"))
    placed = c.join(ends, "pair_id")
    sides = F.when(F.col("turn") < F.col("end"), F.array(F.lit("chosen"), F.lit("rejected"))).otherwise(F.array(F.lit("chosen")))
    own = placed.select("pair_id", F.explode(sides).alias("side"), "turn", "role", "text")
    theirs = placed.where("turn = end").select(F.col("pair_id").bitwiseXOR(F.lit(1).cast("long")).alias("pair_id"), "role", "text").join(ends, "pair_id")
    return own.unionByName(theirs.select("pair_id", F.lit("rejected").alias("side"), F.col("end").alias("turn"), "role", "text"))
