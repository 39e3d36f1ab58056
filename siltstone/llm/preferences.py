"""Preference formatting of a chosen and a rejected conversation.

The turns of both are compared place by place in a join on (pair, place); the longest common prefix ends before the
first place where role or text differ or one of them has no turn. The prefix is rendered once, as the prompt; what
follows it is rendered for each side, with a mask that lets training see only the assistant's text. Masks are runs:
[start, end) in characters of the completion, with end marks included.

Turns are ordered by turn, role and text (nulls first); repeated rows are turns of their own; a null text is an empty
turn and a null role is "unknown". Rows without a conversation id belong to none. Other columns are ignored. A pair
needs both sides; if they are equal throughout, both completions are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm import common

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
LEARNED_ROLE = "assistant"


def adjacent_pairs(turns: DataFrame) -> DataFrame:
    """Conversation 2k is chosen over 2k + 1, where both exist."""
    sides = turns.filter("conv_id is not null").groupBy((F.floor(F.col("conv_id") / 2)).cast("long").alias("pair_id")).agg(F.min("conv_id").alias("chosen_id"), F.max("conv_id").alias("rejected_id"))
    return sides.filter("chosen_id < rejected_id")


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, place from 0, role, text."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    own = turns.filter("conv_id is not null").withColumn("place", F.row_number().over(order) - 1)
    return own.select("conv_id", "place", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE))


def formatted(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id, chosen_id, rejected_id, prefix_turns, prompt, and each side's completion and mask.

    pairs: pair_id, chosen_id, rejected_id.
    """
    own = numbered(turns)
    sides = pairs.select("pair_id", "chosen_id", "rejected_id", F.explode(F.array(F.struct(F.lit("chosen").alias("side"), F.col("chosen_id").alias("conv_id")), F.struct(F.lit("rejected").alias("side"), F.col("rejected_id").alias("conv_id")))).alias("s"))
    rows = sides.select("pair_id", "chosen_id", "rejected_id", "s.side", "s.conv_id").join(own, "conv_id")
    # one row for each place: both sides' turns, where they have one
    side = lambda name: F.min(F.when(F.col("side") == name, F.struct("role", "text")))
    places = rows.groupBy("pair_id", "chosen_id", "rejected_id", "place").agg(side("chosen").alias("c"), side("rejected").alias("r"))
    lists = places.groupBy("pair_id", "chosen_id", "rejected_id").agg(F.array_sort(F.collect_list(F.struct("place", "c", "r"))).alias("turns"))
    differ = F.filter("turns", lambda t: t["c"].isNull() | t["r"].isNull() | (t["c"] != t["r"]))
    lists = lists.withColumn("prefix_turns", F.coalesce(F.try_element_at(F.transform(differ, lambda t: t["place"]), F.lit(1)), F.size("turns")))
    lists = lists.withColumn("head", F.slice("turns", 1, F.col("prefix_turns"))).withColumn("tail", F.slice("turns", F.col("prefix_turns") + 1, F.greatest(F.size("turns"), F.lit(1))))

    def pieces(name: str) -> Column:
        return F.transform(F.filter("tail", lambda t: t[name].isNotNull()), lambda t: t[name])

    lists = lists.withColumn("chosen_turns", pieces("c")).withColumn("rejected_turns", pieces("r"))

    def text_of(c: str) -> Column:
        return F.array_join(F.transform(c, lambda t: rendered(t["role"], t["text"])), "")

    def mask_of(c: str) -> Column:
        """Runs of the learned role's text and end mark, in characters of the completion."""
        empty = F.array().cast("array<struct<start:int,end:int>>")
        zero = F.struct(F.lit(0).alias("at"), empty.alias("runs"))

        def step(acc: Column, t: Column) -> Column:
            start = acc["at"] + F.length(t["role"]) + len(OPEN + MIDDLE)
            end = start + F.length(t["text"]) + len(CLOSE)
            run = F.when(t["role"] == LEARNED_ROLE, F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(empty)
            return F.struct(end.alias("at"), F.concat(acc["runs"], run).alias("runs"))

        return F.to_json(F.aggregate(c, zero, step, lambda acc: acc["runs"]))

    return lists.select(
        "pair_id", "chosen_id", "rejected_id", F.col("prefix_turns").cast("long").alias("prefix_turns"),
        F.array_join(F.transform("head", lambda t: rendered(t["c"]["role"], t["c"]["text"])), "").alias("prompt"),
        text_of("chosen_turns").alias("chosen"), text_of("rejected_turns").alias("rejected"),
        mask_of("chosen_turns").alias("chosen_mask"), mask_of("rejected_turns").alias("rejected_mask"),
    )


def op7_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = common.table(spark, sf_dir, "conversations")
    return formatted(turns, adjacent_pairs(turns))
