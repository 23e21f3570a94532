"""Preference formatting: a pair of conversations as one prompt and two masked completions.

The prompt is the longest common prefix of turns, rendered once. Each completion is what follows, with the spans in which a model is
to be trained: the replies of the trained role with their end marks. Everything is a column expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks around a turn.
OPEN, CLOSE, TRAINED = "<|im_start|>", "<|im_end|>\n", "assistant"


def conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, turns)``: each conversation as an array of ``(turn, role, text)`` in order, ties by role and text.

    A null role or text is empty; a null turn comes first; repeated rows stay. Rows without a conversation's id belong to none and
    are left out. Other columns are not read. A conversation is a row of the result, so it must fit into one.
    """
    one = F.struct(F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return turns.where(F.col(conv_id).isNotNull()).groupBy(F.col(conv_id).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """Number of turns at the front that have the same role and text in both arrays."""
    n = F.least(F.size(a), F.size(b))
    same = F.transform(F.sequence(F.lit(1), n), lambda i: (F.element_at(a, i)["role"] == F.element_at(b, i)["role"]) & (F.element_at(a, i)["text"] == F.element_at(b, i)["text"]))
    at = F.array_position(same, F.lit(False))
    return F.when(n == 0, F.lit(0)).when(at == 0, n).otherwise((at - 1).cast("int"))


def head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit("\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t), t["text"], F.lit(CLOSE))), "")


def mask(turns: Column, trained: str = TRAINED) -> Column:
    """Spans ``start:end`` (code points of the rendered turns, end exclusive) of the trained role's texts and end marks, joined by commas."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(head(t))
        end = start + F.length(t["text"]) + F.lit(len(CLOSE))
        span = F.array(F.concat(start.cast("string"), F.lit(":"), end.cast("string")))
        return F.struct(end.alias("at"), F.when(t["role"] == trained, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step, lambda state: F.array_join(state["spans"], ","))


def format_pairs(pairs: DataFrame, chosen: str = "chosen_turns", rejected: str = "rejected_turns", trained: str = TRAINED) -> DataFrame:
    """The other columns of ``pairs`` with ``prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask, differs``.

    Both columns are arrays as ``conversations`` makes them; null is an empty one. Equal conversations have empty completions and
    ``differs`` false; without a common first turn the prompt is empty.
    """
    none = F.array().cast(pairs.schema[chosen].dataType)
    keep = [c for c in pairs.columns if c not in (chosen, rejected)]
    rows = pairs.select(*keep, F.coalesce(chosen, none).alias("_a"), F.coalesce(rejected, none.cast(pairs.schema[rejected].dataType)).alias("_b"))
    rows = rows.withColumn("prompt_turns", common_turns(F.col("_a"), F.col("_b")))

    def rest(c: str) -> Column:
        return F.slice(F.col(c), F.col("prompt_turns") + 1, F.size(c))

    rows = rows.withColumn("_c", rest("_a")).withColumn("_r", rest("_b"))
    return rows.select(
        *keep, "prompt_turns", rendered(F.slice(F.col("_a"), F.lit(1), F.col("prompt_turns"))).alias("prompt"), rendered(F.col("_c")).alias("chosen"), rendered(F.col("_r")).alias("rejected"),
        mask(F.col("_c"), trained).alias("chosen_mask"), mask(F.col("_r"), trained).alias("rejected_mask"), ((F.size("_c") > 0) | (F.size("_r") > 0)).alias("differs"),
    )


def preferences(chosen: DataFrame, rejected: DataFrame, pair_id: str = "conv_id", trained: str = TRAINED, **columns) -> DataFrame:
    """Pairs from two tables of turns that share ``pair_id``. A pair that only one table has meets an empty conversation."""
    a = conversations(chosen, pair_id, **columns).select(F.col("conv_id").alias(pair_id), F.col("turns").alias("chosen_turns"))
    b = conversations(rejected, pair_id, **columns).select(F.col("conv_id").alias(pair_id), F.col("turns").alias("rejected_turns"))
    return format_pairs(a.join(b, pair_id, "full"), trained=trained)


def swapped_replies(convs: DataFrame, trained: str = TRAINED) -> DataFrame:
    """``(conv_id, chosen_turns, rejected_turns)``: each conversation, and itself with its last reply swapped for its neighbour's.

    Neighbours are the conversations ``2k`` and ``2k + 1``. Without a reply of the neighbour, the rejected one's reply is empty; a
    conversation without a reply is its own rejected one.
    """
    def last(turns: Column) -> Column:
        return F.array_max(F.transform(turns, lambda t, i: F.when(t["role"] == trained, i)))

    own = convs.withColumn("_last", last(F.col("turns")))
    other = own.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.when(F.col("_last").isNotNull(), F.element_at("turns", F.col("_last") + 1)["text"]).alias("_reply"))
    paired = own.join(other, "conv_id", "left")
    new = F.transform("turns", lambda t, i: F.when(i == F.col("_last"), F.struct(t["turn"].alias("turn"), t["role"].alias("role"), F.coalesce("_reply", F.lit("")).alias("text"))).otherwise(t))
    return paired.select("conv_id", F.col("turns").alias("chosen_turns"), new.alias("rejected_turns"))
