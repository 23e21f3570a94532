"""Mixing sources to target weights by fitting a subset sum of document lengths.

Every source gets a target in words. Its documents are taken whole as often as they fit (``repeats``); what is left of the target is
a subset-sum problem over the source's documents. Those are counted by exact length. Most of the budget is spread over all lengths in
proportion, and a bounded-knapsack dynamic program over what is left of each length fills the last ``window`` words exactly where it
can. Of each length the documents with the least seeded keys are taken, so that a rerun takes the same ones.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.llm.text import Words, binary, blocks, extended
from vecloom.operators.catalog import global_rank
from vecloom.session import snapshot

WEIGHTS, MOST, SEED, WINDOW = (5, 2, 1), 3, 42, 1 << 16
#: Documents of one length that are ordered in one group.
GROUP = 4096


def with_size(docs: DataFrame, text: str = "text", name: str = "size") -> DataFrame:
    """``docs`` and the number of words of each text; null: 0."""
    at, schema = docs.columns.index(text), extended(docs.schema, **{name: "long"})

    def run(batches):
        for batch in batches:
            sizes = [Words(b).counts() for b in blocks(binary(batch.column(at)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(sizes) if sizes else [], pa.int64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def document_key(doc_id: str, text: str, seed: int) -> Column:
    """The order in which documents of one length are taken."""
    return F.xxhash64(F.lit(seed), F.col(doc_id), F.coalesce(F.col(text), F.lit("")))


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST, share: float = 1.0) -> DataFrame:
    """``sources`` (``source``, ``size``) with ``target``: ``share`` of all sizes dealt by weight, at most ``most`` sizes each.

    Sources take the weights in turn in the order of their names' code points, null last. What a source can't take is dealt to the
    others by weight until none is above. Each round is one aggregate over the sources' table.
    """
    named = sources.withColumn("_null", F.col("source").isNull())
    ranked = snapshot(global_rank(named, ["_null", "source"], name="_rank").drop("_null"), "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("_cap", F.col("size") * F.lit(float(most)))
    total = (ranked.agg(F.sum("size")).first()[0] or 0) * share
    level = 0.0
    while True:
        full = F.col("_cap") <= F.lit(level) * F.col("weight")
        spent, left = ranked.agg(F.sum(F.when(full, F.col("_cap")).otherwise(0.0)), F.sum(F.when(~full, F.col("weight")).otherwise(0.0))).first()
        after = max(0.0, total - (spent or 0.0)) / left if left else level
        if after <= level:
            return ranked.withColumn("target", F.least("_cap", F.lit(level) * F.col("weight"))).drop("_cap", "_rank")
        level = after


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = WINDOW) -> np.ndarray:
    """How many documents of each length to take so that their words come to ``budget``, or as near below as the program finds.

    Exact (the best sum there is) where the budget is within ``window``. Beyond, the part above is spread first: each length, from the
    longest, takes its share and hands what it could not use to the next.
    """
    take = np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    whole = int((lengths[order] * counts[order]).sum())
    if budget >= whole:
        take[order] = counts[order]
        return take
    spread, carry = max(0, budget - window), 0.0
    for i in order.tolist() if spread else ():
        carry += spread / whole * float(counts[i]) * float(lengths[i])
        take[i] = min(int(counts[i]), int(carry // int(lengths[i])))
        carry -= float(take[i]) * float(lengths[i])
    rest = int(budget - (take * lengths).sum())
    # reached[s]: which lot first made the sum s.
    reached, lots = np.full(rest + 1, -1, np.int32), [(0, 0)]
    reached[0] = 0
    for i in order.tolist():
        length, free, lot = int(lengths[i]), int(counts[i] - take[i]), 1
        free = min(free, rest // length)
        while free > 0 and reached[rest] < 0:
            n = min(lot, free)
            step = n * length
            new = (reached[:rest + 1 - step] >= 0) & (reached[step:] < 0)
            reached[step:][new] = len(lots)
            lots.append((i, n))
            free, lot = free - n, lot * 2
    s = int(np.flatnonzero(reached >= 0)[-1])
    while s:
        i, n = lots[reached[s]]
        take[i] += n
        s -= n * int(lengths[i])
    return take


def mixture(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, most: int = MOST, share: float = 1.0, seed: int = SEED, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """``(lean, plan)``: every document with its size and key, and for each source and size how the mix takes them.

    ``lean``: ``doc_id, source, size, key``. ``plan``: ``source, size, source_size, target, repeats, last``: a document is taken
    ``repeats`` times, and once more if its key is at most ``last`` (null: none).

    A null text has size 0 and is never taken. A null source is a source. Rows that repeat an id and its text share a key: they are
    taken once more together or not at all, so such repeats may move a sum past its target by their words. An empty table gives
    empty results.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"), document_key(doc_id, text, seed).alias("key"))
    lean = snapshot(with_size(rows).select("doc_id", "source", "size", "key"), "lean")
    lengths = snapshot(lean.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    sized = targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size")), weights, most, share)
    sized = sized.withColumn("repeats", F.coalesce(F.floor(F.try_divide("target", "size")), F.lit(0)))
    sized = snapshot(sized.withColumn("budget", F.round(F.col("target") - F.col("repeats") * F.col("size")).cast("long")), "targets")
    sized = sized.select(F.col("source").alias("_s"), F.col("size").alias("source_size"), "target", "repeats", "budget")
    wanted = lengths.join(sized, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("size")
        return frame.assign(take=fit(frame["size"].to_numpy(), frame["n"].to_numpy(), int(frame["budget"].iloc[0]), window))

    # One row per distinct length of a source: bounded by the longest text, however many documents there are.
    chosen = snapshot(wanted.groupBy("source").applyInPandas(choose, extended(wanted.schema, take="long")), "chosen")

    # The key of the last document to take: count keys by range, then order only the range in which it lies.
    part = chosen.where("take > 0").select(F.col("source").alias("_s"), F.col("size").alias("_z"), "n", "take")
    pool = lean.join(part, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")))
    pool = pool.select("source", "size", "key", "take", F.least(F.floor((F.col("key") / F.lit(2.0**64) + 0.5) * F.ceil(F.col("n") / GROUP)), F.ceil(F.col("n") / GROUP) - 1).alias("range"))
    ranges = pool.groupBy("source", "size", "take", "range").agg(F.count("*").alias("m"))
    running = Window.partitionBy("source", "size").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("m").over(running), F.lit(0))).where("before < take AND before + m >= take")
    ranges = snapshot(ranges.select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("range").alias("_r"), (F.col("take") - F.col("before")).alias("left")), "ranges")
    final = pool.join(ranges, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("range") == F.col("_r")))
    final = final.withColumn("rn", F.row_number().over(Window.partitionBy("source", "size").orderBy("key"))).where("rn = left")
    final = final.select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("key").alias("last"))
    plan = chosen.join(final, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")), "left")
    return lean, snapshot(plan.select("source", "size", "source_size", "target", "repeats", "last"), "plan")


def with_copies(rows: DataFrame, plan: DataFrame, source: str = "source", size: str = "size", key: str = "key", name: str = "copies") -> DataFrame:
    """``rows`` with how often the mix takes each, and its source's ``source_size`` and ``target``."""
    plan = plan.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "source_size", "target", "repeats", "last")
    joined = rows.join(plan, F.col(source).eqNullSafe(F.col("_s")) & (F.col(size) == F.col("_z")))
    more = F.when(F.col(key) <= F.col("last"), 1).otherwise(0)
    return joined.withColumn(name, (F.col("repeats") + more).cast("int")).drop("_s", "_z", "repeats", "last")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """``docs`` as mixed: a row as often as it is taken, columns unchanged. Documents without words are taken 0 times."""
    _, plan = mixture(docs, doc_id, text, source, **options)
    kept, taken = docs.columns, {"source": "_source", "size": "_size", "key": "_key"}
    rows = with_size(docs, text, "_size").withColumn("_key", document_key(doc_id, text, options.get("seed", SEED))).withColumn("_source", F.col(source).cast("string"))
    plan = plan.select("source", "size", "repeats", "last").withColumns({"source_size": F.lit(0), "target": F.lit(0.0)})
    rows = with_copies(rows, plan, **taken, name="_copies").where("_size > 0 AND _copies > 0")
    return rows.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*kept)
