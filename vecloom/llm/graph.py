"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.session import discard, scratch_path


def _store(df: DataFrame, held: list[str], name: str) -> DataFrame:
    held.append(path := scratch_path(df.sparkSession, name))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node that has a link to another; nodes of one component share a root, which is one of them.

    Each round hooks every node to its least neighbour, follows that pointer once more and contracts the links to what is left, so
    long chains shrink by a factor per round. Every table of a round is written to the shared folder, and those of the round before
    are deleted. A node with very many links is a skewed key of plain joins between stored tables, which Spark splits; the minimum
    per node is combined before the shuffle. Null ends and loops are left out; repeated links count once; no links give no rows.
    """
    spark = edges.sparkSession
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    held: list[str] = []
    links = _store(ends.union(ends.select("v", "u")).distinct(), held, "links")
    state = None
    while not links.isEmpty():
        before, held = held, []
        hook = _store(links.groupBy("u").agg(F.least("u", F.min("v")).alias("p")), held, "hooks")
        jump = _store(hook.join(hook.select(F.col("u").alias("p"), F.col("p").alias("r")), "p").select("u", "r"), held, "jumps")
        if state is None:
            state = jump.select(F.col("u").alias("node"), F.col("r").alias("root"))
        else:
            moved = jump.select(F.col("u").alias("root"), "r")
            state = _store(state.join(moved, "root", "left").select("node", F.coalesce("r", "root").alias("root")), held, "roots")
        left = links.join(jump.withColumnRenamed("r", "ru"), "u")
        left = left.join(jump.select(F.col("u").alias("v"), F.col("r").alias("rv")), "v")
        links = _store(left.where("ru <> rv").select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct(), held, "links")
        discard(spark, *before)
    if state is None:
        return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return state
