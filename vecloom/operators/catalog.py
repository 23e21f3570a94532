"""Catalogue maintenance: work lists, enrichment, caps, samples, summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vecloom.functions.metadata import blank_fill
from vecloom.session import snapshot


def skip_processed(source: DataFrame, done: DataFrame, key: str, done_key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Split the source into (still to do, already processed)."""
    # Distinct first: a key stored many times combines before the shuffle.
    ids = done.select(F.col(done_key or key).alias("_done")).distinct()
    match = F.col(key) == F.col("_done")
    return source.join(ids, match, "left_anti"), source.join(ids, match, "left_semi")


def except_ids(source: DataFrame, done: DataFrame, key: str, done_key: str | None = None) -> DataFrame:
    ids = done.select(F.col(done_key or key).alias(key)).distinct()
    return source.select(key).distinct().join(ids, key, "left_anti")


def run_summary(source: DataFrame, done: DataFrame, key: str, done_key: str | None = None, ok: str | None = None, seconds: str | None = None) -> DataFrame:
    """Totals of a run: processed, to do, percent; optional success rate and time."""
    ids = done.select(F.col(done_key or key).alias("_done")).distinct()
    tagged = source.join(ids, F.col(key) == F.col("_done"), "left")
    processed = F.count("_done")
    total = F.count("*")
    out = [
        total.alias("total"),
        processed.alias("processed"),
        (total - processed).alias("todo"),
        F.try_divide(processed * 100.0, total).alias("percent_done"),
    ]
    if ok is not None:
        out.append((F.avg(F.col(ok).cast("double")) * 100.0).alias("success_rate"))
    if seconds is not None:
        out.append(F.avg(seconds).alias("avg_seconds"))
    return tagged.agg(*out)


def enrich_missing(target: DataFrame, metadata: DataFrame, key: str, columns: dict[str, tuple]) -> DataFrame:
    """Fill gaps from ``metadata``; of several rows of a key the greatest counts.

    ``columns`` maps a column to the values that count as blank besides null;
    an empty tuple means that only null is filled.
    """
    new = metadata.select(F.col(key).alias("_key"), F.struct(*columns).alias("_new")).groupBy("_key").agg(F.max("_new").alias("_new"))
    joined = target.join(new, F.col(key) == F.col("_key"), "left")
    out = []
    for c in target.columns:
        out.append(blank_fill(F.col(c), F.col(f"_new.{c}"), columns[c]).alias(c) if c in columns else F.col(c))
    return joined.select(*out)


def song_count(songs: DataFrame, owner: str) -> DataFrame:
    return songs.groupBy(owner).agg(F.count("*").alias("song_count"))


def songs_with_clusters(songs: DataFrame, clusters: DataFrame, algorithm: str, key: str = "song_id", require: str | None = None) -> DataFrame:
    kept = clusters.filter(F.col("algorithm") == algorithm)
    if require:
        kept = kept.filter(F.col(require).isNotNull())
    return songs.join(kept, key, "inner")


def label_pairs(songs: DataFrame, clusters: DataFrame, first: tuple[str, str], second: tuple[str, str], key: str = "song_id") -> DataFrame:
    """Songs labelled by both algorithms: ``(key, label_a, label_b)``.

    ``first`` and ``second`` are (algorithm, label column).
    """
    def side(spec, name):
        algorithm, column = spec
        return clusters.filter((F.col("algorithm") == algorithm) & F.col(column).isNotNull()).select(key, F.col(column).alias(name))

    return songs.select(key).join(side(first, "label_a"), key).join(side(second, "label_b"), key)


def union_results(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def global_rank(df: DataFrame, order: Sequence, group: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Position (from 1) of every row of a group in a total order.

    Rows are range-partitioned on the order, numbered inside each slice, and
    shifted by the counts of the earlier slices, so no task sorts a whole
    group. ``order`` must be unique within a group.
    """
    group = list(group)
    sliced = snapshot(df.repartitionByRange(*group, *order).withColumn("_slice", F.spark_partition_id()), "rank")
    sizes = sliced.groupBy(*group, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(*group, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(*group, "_slice").orderBy(*order)
    keys = [*group, "_slice"]
    return (
        sliced.withColumn("_rn", F.row_number().over(inside))
        .join(shift, keys)
        .withColumn(name, (F.col("_rn") + F.col("_shift")).cast("bigint"))
        .drop("_slice", "_rn", "_shift")
    )


def first_n(df: DataFrame, order, n: int) -> DataFrame:
    return df.orderBy(order).limit(n)


def cap_per_playlist(items: DataFrame, playlist: str, position: Sequence[str], cap: int = 1000) -> DataFrame:
    """The first ``cap`` items of every playlist.

    Spark filters ``row_number() <= cap`` inside each input partition before
    the shuffle (window group limit), so a huge playlist sends at most ``cap``
    rows per partition.
    """
    w = Window.partitionBy(playlist).orderBy(*position)
    return items.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= cap).drop("_rn")


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, the same for any partitioning."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), F.col(key)).limit(n)


def eps_candidates(spark, eps_by_min_samples: DataFrame, points: int = 5, min_samples=(3, 6, 10), limit: int | None = None) -> DataFrame:
    """Search grid from suggested eps values: ``(eps, min_samples)``.

    All suggestions plus ``points`` values from half the least to 1.5 times the
    greatest, rounded; then ``points`` evenly spaced values between the ends.
    Input: ``(min_samples, eps array)``, a handful of rows.
    """
    every = eps_by_min_samples.select(F.explode("eps").alias("e"))
    ends = every.agg(F.min("e").alias("lo"), F.max("e").alias("hi"))

    def spaced(lo, hi):
        return F.transform(
            F.sequence(F.lit(0), F.lit(points - 1)),
            lambda i: lo + (hi - lo) * i.cast("double") / F.lit(float(points - 1)),
        )

    extra = ends.filter(F.col("lo").isNotNull()).select(F.explode(spaced(F.col("lo") * 0.5, F.col("hi") * 1.5)).alias("e"))
    pool = every.union(extra).select(F.bround("e", 3).alias("e")).distinct()
    shape = pool.agg(F.min("e").alias("lo"), F.max("e").alias("hi"), F.count("*").alias("m"))
    steps = shape.filter(F.col("m") > 0).select(
        F.posexplode(
            F.when(F.col("m") >= points, spaced(F.col("lo"), F.col("hi"))).otherwise(
                F.transform(
                    F.sequence(F.lit(0), F.col("m").cast("int") - 1),
                    lambda i: F.col("lo") + F.when(F.col("m") > 1, (F.col("hi") - F.col("lo")) * i / (F.col("m") - 1)).otherwise(0.0),
                )
            )
        ).alias("i", "eps")
    )
    combos = steps.select("i", F.bround("eps", 3).alias("eps"), F.posexplode(F.array(*[F.lit(m) for m in min_samples])).alias("j", "min_samples"))
    if limit is not None:
        combos = combos.orderBy("j", "i").limit(limit)
    return combos.select("eps", "min_samples")
