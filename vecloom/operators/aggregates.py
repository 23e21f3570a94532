"""Aggregations over vectors and feature columns.

Element-wise means and moments use ``Summarizer``: one buffer of ``dim``
numbers per group and task, merged after a map-side combine, so neither wide
vectors nor a hot group are exploded or shuffled row by row.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions.vectors import _col
from vecloom.session import snapshot

#: Rank error of a quantile sketch of k entries, for one rank at 99 in 100: this over k ** 0.9.
KLL_ERROR = 2.296


def mean_vector(c) -> Column:
    """Element-wise mean as an aggregate expression; null rows do not count."""
    return vector_to_array(Summarizer.mean(array_to_vector(_col(c))))


def sum_vector(c) -> Column:
    return vector_to_array(Summarizer.sum(array_to_vector(_col(c))))


def artist_mean_vector(songs: DataFrame, owner: str = "artist_id", vector: str = "feature_vector", min_songs: int = 5, min_valid: int = 1) -> DataFrame:
    """Mean of the valid vectors of each owner with enough songs.

    ``vector`` is null where a song's vector is invalid; such songs count for
    ``min_songs`` only. The batch rule is (5, 1), the online rule (5, 5).
    """
    counted = songs.groupBy(owner).agg(F.count("*").alias("song_count"), F.count(vector).alias("n_valid"))
    eligible = counted.filter((F.col("song_count") >= min_songs) & (F.col("n_valid") >= max(min_valid, 1)))
    means = songs.filter(F.col(vector).isNotNull()).groupBy(owner).agg(mean_vector(vector).alias("mean_vector"))
    return eligible.join(means, owner).select(owner, "song_count", "n_valid", "mean_vector")


def feature_stats(df: DataFrame, vector: str) -> DataFrame:
    """One row per position: count, mean, population variance and std, min, max."""
    v = array_to_vector(F.col(vector))
    s = df.agg(Summarizer.metrics("count", "mean", "variance", "min", "max").summary(v).alias("s"))
    arrays = s.select(
        F.col("s.count").alias("n"),
        F.arrays_zip(*[vector_to_array(F.col(f"s.{m}")).alias(m) for m in ("mean", "variance", "min", "max")]).alias("z"),
    )
    long = arrays.select("n", F.posexplode("z").alias("pos", "z"))
    n = F.col("n").cast("double")
    var_pop = F.greatest(F.lit(0.0), F.col("z.variance") * (n - 1) / n)
    return long.select(
        "pos", "n", F.col("z.mean").alias("mean"), var_pop.alias("var_pop"), F.sqrt(var_pop).alias("std_pop"),
        F.col("z.min").alias("min"), F.col("z.max").alias("max"),
    )


def data_quality(df: DataFrame, vector: str) -> DataFrame:
    """Whole-matrix report; missing items are NaN or null and do not enter the moments."""
    x = df.select(F.explode(vector).alias("x"), F.size(vector).alias("d"))
    bad = F.col("x").isNull() | F.isnan("x")
    ok = F.when(~bad, F.col("x"))
    return x.agg(
        F.max("d").alias("total_features"),
        (F.count("*") / F.max("d")).cast("bigint").alias("total_rows"),
        F.avg(ok).alias("matrix_mean"),
        F.stddev_pop(ok).alias("matrix_std"),
        F.min(ok).alias("matrix_min"),
        F.max(ok).alias("matrix_max"),
        F.count(F.when(bad, 1)).alias("total_missing"),
    )


def constant_features(df: DataFrame, vector: str, tolerance: float = 1e-10) -> DataFrame:
    return feature_stats(df, vector).filter(F.col("std_pop") < tolerance).select("pos", "std_pop")


def low_variance(df: DataFrame, vector: str, threshold: float = 1e-5) -> DataFrame:
    return feature_stats(df, vector).filter(F.col("var_pop") < threshold).select("pos", "var_pop")


def group_stats(df: DataFrame, vector: str, groups: dict) -> DataFrame:
    """Mean, population std, min and max over all items of each named slice.

    Built from the per-position moments: ``dim`` rows instead of all items.
    """
    spans = F.array(
        *[F.struct(F.lit(g).alias("group"), F.lit(a).alias("a"), F.lit(b).alias("b")) for g, (a, b, _) in groups.items()]
    )
    stats = feature_stats(df, vector).withColumn("span", F.explode(spans))
    inside = stats.filter((F.col("pos") >= F.col("span.a")) & (F.col("pos") < F.col("span.b")))
    mean = F.avg("mean")
    second = F.avg(F.col("var_pop") + F.col("mean") * F.col("mean"))
    return inside.groupBy(F.col("span.group").alias("group")).agg(
        mean.alias("mean"),
        F.sqrt(F.greatest(F.lit(0.0), second - mean * mean)).alias("std"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
    )


def exact_percentiles(long: DataFrame, key: str, value: str, probs: list[float], sketch: int = 4096) -> DataFrame:
    """Exact linear-interpolated percentiles per key: ``(key, prob, value)``.

    The built-in exact ``percentile`` keeps every distinct value of a key in
    one task. Here the rows are read twice. The first time a mergeable
    quantile sketch of each key, of ``sketch`` entries, brackets each wanted
    rank by its rank error. The second time rows outside all brackets of their
    key are only counted, and those inside are kept by value with a count;
    they are put in order over all tasks, and the wanted ranks picked. A
    bracket that missed its rank, which the counts show, is made eight times
    as wide and tried again. Any number of keys, and any size of a key: all of
    it stays in tables. Nulls and NaNs don't count.
    """
    probs = [float(p) for p in probs]
    rows = long.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    marks = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.kll_sketch_agg_double("v", F.lit(sketch)).alias("s"))
    marks = snapshot(marks.filter("n > 0"), "marks")
    ranks = [F.floor(F.lit(p) * (F.col("n") - 1)) for p in probs]
    wide, done, todo = 2.0 * KLL_ERROR / sketch**0.9, None, marks
    while True:
        # Brackets by rank, one entry per probability in rising order; outermost ones reach the ends, and so do those of a key that the
        # sketch could hold whole.
        lows, highs = [max(0.0, p - wide) for p in sorted(probs)], [min(1.0, p + wide) for p in sorted(probs)]
        q = F.kll_sketch_get_quantile_double("s", F.array(*[F.lit(x) for x in lows + highs]))
        small = F.col("n") <= sketch
        lo = [F.when(small | F.lit(x <= 0), F.col("least")).otherwise(F.get("q", F.lit(i))) for i, x in enumerate(lows)]
        hi = [F.when(small | F.lit(x >= 1), F.col("most")).otherwise(F.get("q", F.lit(len(probs) + i))) for i, x in enumerate(highs)]
        brackets = todo.withColumn("q", q).select("k", "n", F.array(*lo).alias("lo"), F.array(*hi).alias("hi"))
        met = rows.join(brackets.drop("n"), "k")
        region = sum((F.when(F.get("lo", F.lit(i)) <= F.col("v"), 1).otherwise(0) for i in range(1, len(probs))), F.when(F.get("lo", F.lit(0)) <= F.col("v"), 1).otherwise(0))
        inside = F.lit(False)
        for i in range(len(probs)):
            inside = inside | F.col("v").between(F.get("lo", F.lit(i)), F.get("hi", F.lit(i)))
        runs = snapshot(met.groupBy("k", region.alias("region"), F.when(inside, F.col("v")).alias("v")).agg(F.count("*").alias("c")), "runs")

        # Rows kept out of all brackets below each bracket, and so the wanted places among the rows inside.
        skipped = [F.coalesce(F.sum(F.when(F.col("v").isNull() & (F.col("region") <= i), F.col("c"))), F.lit(0)) for i in range(len(probs))]
        below = runs.groupBy("k").agg(F.array(*skipped).alias("skipped"))
        order = sorted(range(len(probs)), key=probs.__getitem__)
        wanted = []
        for slot, i in enumerate(order):
            for side in (0, 1):
                rank = F.least(ranks[i] + side, F.col("n") - 1)
                wanted.append(F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), (rank - F.get("skipped", F.lit(slot))).alias("at"), F.get("lo", F.lit(slot)).alias("lo"), F.get("hi", F.lit(slot)).alias("hi")))
        wanted = brackets.join(below, "k").select("k", F.array(*wanted).alias("wanted"))
        placed = running_total(runs.filter("v IS NOT NULL"), "k", "v", "c", "before").join(wanted, "k")
        hits = F.filter("wanted", lambda w: (w["at"] >= F.col("before")) & (w["at"] < F.col("before") + F.col("c")) & F.col("v").between(w["lo"], w["hi"]))
        picked = placed.select("k", "v", F.explode(hits).alias("w")).select("k", "v", "w.i", "w.side")
        both = picked.groupBy("k", "i").agg(F.max(F.when(F.col("side") == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("v"))).alias("b"))
        found = snapshot(both.filter("a IS NOT NULL AND b IS NOT NULL"), "percentiles")
        whole = found.groupBy("k").agg(F.count("*").alias("m")).filter(F.col("m") == len(probs))
        right = found.join(whole.select("k"), "k")
        done = right if done is None else done.unionByName(right)
        left = todo.join(whole.select("k"), "k", "left_anti")
        if left.isEmpty():
            break
        todo, wide = snapshot(left, "marks"), min(1.0, wide * 8)
    prob = F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("i") + 1)
    at = prob * (F.col("n") - 1)
    out = done.join(marks.select("k", "n"), "k")
    return out.select(F.col("k").alias(key), prob.alias("prob"), (F.col("a") + (F.col("b") - F.col("a")) * (at - F.floor(at))).alias("value"))


def running_total(df: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its key with a lesser ``order``; distinct orders per key.

    Rows go to range slices; sums run inside a slice and over slices, so a key of any size is never in one task.
    """
    sliced = snapshot(df.repartitionByRange(key, order).withColumn("_slice", F.spark_partition_id()), "slices")
    sums = sliced.groupBy(key, "_slice").agg(F.sum(value).alias("_n"))
    over = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(key, "_slice", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(key, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = sliced.join(base, [key, "_slice"]).withColumn(name, F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return out.drop("_slice", "_base")


def percentiles(df: DataFrame, value: str, probs=(0.85, 0.90, 0.95, 0.99), group: str | None = None) -> DataFrame:
    key = F.col(group) if group else F.lit(0)
    return exact_percentiles(df.select(key.alias("key"), F.col(value).cast("double").alias("x")), "key", "x", list(probs))


def high_corr_pairs(df: DataFrame, vector: str, threshold: float = 0.95) -> DataFrame:
    """Position pairs ``i < j`` with ``threshold < correlation < 1``.

    The correlation matrix has ``dim * dim`` entries whatever the row count.
    """
    from pyspark.ml.stat import Correlation

    spark = df.sparkSession
    points = df.select(array_to_vector(F.col(vector)).alias("v"))
    corr = Correlation.corr(points, "v").head()[0].toArray()
    rows = [(i, [float(x) for x in corr[i]]) for i in range(len(corr))]
    table = spark.createDataFrame(rows, "i int, row array<double>")
    return (
        table.select("i", F.posexplode("row").alias("j", "corr"))
        .filter((F.col("i") < F.col("j")) & (F.col("corr") > threshold) & (F.col("corr") < 1.0))
    )
