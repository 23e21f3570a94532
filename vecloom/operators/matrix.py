"""Feature-matrix transforms: scaling, preprocessing, projection."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.functions import vectors as V
from vecloom.operators.aggregates import exact_percentiles, feature_stats

LO, HI = -2.0, 2.0


def scale_parameters(df: DataFrame, vector: str, method: str) -> tuple[list[float], list[float]]:
    """``(shift, factor)`` per position; ``dim`` rows reach the driver."""
    if method == "robust":
        long = df.select(F.posexplode(vector).alias("pos", "x"))
        q = exact_percentiles(long, "pos", "x", [0.25, 0.5, 0.75]).collect()
        at = {(r["pos"], r["prob"]): r["value"] for r in q}
        dim = 1 + max(pos for pos, _ in at)
        shift = [at[(i, 0.5)] for i in range(dim)]
        spread = [at[(i, 0.75)] - at[(i, 0.25)] for i in range(dim)]
        return shift, [1.0 / s if s != 0 else 1.0 for s in spread]
    rows = sorted(feature_stats(df, vector).collect(), key=lambda r: r["pos"])
    if method == "standard":
        # A spread that is only rounding noise counts as constant.
        return (
            [r["mean"] for r in rows],
            [1.0 / r["std_pop"] if r["std_pop"] > 1e-12 * max(1.0, abs(r["mean"])) else 1.0 for r in rows],
        )
    if method == "minmax":
        factor = [(HI - LO) / (r["max"] - r["min"]) if r["max"] > r["min"] else 1.0 for r in rows]
        return [r["min"] - LO / f for r, f in zip(rows, factor)], factor
    raise ValueError(f"unknown scaling {method!r}")


def scale(df: DataFrame, vector: str, method: str = "standard", out: str | None = None) -> DataFrame:
    """Scale every position.

    standard  (x - mean) / population std; constant becomes 0
    robust    (x - median) / IQR, exact; an IQR of 0 divides by 1
    minmax    to [-2, 2]; constant becomes -2
    """
    shift, factor = scale_parameters(df, vector, method)
    spec = F.arrays_zip(V.literal_vector(shift).alias("s"), V.literal_vector(factor).alias("f"))
    return df.withColumn(out or vector, F.zip_with(F.col(vector), spec, lambda x, p: (x - p["s"]) * p["f"]))


def preprocess(df: DataFrame, vector: str, groups: dict, dim: int, method: str = "standard") -> DataFrame:
    """Clean, scale, weight the groups, clip."""
    clean = df.withColumn(vector, V.clean_vector(vector, dim))
    scaled = scale(clean, vector, method)
    return scaled.withColumn(vector, V.clip(V.apply_group_weights(vector, groups, dim)))


def pca(df: DataFrame, vector: str, k: int | None = None, variance: float | None = None, out: str = "reduced"):
    """Centred projection on the leading components.

    Returns ``(df, components, explained)``; ``k`` defaults to
    ``min(50, dim // 2)`` and ``variance`` picks the least k that reaches that
    share. The sign of each component makes its largest loading positive. The
    fit gathers a ``dim * dim`` matrix, whatever the row count.
    """
    stats = sorted(feature_stats(df, vector).collect(), key=lambda r: r["pos"])
    dim = len(stats)
    means = [r["mean"] for r in stats]
    want = dim if variance is not None else (k or min(50, dim // 2))
    centred = F.zip_with(F.col(vector), V.literal_vector(means), lambda x, m: x - m)
    points = df.select(array_to_vector(centred).alias("c"))
    model = PCA(k=want, inputCol="c", outputCol="p").fit(points)
    load = model.pc.toArray().copy()
    explained = [float(x) for x in model.explainedVariance.toArray()]
    if variance is not None:
        total, want = 0.0, 0
        while want < dim and total < variance:
            total += explained[want]
            want += 1
        load, explained = load[:, :want], explained[:want]
    for j in range(load.shape[1]):
        if load[abs(load[:, j]).argmax(), j] < 0:
            load[:, j] *= -1.0
    return project(df, vector, means, load, out), load, explained


def project(df: DataFrame, vector: str, means, load, out: str = "reduced") -> DataFrame:
    """Scores on given components: one matrix product per Arrow batch."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import types as T

    from vecloom.functions import arrow

    centre, axes = np.asarray(means, dtype=float), np.asarray(load, dtype=float)
    keep = [c for c in df.columns if c != out]

    def run(batches):
        for b in batches:
            x = arrow.matrix(b.column(vector)) if b.num_rows else np.zeros((0, len(centre)))
            scores = (x - centre) @ axes
            yield pa.RecordBatch.from_arrays([*b.columns, arrow.vectors(scores)], names=[*b.schema.names, out])

    base = df.select(*keep)
    return base.mapInArrow(run, T.StructType(base.schema.fields + [T.StructField(out, T.ArrayType(T.DoubleType()))]))


def pca_2d(df: DataFrame, vector: str, out: str = "xy") -> DataFrame:
    """Two-component view; data without any variance maps to the origin."""
    spread = feature_stats(df, vector).agg(F.sum("var_pop")).head()[0]
    if not spread:
        return df.withColumn(out, F.array(F.lit(0.0), F.lit(0.0)))
    return pca(df, vector, k=2, out=out)[0]
