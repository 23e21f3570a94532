"""k-means. Restarts and cluster numbers share every scan of the data."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.functions import arrow
from vecloom.operators.partials import sum_partials

#: Drawing scans of a k-means|| start.
ROUNDS = 2


@contextmanager
def held(df: DataFrame, *columns) -> Iterator[DataFrame]:
    """``columns`` of ``df``, cached once; of a frame that is cached already it is a mere selection."""
    rows = df.select(*columns)
    if df.is_cached:
        rows.is_cached = True
        yield rows
        return
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield rows
    finally:
        rows.unpersist()


def first_rows(df: DataFrame, id_col: str, vector: str, k: int) -> np.ndarray:
    """The vectors of the ``k`` lowest ids, a deterministic start."""
    return np.array([list(r[vector]) for r in df.select(id_col, vector).orderBy(id_col).limit(k).collect()])


def random_rows(df: DataFrame, id_col: str, vector: str, sizes: Sequence[int], seed: int) -> list[np.ndarray]:
    """Distinct random rows for each size; one ordered scan, ``sum(sizes)`` rows at most."""
    pool = df.select(vector, id_col).orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(sum(sizes)).collect()
    rows = np.array([list(r[0]) for r in pool])
    rng = np.random.default_rng(seed)
    return [rows[rng.choice(len(rows), size=min(k, len(rows)), replace=False)] for k in sizes]


def plus_plus_rows(df: DataFrame, id_col: str, vector: str, k: int, n_init: int, seed: int) -> list[np.ndarray]:
    """k-means++ starts: each next row drawn with weight = squared distance.

    Each of the k scans draws for all restarts at once: every task keeps its
    best exponential key per restart, and the best over tasks wins.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(vector).alias("vec"))
    starts = [s.copy() for s in random_rows(df, id_col, vector, [1] * n_init, seed)]
    schema = T.StructType([T.StructField("init", T.IntegerType()), T.StructField("key", T.DoubleType()), T.StructField("vec", T.ArrayType(T.DoubleType()))])
    for step in range(1, k):
        centres = [s.copy() for s in starts]

        def draw(batches, centres=centres, step=step):
            best = {}
            for b in batches:
                if not b.num_rows:
                    continue
                x = arrow.matrix(b.column("vec"))
                u = b.column("u").to_numpy()
                for i, c in enumerate(centres):
                    w = arrow.distances(x, c).min(axis=1) ** 2
                    # A different hash stream per restart and step.
                    v = np.modf(u * (7919.0 + 104729.0 * i + 1299709.0 * step))[0]
                    with np.errstate(divide="ignore"):
                        key = np.where(w > 0, np.log(np.maximum(v, 1e-300)) / np.where(w > 0, w, 1.0), -np.inf)
                    j = int(key.argmax())
                    if i not in best or key[j] > best[i][0]:
                        best[i] = (key[j], x[j])
            if best:
                keys = sorted(best)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int32()), pa.array([best[i][0] for i in keys], pa.float64()), arrow.vectors(np.array([best[i][1] for i in keys]))],
                    names=["init", "key", "vec"],
                )

        u = (F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1 << 52)) + 1) / float(1 << 52)
        won = rows.withColumn("u", u).mapInArrow(draw, schema).groupBy("init").agg(F.max_by("vec", "key").alias("vec")).collect()
        for r in won:
            starts[r["init"]] = np.vstack([starts[r["init"]], np.array(r["vec"])])
    return starts


def parallel_rows(df: DataFrame, id_col: str, vector: str, k: int, n_init: int, seed: int, rounds: int = ROUNDS) -> list[np.ndarray]:
    """k-means|| starts: ``rounds`` scans each draw ``2 k`` rows for every restart with weight = squared distance, one scan counts the rows
    nearest to each drawn row, and a weighted k-means++ draw over these few gives the start. The number of scans does not depend on ``k``;
    the first ``j`` rows of a start are a start for ``j`` clusters. Fewer distinct rows than ``k`` give repeated start rows.
    """
    u = (F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 52)) + 1) / float(1 << 52)
    rows = df.select(F.col(vector).alias("vec"), u.alias("u"))
    drawn = [s.copy() for s in random_rows(df, id_col, vector, [1] * n_init, seed)]
    if not len(drawn[0]):
        return drawn
    many = 2 * k
    schema = "init int, key double, vec array<double>, task int"
    for step in range(1, rounds + 1):
        centres = [s.copy() for s in drawn]

        def draw(batches, centres=centres, step=step):
            best = [(np.zeros(0), np.zeros((0, c.shape[1]))) for c in centres]
            for b in batches:
                x, u = (arrow.matrix(b.column("vec")), b.column("u").to_numpy()) if b.num_rows else (None, None)
                for i, c in enumerate(centres if b.num_rows else []):
                    w = arrow.distances(x, c).min(axis=1) ** 2
                    at = np.flatnonzero(w > 0)
                    # A different hash stream per restart and step; the greatest keys are a weighted draw without repeats.
                    v = np.modf(u[at] * (7919.0 + 104729.0 * i + 1299709.0 * step))[0]
                    keys, held = np.concatenate((best[i][0], np.log(np.maximum(v, 1e-300)) / w[at])), np.vstack((best[i][1], x[at]))
                    top = np.argsort(-keys, kind="stable")[:many]
                    best[i] = keys[top], held[top]
            for i, (keys, held) in enumerate(best):
                if len(keys):
                    n = len(keys)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i] * n, pa.int32()), pa.array(keys), arrow.vectors(held), pa.array([TaskContext.get().partitionId() % 64] * n, pa.int32())],
                        names=["init", "key", "vec", "task"],
                    )

        top = lambda *by: F.row_number().over(Window.partitionBy("init", *by).orderBy(F.desc("key"), "vec"))
        won = rows.mapInArrow(draw, schema).withColumn("rank", top("task")).where(F.col("rank") <= many)
        for r in won.withColumn("rank", top()).where(F.col("rank") <= many).select("init", "vec").collect():
            drawn[r["init"]] = np.vstack([drawn[r["init"]], np.array(r["vec"])])
    drawn = [np.unique(s, axis=0) for s in drawn]

    def near(batches):
        sums = [np.zeros(len(c)) for c in drawn]
        for b in batches:
            if b.num_rows:
                x = arrow.matrix(b.column("vec"))
                for i, c in enumerate(drawn):
                    sums[i] += np.bincount(_assign(x, c)[0], minlength=len(c))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(drawn)), pa.int32()), pa.array([s.tolist() for s in sums], pa.list_(pa.float64()))], names=["init", "n"])

    weights = sum_partials(rows.mapInArrow(near, "init int, n array<double>"), ["init"], "n")
    starts = []
    for i, c in enumerate(drawn):
        rng, w = np.random.default_rng([seed, i]), weights[(i,)]
        picked = [rng.choice(len(c), p=w / w.sum())]
        while len(picked) < k:
            p = w * arrow.distances(c, c[picked]).min(axis=1) ** 2
            p = p if p.sum() > 0 else w
            picked.append(rng.choice(len(c), p=p / p.sum()))
        starts.append(c[picked])
    return starts


def _assign(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = arrow.distances(x, centres)
    label = d.argmin(axis=1)
    return label, d[np.arange(len(x)), label]


def lloyd(df: DataFrame, vector: str, starts: Mapping, max_iters: int = 100, tol: float = 1e-4) -> dict:
    """Lloyd iterations from each start until the centres move less than ``tol``.

    Returns ``{name: (centres, inertia, iterations)}``. Every iteration is one
    scan for all starts; tasks emit one partial sum per cluster, which Spark
    adds up, so the driver sees one row per cluster. A cluster that loses all
    rows keeps its centre.
    """
    with held(df, F.col(vector).alias("vec")) as points:
        return _lloyd(points, starts, max_iters, tol)


def _lloyd(points: DataFrame, starts: Mapping, max_iters: int, tol: float) -> dict:
    schema = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("c", T.IntegerType()), T.StructField("sums", T.ArrayType(T.DoubleType()))])
    names = list(starts)
    centres = [np.array(starts[n], dtype=float) for n in names]

    def scan(active: list[int]) -> dict:
        """Per start and cluster: rows, squared error, sum of the vectors."""
        held = [(i, centres[i]) for i in active]

        def partial(batches):
            sums = {i: np.zeros((len(c), c.shape[1] + 2)) for i, c in held}
            for b in batches:
                if not b.num_rows:
                    continue
                x = arrow.matrix(b.column("vec"))
                for i, c in held:
                    label, d = _assign(x, c)
                    hot = np.zeros((len(c), len(x)))
                    hot[label, np.arange(len(x))] = 1.0
                    sums[i][:, 0] += hot.sum(axis=1)
                    sums[i][:, 1] += hot @ (d * d)
                    sums[i][:, 2:] += hot @ x
            live = [(i, k) for i, s in sums.items() for k in np.nonzero(s[:, 0])[0]]
            if live:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _ in live], pa.int32()), pa.array([k for _, k in live], pa.int32()), arrow.vectors(np.array([sums[i][k] for i, k in live]))],
                    names=["start", "c", "sums"],
                )

        return sum_partials(points.mapInArrow(partial, schema), ["start", "c"], "sums")

    active, iters = list(range(len(names))), [0] * len(names)
    for _ in range(max_iters):
        if not active:
            break
        moved = {i: centres[i].copy() for i in active}
        for (i, c), sums in scan(active).items():
            moved[i][c] = sums[2:] / sums[0]
        still = []
        for i in active:
            shift = np.linalg.norm(moved[i] - centres[i])
            centres[i] = moved[i]
            iters[i] += 1
            if shift >= tol:
                still.append(i)
        active = still
    inertia = [0.0] * len(names)
    for (i, _), sums in scan(list(range(len(names)))).items():
        inertia[i] += float(sums[1])
    return {n: (centres[i], inertia[i], iters[i]) for i, n in enumerate(names)}


STARTS = {"k-means++": plus_plus_rows, "k-means||": parallel_rows}


def kmeans(df: DataFrame, id_col: str, vector: str, k: int = 5, max_iters: int = 100, tol: float = 1e-4, n_init: int = 10, seed: int = 42, init: str = "random", engine: str = "lloyd"):
    """Best of ``n_init`` runs by inertia: ``(centres, inertia)``."""
    if engine == "mllib":
        return _mllib(df, vector, k, max_iters, tol, n_init, seed)
    with held(df, id_col, vector) as rows:
        if init == "random":
            starts = random_rows(rows, id_col, vector, [k] * n_init, seed)
        else:
            starts = STARTS[init](rows, id_col, vector, k, n_init, seed)
        runs = lloyd(rows, vector, dict(enumerate(starts)), max_iters, tol)
    centres, inertia, _ = min(runs.values(), key=lambda r: r[1])
    return centres, inertia


def _mllib(df, vector, k, max_iters, tol, n_init, seed):
    from pyspark.ml.clustering import KMeans

    points = df.select(array_to_vector(F.col(vector)).alias("features")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        models = [
            KMeans(k=k, initMode="random", maxIter=max_iters, tol=tol, seed=seed + i).fit(points) for i in range(n_init)
        ]
        best = min(models, key=lambda m: m.summary.trainingCost)
        return np.array(best.clusterCenters()), best.summary.trainingCost
    finally:
        points.unpersist()


def point_to_centroid(df: DataFrame, vector: str, centres: np.ndarray, label: str = "cluster_id", distance: str = "distance") -> DataFrame:
    """Nearest centre (ties to the lower number) and its distance, one product per batch.

    ``centres`` travel with the task: a fixed number of vectors chosen by the
    caller, not data.
    """
    centres = np.asarray(centres, dtype=float)
    base = df.drop(label, distance)

    def run(batches):
        for b in batches:
            x = arrow.matrix(b.column(vector)) if b.num_rows else np.zeros((0, centres.shape[1]))
            lab, d = _assign(x, centres)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lab, pa.int32()), pa.array(d)], names=[*b.schema.names, label, distance])

    return base.mapInArrow(run, T.StructType(base.schema.fields + [T.StructField(label, T.IntegerType()), T.StructField(distance, T.DoubleType())]))


def kmeans_confidence(assigned: DataFrame, label: str = "cluster_id", distance: str = "distance", out: str = "confidence") -> DataFrame:
    """``1 - d / max d`` within the cluster; 1 for singletons and zero spread.

    The maximum per cluster comes from a combined aggregate (one row per
    cluster) that is joined back, not from a window that would pull a whole
    cluster into one task.
    """
    top = assigned.groupBy(label).agg(F.max(distance).alias("_max"), F.count("*").alias("_n"))
    value = F.when((F.col("_n") > 1) & (F.col("_max") > 0), 1.0 - F.col(distance) / F.col("_max")).otherwise(1.0)
    return assigned.join(top, label).withColumn(out, value).drop("_max", "_n")


def kmeans_many(df: DataFrame, id_col: str, vector: str, ks: Sequence[int], max_iters: int = 100, tol: float = 1e-4, n_init: int = 10, seed: int = 42) -> dict[int, np.ndarray]:
    """Best centres for every k from k-means|| starts.

    A draw of the largest k holds a valid draw of every smaller one as its
    first rows, so all k share the drawing scans and the iterations.
    """
    with held(df, id_col, vector) as rows:
        starts = parallel_rows(rows, id_col, vector, max(ks), n_init, seed)
        runs = lloyd(rows, vector, {(k, i): s[:k] for k in ks for i, s in enumerate(starts)}, max_iters, tol)
    return {k: min((runs[(k, i)] for i in range(n_init)), key=lambda r: r[1])[0] for k in ks}


def kmeans_assign(df: DataFrame, id_col: str, vector: str, centres: np.ndarray) -> DataFrame:
    """Result rows: ``(song_id, algorithm, kmeans_cluster_id, kmeans_distance, confidence)``."""
    near = point_to_centroid(df.select(F.col(id_col).alias("song_id"), vector), vector, centres)
    return kmeans_confidence(near).select(
        "song_id", F.lit("kmeans").alias("algorithm"), F.col("cluster_id").alias("kmeans_cluster_id"),
        F.col("distance").alias("kmeans_distance"), "confidence",
    )


def kmeans_elbow(df: DataFrame, id_col: str, vector: str, ks: Sequence[int] = range(2, 16), n_init: int = 10, max_iters: int = 100, tol: float = 1e-4, seed: int = 42) -> DataFrame:
    """``(k, inertia)``: every k and restart advances in the same scans."""
    ks = list(ks)
    plan = [(k, i) for k in ks for i in range(n_init)]
    starts = random_rows(df, id_col, vector, [k for k, _ in plan], seed)
    runs = lloyd(df, vector, dict(zip(plan, starts)), max_iters, tol)
    best = [(k, float(min(runs[(k, i)][1] for i in range(n_init)))) for k in ks]
    return df.sparkSession.createDataFrame(best, "k int, inertia double")
