"""Choosing density parameters, and density results as table rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vecloom.functions import scores
from vecloom.operators import dbscan as D
from vecloom.operators.aggregates import exact_percentiles
from vecloom.operators.catalog import global_rank, sample_n
from vecloom.operators.quality import mean_silhouette, silhouette_many
from vecloom.operators.tiles import TILE_ROWS, knn_join
from vecloom.session import snapshot

# The neighbour counts whose curves are analysed.
MIN_SAMPLES = (3, 4, 5, 6, 8, 10)


def k_distances(df: DataFrame, id_col: str, vector: str, min_samples: Sequence[int] = MIN_SAMPLES, max_points: int | None = None, seed: int = 42, skip_zero: bool = False, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``(min_samples, id, k_distance)``: distance to the (m-1)-th nearest other row.

    One nearest-row pass serves all m. Rows with fewer neighbours have no
    entry. ``skip_zero`` is the rule of the plotted curve.
    """
    rows = df if max_points is None else sample_n(df, id_col, max_points, seed)
    ms = sorted({int(m) for m in min_samples if m >= 2})
    near = knn_join(rows, id_col, vector, max(ms) - 1, skip_zero=skip_zero, tile_rows=tile_rows)
    wanted = F.explode(F.array(*[F.lit(m) for m in ms]))
    return (
        near.select("id", "distance", "rank", wanted.alias("min_samples"))
        .filter(F.col("rank") == F.col("min_samples") - 1)
        .select("min_samples", "id", F.col("distance").alias("k_distance"))
    )


def k_distance_curve(distances: DataFrame) -> DataFrame:
    """Adds ``position``, from 0, in descending order of distance."""
    ranked = global_rank(distances.withColumn("_neg", -F.col("k_distance")), ["_neg", "id"], ["min_samples"], "position")
    return ranked.withColumn("position", F.col("position") - 1).drop("_neg")


def knee(curve: DataFrame, least: int = 10) -> DataFrame:
    """``(min_samples, knee_position, knee)``: where the curve bends most.

    Neighbouring points of a curve meet in an equi-join on the position, so a
    long curve is not sorted into one task.
    """
    c = curve.select("min_samples", "position", F.col("k_distance").alias("d0"))
    one = curve.select("min_samples", (F.col("position") - 1).alias("position"), F.col("k_distance").alias("d1"))
    two = curve.select("min_samples", (F.col("position") - 2).alias("position"), F.col("k_distance").alias("d2"))
    bend = c.join(one, ["min_samples", "position"]).join(two, ["min_samples", "position"]).withColumn(
        "bend", F.abs((F.col("d2") - F.col("d1")) - (F.col("d1") - F.col("d0")))
    )
    # Two points fewer than the curve has; the knee is the last of the three.
    best = bend.groupBy("min_samples").agg(
        F.count("*").alias("n"), F.max_by(F.struct("position", "d2"), F.struct("bend", -F.col("position"))).alias("at")
    )
    return best.filter(F.col("n") + 2 > least).select(
        "min_samples", (F.col("at.position") + 2).alias("knee_position"), F.col("at.d2").alias("knee")
    )


def eps_suggestions(curve: DataFrame, keep: int = 3) -> DataFrame:
    """``(min_samples, p85, p90, p95, eps)`` with up to ``keep`` diverse radii."""
    q = exact_percentiles(curve, "min_samples", "k_distance", [0.85, 0.90, 0.95])
    wide = q.groupBy("min_samples").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(f"p{round(p * 100)}") for p in (0.85, 0.90, 0.95)]
    )
    spread = curve.groupBy("min_samples").agg((F.avg("k_distance") + 0.5 * F.stddev_pop("k_distance")).alias("wide"))
    joined = wide.join(spread, "min_samples").join(knee(curve).select("min_samples", "knee"), "min_samples", "left")
    candidates = F.filter(F.array("knee", "p85", "p90", "p95", "wide"), lambda x: x.isNotNull())
    return joined.select("min_samples", "p85", "p90", "p95", scores.eps_suggestions(candidates, keep).alias("eps"))


def dbscan_grid(df: DataFrame, id_col: str, vector: str, configs: Sequence[tuple[float, int]], metric: str = "euclidean", tile_rows: int = TILE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Every setting scored from shared pair passes.

    Returns ``(eps, min_samples, n_clusters, n_noise, noise_ratio,
    silhouette)`` and the cluster sizes ``(eps, min_samples, cluster_id,
    size)``; the latter stay rows, as a setting can have very many clusters.
    """
    configs = [(float(e), int(m)) for e, m in configs]
    labels = snapshot(D.dbscan_many(df, id_col, vector, configs, metric, tile_rows), "labels")
    table = df.sparkSession.createDataFrame([(i, e, m) for i, (e, m) in enumerate(configs)], "cfg int, eps double, min_samples int")
    info = D.density_info(labels, ["cfg"]).select("cfg", "n_clusters", "n_noise", "noise_ratio")
    real = labels.filter(F.col("cluster_id") != D.NOISE)
    sizes = real.groupBy("cfg", "cluster_id").agg(F.count("*").alias("size")).join(F.broadcast(table), "cfg")
    sil = mean_silhouette(silhouette_many(df, id_col, vector, real.select("cfg", "id", F.col("cluster_id").alias("label")), metric, tile_rows), ["cfg"])
    grid = (
        table.join(info, "cfg").join(sil.select("cfg", "silhouette"), "cfg", "left")
        .select(
            "eps", "min_samples", "n_clusters", "n_noise", "noise_ratio", F.coalesce("silhouette", F.lit(float("nan"))).alias("silhouette")
        )
    )
    return grid, sizes.select("eps", "min_samples", "cluster_id", "size")


def best_params(grid: DataFrame) -> DataFrame:
    """Best silhouette, and best with little noise and two or more clusters."""
    scored = grid.filter(~F.isnan("silhouette"))
    balanced = scored.filter((F.col("noise_ratio") < 0.3) & (F.col("n_clusters") > 1))

    def top(df, name):
        row = F.struct("eps", "min_samples", "n_clusters", "noise_ratio", "silhouette")
        best = df.agg(F.max_by(row, F.struct("silhouette", -F.col("eps"), -F.col("min_samples"))).alias("r"))
        return best.filter("r IS NOT NULL").select(F.lit(name).alias("criterion"), "r.*")

    return top(scored, "silhouette").union(top(balanced, "balanced"))


def recommend_params(grid: DataFrame, n: int = 3) -> DataFrame:
    good = grid.filter((F.col("n_clusters") >= 2) & (F.col("noise_ratio") <= 0.5) & ~F.isnan("silhouette"))
    return good.orderBy(F.desc("silhouette"), "min_samples", "eps").limit(n)


def top_configs(results: DataFrame, score: str = "composite", tiebreak: Sequence[str] = ("cfg",), n: int = 5) -> DataFrame:
    """The ``n`` best settings; ``rank`` 1 is the winner."""
    order = [F.desc(score), *tiebreak]
    top = results.orderBy(*order).limit(n)
    # Numbers at most n rows.
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def dbscan_assign(df: DataFrame, id_col: str, vector: str, eps: float = D.OPTIMAL[0], min_samples: int = D.OPTIMAL[1], fallback: bool = False, metric: str = "euclidean", tile_rows: int = TILE_ROWS) -> DataFrame:
    """Result rows: label, flags, sizes, silhouette of the whole, confidence.

    ``fallback`` uses the plain confidences and stores no silhouette.
    """
    labels = snapshot(D.dbscan(df, id_col, vector, eps, min_samples, metric, tile_rows), "labels")
    info = D.density_info(labels).head()
    silhouette = None
    if not fallback and info and info["n_clusters"] > 1:
        real = labels.filter(F.col("cluster_id") != D.NOISE).select(F.lit(0).alias("cfg"), "id", F.col("cluster_id").alias("label"))
        got = mean_silhouette(silhouette_many(df, id_col, vector, real, metric, tile_rows)).head()
        if got and got["silhouette"] == got["silhouette"]:
            silhouette = float(got["silhouette"])
    sizes = labels.groupBy("cluster_id").agg(F.count("*").alias("dbscan_cluster_size"))
    noise = F.col("cluster_id") == D.NOISE
    s = F.lit(silhouette).cast("double")
    plain = scores.dbscan_confidence_fallback(noise, F.col("is_core"))
    full = scores.dbscan_confidence(noise, F.col("is_core"), F.col("dbscan_cluster_size"), s)
    return labels.join(sizes, "cluster_id").select(
        F.col("id").alias("song_id"), F.lit("dbscan").alias("algorithm"), F.col("cluster_id").alias("dbscan_cluster_id"),
        F.col("is_core").alias("dbscan_is_core"), noise.alias("is_noise_point"), F.lit(float(eps)).alias("eps"),
        F.lit(int(min_samples)).alias("min_samples"), "dbscan_cluster_size", s.alias("dbscan_silhouette_score"),
        F.lit(int(info["n_clusters"]) if info else 0).cast("bigint").alias("dbscan_n_clusters"),
        F.lit(int(info["n_noise"]) if info else 0).cast("bigint").alias("dbscan_n_noise"),
        (plain if fallback else full).alias("confidence"), "is_seed",
    )
