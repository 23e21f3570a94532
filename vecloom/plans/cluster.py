"""Run the algorithms, keep failures apart, and store the results."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom import schemas
from vecloom.operators import agglomerative, dbscan, density, gmm, kmeans
from vecloom.operators.catalog import union_results
from vecloom.session import snapshot
from vecloom.sources.sinks import upsert


def result_rows(df: DataFrame, id_type: str = "string") -> DataFrame:
    """Results widened to the stored layout; columns of other algorithms are null."""
    have = set(df.columns)
    cols = [F.col("song_id").cast(id_type).alias("song_id"), "algorithm"]
    for name, kind in schemas.CLUSTER_RESULT_COLUMNS.items():
        cols.append((F.col(name) if name in have else F.lit(None)).cast(kind).alias(name))
    return df.select(*cols)


def empty_clusters(spark, id_type: str = "string") -> DataFrame:
    kinds = {"song_id": id_type, "algorithm": "string", **schemas.CLUSTER_RESULT_COLUMNS, **schemas.CLUSTER_METRIC_COLUMNS}
    return spark.createDataFrame([], ", ".join(f"{n} {k}" for n, k in kinds.items()))


def tidy_clusters(clusters: DataFrame) -> DataFrame:
    """One narrow layout for all algorithms."""
    label = F.coalesce("kmeans_cluster_id", "gmm_cluster_id", "hier_level2_id", "dbscan_cluster_id")
    params = F.map_filter(
        F.create_map(
            F.lit("eps"), F.col("eps"), F.lit("min_samples"), F.col("min_samples").cast("double"),
            F.lit("level1"), F.col("hier_level1_id").cast("double"),
        ),
        lambda _, v: v.isNotNull(),
    )
    return clusters.select(
        "song_id", "algorithm", label.alias("cluster_id"), F.coalesce("kmeans_distance", "hier_distance").alias("distance"),
        F.from_json("gmm_probabilities", "array<double>").alias("probs"), F.col("dbscan_is_core").alias("is_core"), "confidence", params.alias("params"),
    )


def steps(df: DataFrame, id_col: str, vector: str, options: dict | None = None, notes: dict[str, str] | None = None) -> dict[str, Callable[[], DataFrame]]:
    """The four algorithms with their usual settings; ``options`` override them.

    ``notes`` gets a line for each algorithm that ran with other settings than
    asked for.
    """
    opt = {name: dict((options or {}).get(name, {})) for name in schemas.ALGORITHMS}

    def run_kmeans():
        centres, _ = kmeans.kmeans(df, id_col, vector, **{"k": 5, **opt["kmeans"]})
        return kmeans.kmeans_assign(df, id_col, vector, centres)

    def run_gmm():
        model = gmm.gmm_em(df, id_col, vector, **{"k": 8, "seed": 42, **opt["gmm"]})
        return gmm.gmm_assign(df, id_col, vector, model)

    def run_hierarchical():
        return agglomerative.hier_assign(df, id_col, vector, **opt["hierarchical"])

    def run_dbscan():
        try:
            return snapshot(density.dbscan_assign(df, id_col, vector, **opt["dbscan"]), "dbscan")
        except Exception as exc:
            eps, least = dbscan.ALTERNATIVE
            if notes is not None:
                notes["dbscan"] = f"ran again with eps={eps}, min_samples={least} after {type(exc).__name__}: {exc}"
            return density.dbscan_assign(df, id_col, vector, eps, least, fallback=True)

    return {"kmeans": run_kmeans, "gmm": run_gmm, "hierarchical": run_hierarchical, "dbscan": run_dbscan}


def cluster_all(df: DataFrame, id_col: str, vector: str, target: DataFrame | None = None, algorithms: Sequence[str] = schemas.ALGORITHMS, options: dict | None = None) -> tuple[DataFrame, dict[str, str]]:
    """New state of the cluster table and the failures by algorithm.

    Every algorithm is stored to the scratch folder as it finishes, so that a
    failing one does not take the others down. A second try with other
    settings is among the failures too, although its rows are in the table.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    parts, failures = [], {}
    plan = steps(df, id_col, vector, options, failures)
    for name in algorithms:
        try:
            parts.append(snapshot(result_rows(plan[name](), id_type), name))
        except Exception as exc:
            failures[name] = f"{type(exc).__name__}: {exc}"
    target = target if target is not None else empty_clusters(df.sparkSession, id_type)
    if not parts:
        return target, failures
    return upsert(target, union_results(*parts), defaults={"created_at": F.current_timestamp()}), failures
