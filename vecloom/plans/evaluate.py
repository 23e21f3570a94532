"""Score stored clusters and write the metrics back to their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.operators import catalog, quality
from vecloom.session import snapshot
from vecloom.sources.sinks import update_by_group

# Per algorithm: label column, size column, silhouette column.
STORED = {
    "kmeans": ("kmeans_cluster_id", "kmeans_cluster_size", "kmeans_silhouette_score"),
    "gmm": ("gmm_cluster_id", "gmm_cluster_size", "gmm_silhouette_score"),
    "hierarchical": ("hier_level2_id", None, "hier_silhouette_score"),
    "dbscan": ("dbscan_cluster_id", "dbscan_cluster_size", "dbscan_silhouette_score"),
}


def label_metrics(songs: DataFrame, clusters: DataFrame, algorithm: str, vector: str = "feature_vector", key: str = "song_id", metric: str = "euclidean") -> DataFrame:
    """``(cluster, size, silhouette)``: size per cluster, silhouette of the whole.

    Vectors are used as stored in ``vector``; pass the reduced column to score
    the space that was clustered. Noise counts in the sizes only.
    """
    label = STORED[algorithm][0]
    joined = snapshot(
        catalog.songs_with_clusters(songs.select(key, vector), clusters.select(key, "algorithm", label), algorithm, key, label)
        .filter(F.col(vector).isNotNull()),
        "joined",
    )
    sizes = quality.cluster_sizes(joined, label).select(F.col(label).alias("cluster"), "size")
    scored = joined.filter(F.col(label) != -1)
    value = quality.silhouette(scored, key, vector, label, metric).head()
    s = value["silhouette"] if value else None
    s = None if s is None or s != s else float(s)
    return sizes.withColumn("silhouette", F.lit(s).cast("double"))


def evaluate_and_store(songs: DataFrame, clusters: DataFrame, algorithm: str, vector: str = "feature_vector", key: str = "song_id", metric: str = "euclidean") -> DataFrame:
    """The cluster table with sizes and silhouette filled in for one algorithm."""
    label, size, score = STORED[algorithm]
    metrics = label_metrics(songs, clusters, algorithm, vector, key, metric)
    cols = {"cluster": F.col("cluster").alias(label), "silhouette": F.col("silhouette").alias(score)}
    columns = [score]
    if size:
        cols["size"] = F.col("size").alias(size)
        columns.insert(0, size)
    if algorithm == "hierarchical":
        sizes = metrics.agg(F.try_divide(F.stddev_pop("size"), F.avg("size")).alias("cv")).head()
        cols["balance"] = F.lit(1.0 / (1.0 + sizes["cv"]) if sizes and sizes["cv"] is not None else None).cast("double").alias("hier_balance_score")
        columns.append("hier_balance_score")
    if algorithm == "dbscan":
        facts = metrics.agg(F.count_if(F.col("cluster") != -1).alias("k"), F.sum(F.when(F.col("cluster") == -1, F.col("size"))).alias("n")).head()
        cols["k"] = F.lit(facts["k"]).cast("bigint").alias("dbscan_n_clusters")
        cols["n"] = F.lit(facts["n"] or 0).cast("bigint").alias("dbscan_n_noise")
        columns += ["dbscan_n_clusters", "dbscan_n_noise"]
    return update_by_group(clusters, metrics.select(*cols.values()), label, columns, F.col("algorithm") == algorithm)
