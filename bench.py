"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

HEADLINE = [
    "artist_mean_vector", "song_features", "flatten_features", "scale_standard", "scale_robust", "preprocess", "pca", "percentiles",
    "insert_ignore", "upsert", "skip_processed", "constraints", "eps_join", "knn_join", "k_distance", "lloyd", "kmeans", "gmm_em",
    "dbscan", "dbscan_grid", "agglomerative", "agglomerative_ward", "silhouette_samples", "calinski_harabasz", "davies_bouldin", "adjusted_rand",
]


def main() -> None:
    from vecloom.session import build_session
    from workload import registry

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    # One small run starts the JVM's compilers and the Python workers.
    registry.QUERIES["point_to_centroid"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    folder = os.path.basename(os.path.normpath(sf_dir))
    print(json.dumps({"metric": "total time of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(folder.removeprefix("sf") or 0)}))
    spark.stop()


if __name__ == "__main__":
    main()
