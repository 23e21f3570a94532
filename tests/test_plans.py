import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom import session as scratch
from vecloom.functions import vectors as V
from vecloom.plans import cluster, evaluate, ingest, prepare
from vecloom.streaming.ingest import insert_new_files, stored


@pytest.fixture(scope="module")
def songs(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 1, (30, 64)), rng.normal(6, 1, (30, 64))])
    rows = [(i, [float(e) for e in p]) for i, p in enumerate(x)] + [(100, [1.0]), (101, None), (102, [float("nan")] * 64)]
    return spark.createDataFrame(rows, "song_id bigint, feature_vector array<double>").cache()


def test_scratch_is_the_session_folder(spark):
    assert scratch.scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    snap = scratch.snapshot(spark.range(5))
    assert snap.count() == 5 and spark.conf.get("spark.checkpoint.dir") in snap.inputFiles()[0]


def test_prepare(songs):
    p = prepare.prepare(songs, groups=V.GROUPS_64, dim=64)
    assert p.df.count() == 60 and {r["reason"] for r in p.rejects.collect()} == {"wrong length", "missing vector", "non-finite value"}
    assert len(p.df.head()["reduced"]) == 32 and p.components.shape == (64, 32) and sum(p.explained) <= 1 + 1e-9
    as_text = songs.withColumn("feature_vector", V.vector_to_json("feature_vector", None))
    assert prepare.prepare(as_text, groups=V.GROUPS_64, dim=64).df.count() == 60


def test_cluster_all_stores_and_isolates(spark, songs):
    good = songs.filter("song_id < 100")
    options = {"gmm": {"k": 2, "max_iters": 5, "n_init": 1}, "kmeans": {"k": 2, "n_init": 2}, "hierarchical": {"linkage": "nonsense"}, "dbscan": {"eps": 11.0, "min_samples": 3}}
    state, failures = cluster.cluster_all(good, "song_id", "feature_vector", options=options)
    counts = {r["algorithm"]: r["count"] for r in state.groupBy("algorithm").count().collect()}
    assert counts == {"kmeans": 60, "gmm": 60, "dbscan": 60} and set(failures) == {"hierarchical"}
    state = scratch.snapshot(state)
    done = evaluate.evaluate_and_store(good, state, "kmeans")
    r = done.filter("algorithm = 'kmeans'").head()
    assert r["kmeans_cluster_size"] == 30 and r["kmeans_silhouette_score"] > 0.5
    # A second run keeps what the evaluation wrote.
    done = scratch.snapshot(done)
    again, _ = cluster.cluster_all(good, "song_id", "feature_vector", target=done, algorithms=["kmeans"], options=options)
    assert again.count() == 180 and again.filter("kmeans_cluster_size = 30").count() == 60
    tidy = cluster.tidy_clusters(state)
    assert tidy.filter("cluster_id IS NULL").count() == 0 and tidy.filter("algorithm = 'gmm'").head()["probs"]


@pytest.mark.parametrize("algorithm,column", [("gmm", "gmm_silhouette_score"), ("hierarchical", "hier_balance_score"), ("dbscan", "dbscan_n_noise")])
def test_evaluate_the_other_tables(spark, songs, algorithm, column):
    label = evaluate.STORED[algorithm][0]
    good = songs.filter("song_id < 100")
    rows = good.select("song_id", F.lit(algorithm).alias("algorithm"), F.when(F.col("song_id") == 0, -1).otherwise((F.col("song_id") / 30).cast("int")).alias(label))
    state = cluster.empty_clusters(spark, "bigint").unionByName(rows, allowMissingColumns=True)
    out = evaluate.evaluate_and_store(good, state, algorithm)
    assert out.count() == 60 and out.filter(F.col(column).isNull()).count() == 0


def test_ingest_is_incremental(spark):
    source = spark.createDataFrame([(s, "x") for s in "abcd"], "song_id string, artist_id string")
    done = spark.createDataFrame([("a",)], "song_id string")
    items = spark.createDataFrame([("a", 30.0, 3, 1.0), ("b", 30.0, 3, 1.0), ("c", 901.0, 90, 1.0), ("d", 30.0, 3, 1.0)], "song_id string, duration_sec double, segments int, global_bpm double")
    names = ["bpm", "chroma_stft", "spectral_centroid", "spectral_bandwidth", "rolloff", "zero_crossing_rate", "onset_env_mean", "onset_count", "loudness_mean", "loudness_std", "loudness_max", "loudness_min"]
    seg = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("b", 0.6), ("c", 0.5), ("d", 0.0)], "song_id string, rms double").select(
        "*", *[F.lit(1.0).alias(n) for n in names], *[F.array_repeat(F.lit(1.0), 13).alias(n) for n in ("mfcc_mean", "mfcc_std")], F.array_repeat(F.lit(0.1), 128).alias("vggish_emb")
    )
    got = ingest.ingest(source, done, items, seg)
    assert [(r["song_id"], len(r["feature_vector"])) for r in got.rows.collect()] == [("b", 223)]
    assert {r["song_id"]: r["reason"] for r in got.rejects.collect()} == {"c": "too long", "d": "no segment kept"}
    s = got.summary.head()
    assert (s["total"], s["processed"], s["todo"], s["percent_done"]) == (4, 1, 3, 25.0)


def test_owner_refresh_needs_five_valid(spark):
    artists = spark.createDataFrame([("x", [9.0]), ("y", [9.0])], "artist_id string, feature_vector array<double>")
    rows = [("x", [float(i)]) for i in range(5)] + [("y", [1.0] if i else None) for i in range(5)]
    out = ingest.refresh_owner_vectors(artists, spark.createDataFrame(rows, "artist_id string, feature_vector array<double>"))
    assert {r["artist_id"]: r["feature_vector"] for r in out.collect()} == {"x": [2.0], "y": [9.0]}


def test_stream_inserts_each_key_once(spark, tmp_path):
    kind = "k string, v int"
    src, dst, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = spark.createDataFrame([], kind).schema
    assert stored(spark, dst, schema).count() == 0
    for rows in ([("a", 2), ("a", 1), ("b", 1)], [("b", 9), ("c", 1)]):
        spark.createDataFrame(rows, kind).write.mode("append").parquet(src)
        insert_new_files(spark, src, dst, mark, schema, ["k"], ["v"])
    insert_new_files(spark, src, dst, mark, schema, ["k"], ["v"])
    assert sorted(tuple(r) for r in stored(spark, dst, schema).collect()) == [("a", 1), ("b", 1), ("c", 1)]
