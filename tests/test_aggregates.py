import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.operators import aggregates as A
from vecloom.operators import catalog as C
from vecloom.operators import matrix as X
from vecloom.operators import quality as Q
from vecloom.operators import segments as S
from vecloom.sources.sinks import update_by_key


def test_owner_mean_batch_and_online(spark):
    rows = []
    for owner, n, valid in (("four", 4, 4), ("five", 5, 5), ("six", 6, 6), ("gap", 5, 4), ("none", 5, 0)):
        rows += [(owner, [float(i), 1.0] if i < valid else None) for i in range(n)]
    df = spark.createDataFrame(rows, "artist_id string, feature_vector array<double>")
    batch = {r["artist_id"]: r["mean_vector"] for r in A.artist_mean_vector(df).collect()}
    assert set(batch) == {"five", "six", "gap"} and batch["gap"] == [1.5, 1.0]
    assert {r["artist_id"] for r in A.artist_mean_vector(df, min_valid=5).collect()} == {"five", "six"}


@pytest.mark.parametrize("sketch", [8, 40, 4096])
def test_exact_percentiles(spark, sketch):
    rng = np.random.default_rng(1)
    data = {
        0: rng.normal(size=400), 1: np.repeat([1.0, 2.0], 200), 2: np.full(400, 7.0),
        3: np.concatenate([np.zeros(200), rng.normal(size=200)]), 4: np.concatenate([[1e300, -1e300], rng.exponential(size=398)]),
    }
    df = spark.createDataFrame([(k, float(x)) for k, xs in data.items() for x in xs], "k int, x double").repartition(3)
    probs = [0.0, 0.25, 0.5, 0.9, 0.95, 1.0]
    got = A.exact_percentiles(df, "k", "x", probs, sketch=sketch).collect()
    assert len(got) == len(data) * len(probs)
    for r in got:
        assert r["value"] == pytest.approx(np.percentile(data[r["k"]], r["prob"] * 100), rel=1e-12, abs=1e-12)


def test_percentiles_read_the_rows_twice(spark):
    """Whatever the number of keys and rows: once for the sketches, once for counts and the rows inside the brackets."""
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        reads.add(1)
        yield from batches

    data = spark.range(60_000).selectExpr("CAST(id % 3 AS STRING) AS k", "CAST(pmod(xxhash64(id), 1000003) AS DOUBLE) AS x").repartition(1)
    got = A.exact_percentiles(data.mapInPandas(seen, "k string, x double"), "k", "x", [0.25, 0.5, 0.99]).collect()
    assert reads.value == 2
    values = {}
    for r in data.collect():
        values.setdefault(r["k"], []).append(r["x"])
    assert all(r["value"] == pytest.approx(np.percentile(values[r["k"]], r["prob"] * 100), rel=1e-12) for r in got) and len(got) == 9


def test_nan_and_null_do_not_count(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), ("a", 3.0), ("b", None), ("c", float("inf"))], "k string, x double")
    got = {(r["k"], r["prob"]): r["value"] for r in A.exact_percentiles(df, "k", "x", [0.5]).collect()}
    assert got["a", 0.5] == 2.0 and ("b", 0.5) not in got


def test_percentiles_of_nothing(spark):
    assert A.exact_percentiles(spark.createDataFrame([], "k int, x double"), "k", "x", [0.5]).count() == 0


def test_scalers_on_constant_and_outlier_columns(spark):
    x = np.array([[1.0, 5.0, 0.1], [2.0, 5.0, 0.1], [3.0, 5.0, 0.1], [4.0, 5.0, 0.1], [100.0, 6.0, 0.1]])
    df = spark.createDataFrame([([float(v) for v in r],) for r in x], "v array<double>")
    get = lambda m: np.array([r[0] for r in X.scale(df, "v", m).collect()])
    assert np.allclose(get("standard")[:, 0], (x[:, 0] - x[:, 0].mean()) / x[:, 0].std()) and np.allclose(get("standard")[:, 2], 0)
    assert np.allclose(get("robust")[:, 0], (x[:, 0] - 3) / 2) and np.allclose(get("robust")[:, 1], x[:, 1] - 5) and np.allclose(get("robust")[:, 2], 0)
    assert np.allclose(get("minmax")[:, 1], [-2, -2, -2, -2, 2]) and np.allclose(get("minmax")[:, 2], -2)


def test_pca_matches_eigenvectors(spark, points, blobs):
    out, load, explained = X.pca(points, "v", k=2)
    c = blobs - blobs.mean(0)
    values, axes = np.linalg.eigh(c.T @ c)
    axes = axes[:, ::-1][:, :2]
    axes = axes * np.sign(axes[abs(axes).argmax(0), range(2)])
    assert np.allclose(load, axes) and np.allclose(explained, values[::-1][:2] / values.sum())
    got = np.array([r["reduced"] for r in out.orderBy("id").collect()])
    assert np.allclose(got, c @ axes)
    assert X.pca(points, "v", variance=0.5)[1].shape[1] == 1


def test_pca_2d_without_variance(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)] * 4, "v array<double>")
    assert [list(r["xy"]) for r in X.pca_2d(df, "v").collect()] == [[0.0, 0.0]] * 4


def test_quality_report_counts_missing(spark):
    df = spark.createDataFrame([([1.0, float("nan")],), ([3.0, None],)], "v array<double>")
    r = A.data_quality(df, "v").head()
    assert (r["total_features"], r["total_rows"], r["total_missing"], r["matrix_mean"]) == (2, 2, 2, 2.0)


def test_segments_of_short_and_long_signals(spark):
    rows = [(name, t / 2) for name, end in (("short", 0.5), ("nine", 9), ("ten", 10), ("long", 25)) for t in range(int(end * 2) + 1)]
    out = S.assign_segments(spark.createDataFrame(rows, "s string, t double"), "s", "t", 10.0)
    got = {r["s"]: (r["n"], r["segs"]) for r in out.groupBy("s").agg(F.max("n_segments").alias("n"), F.collect_set("segment").alias("segs")).collect()}
    assert got["short"] == (1, [0]) and got["nine"] == (1, [0]) and got["ten"] == (1, [0])
    assert got["long"][0] == 2 and sorted(got["long"][1]) == [0, 1]


def test_energy_of_a_segment_over_many_slices(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=900)
    df = spark.createDataFrame([("s", 0, i, float(v)) for i, v in enumerate(x)] + [("t", 0, 0, 2.0)], "s string, g int, t int, x double").repartition(5)
    got = {r["s"]: r for r in S.segment_energy(df, "s", "g", ["t"], "x").collect()}
    flips = int((np.diff((x < 0).astype(int)) != 0).sum())
    assert got["s"]["n_samples"] == 900 and got["s"]["zero_crossing_rate"] == pytest.approx(flips / 900) and got["s"]["rms"] == pytest.approx(np.sqrt((x * x).mean()))
    assert (got["t"]["rms"], got["t"]["zero_crossing_rate"]) == (2.0, 0.0)


def test_item_without_kept_segment_is_rejected(spark):
    emb = F.array_repeat(F.lit(0.5), 128)
    coef = F.array_repeat(F.lit(1.0), 13)
    scalars = ["bpm", "chroma_stft", "spectral_centroid", "spectral_bandwidth", "rolloff", "zero_crossing_rate", "onset_env_mean", "onset_count", "loudness_mean", "loudness_std", "loudness_max", "loudness_min"]
    seg = spark.createDataFrame([("a", 0.5), ("a", 0.7), ("b", 0.001)], "song string, rms double")
    seg = seg.select("*", *[F.lit(2.0).alias(c) for c in scalars], coef.alias("mfcc_mean"), coef.alias("mfcc_std"), emb.alias("vggish_emb"))
    items = spark.createDataFrame([("a", 20.0, 2, 100.0), ("b", 12.0, 1, 90.0)], "song string, duration_sec double, segments int, global_bpm double")
    kept, bad = S.song_features(seg, items, "song")
    f = kept.head()["audio_features"]
    assert kept.count() == 1 and f["rms"]["mean"] == pytest.approx(0.6) and f["rms"]["std"] == pytest.approx(0.1) and len(f["vggish_emb"]) == 128
    assert [tuple(r) for r in bad.collect()] == [("b", "no segment kept")]
    pooled = S.mean_pool(seg.filter("rms > 0.01"), "song", "vggish_emb", items=items)
    assert {r["song"]: r["pooled"][0] for r in pooled.collect()} == {"a": 0.5, "b": 0.0}


def test_wide_segments_are_dealt_by_their_own_size(spark):
    scalars = ["bpm", "chroma_stft", "spectral_centroid", "spectral_bandwidth", "rolloff", "zero_crossing_rate", "rms", "onset_env_mean", "onset_count", "loudness_mean", "loudness_std", "loudness_max", "loudness_min"]
    # One task makes all segments; item 0 has nine in ten of them.
    rows = spark.range(0, 3000, 1, 1).select(F.when(F.col("id") % 10 < 9, 0).otherwise(F.col("id") % 7 + 1).alias("song"), (F.col("id") + 1.0).alias("x"))
    seg = rows.repartition(1, "song").select(
        "song", *[F.col("x").alias(c) for c in scalars], *[F.array_repeat("x", 13).alias(c) for c in ("mfcc_mean", "mfcc_std")], F.array_repeat("x", 128).alias("vggish_emb"),
    )
    items = spark.range(8).select(F.col("id").alias("song"), F.lit(20.0).alias("duration_sec"), F.lit(2).alias("segments"), F.lit(100.0).alias("global_bpm"))
    want = {r["song"]: r for r in rows.groupBy("song").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std")).collect()}
    kept, bad = S.song_features(seg, items, "song")
    got = {r["song"]: r["audio_features"] for r in kept.collect()}
    assert got.keys() == want.keys() and not bad.count()
    for song, f in got.items():
        assert f["rms"]["std"] == pytest.approx(want[song]["std"]) and f["mfcc_std"][12]["std"] == pytest.approx(want[song]["std"])
        assert f["vggish_emb"][127] == pytest.approx(want[song]["mean"])
    # Before, the task that made them also sorted them: grouping by the item asked for no exchange.
    for grouped in (kept, S.mean_pool(seg, "song", "vggish_emb", items=items), S.segment_stats_vec(seg, "song", "mfcc_mean")):
        assert "REBALANCE_PARTITIONS_BY_COL" in grouped._jdf.queryExecution().executedPlan().toString()


def test_featurizer_sees_whole_segments_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame([(s, g, float(i)) for s in range(3) for g in range(2) for i in range(20)], "s int, g int, t double").withColumn("x", F.col("t"))
        good, bad = S.segment_featurize(df, "s", "g", "x", "t", lambda v: {"bpm": float(len(v)), "rolloff": float(v[-1] - v[0])})
        assert sorted((r["s"], r["g"], r["bpm"], r["rolloff"]) for r in good.collect()) == [(s, g, 20.0, 19.0) for s in range(3) for g in range(2)]
        assert bad.count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_global_rank_is_dense_within_groups(spark):
    df = spark.createDataFrame([(i % 2, (i * 37) % 101) for i in range(101)], "g int, x int").repartition(5)
    got = C.global_rank(df, ["x"], ["g"]).collect()
    for g in (0, 1):
        mine = sorted((r["x"], r["rank"]) for r in got if r["g"] == g)
        assert [k for _, k in mine] == list(range(1, len(mine) + 1))


def test_sample_does_not_depend_on_partitions(spark):
    df = spark.range(500)
    a = {r["id"] for r in C.sample_n(df.repartition(2), "id", 50).collect()}
    assert len(a) == 50 and a == {r["id"] for r in C.sample_n(df.repartition(9), "id", 50).collect()}


def test_update_by_key_keeps_the_rest(spark):
    t = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, x double")
    u = spark.createDataFrame([("a", 5.0), ("z", 9.0)], "k string, x double")
    assert sorted(tuple(r) for r in update_by_key(t, u, "k", "x").collect()) == [("a", 5.0), ("b", 2.0)]


@pytest.mark.parametrize("sizes,balance", [((5458, 2505), 0.729), ((3117, 2505, 2341), 0.888)])
def test_published_balance(spark, sizes, balance):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "c int, n int").select("c", F.explode(F.sequence(F.lit(1), "n")))
    assert Q.cluster_size_metrics(df, "c").head()["balance_score"] == pytest.approx(balance, abs=5e-4)
