import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import brute
from vecloom.operators import agglomerative as G
from vecloom.operators import gmm as M
from vecloom.operators import kmeans as K
from vecloom.operators import quality as Q
from vecloom.operators import tiles as T
from vecloom.session import CLEANUP, scratch_dir


@pytest.fixture(autouse=True)
def small_tiles(monkeypatch):
    monkeypatch.setattr(T, "PARTNERS", 3)
    monkeypatch.setattr(G, "ROWS_PER_GROUP", 8)


def test_lloyd_keeps_the_centre_of_an_empty_cluster(spark):
    df = spark.createDataFrame([([float(x)],) for x in (0, 1, 10, 11)], "v array<double>")
    centres, inertia, _ = K.lloyd(df, "v", {0: np.array([[0.0], [10.0], [500.0]])})[0]
    assert centres.ravel().tolist() == [0.5, 10.5, 500.0] and inertia == pytest.approx(1.0)


def test_parallel_start_scans_do_not_grow_with_k(spark, points, blobs, monkeypatch):
    frame, scans = type(points), []
    kept = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *a, **k: scans.append(1) or kept(self, *a, **k))
    for k in (3, 12):
        scans.clear()
        starts = K.parallel_rows(points, "id", "v", k, 2, 7)
        assert len(scans) == K.ROUNDS + 1
        assert [s.shape for s in starts] == [(k, 3)] * 2
        for s in starts:
            assert len(np.unique(s, axis=0)) == k and all((blobs == row).all(1).any() for row in s)


def test_parallel_start_with_few_distinct_rows(spark):
    df = spark.createDataFrame([(i, [float(i % 2)]) for i in range(9)], "id int, v array<double>")
    start = K.parallel_rows(df, "id", "v", 4, 1, 3)[0]
    assert start.shape == (4, 1) and set(start.ravel()) == {0.0, 1.0}
    assert K.kmeans(df, "id", "v", 4, n_init=2, init="k-means||")[1] == 0


def test_cache_is_shared_and_left(spark, points):
    plain = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "id int, v array<double>")
    with K.held(plain, "id", "v") as rows:
        with K.held(rows, "v") as again:
            assert again.storageLevel.useMemory is False and again.is_cached
        assert rows.storageLevel.useMemory
    assert not rows.storageLevel.useMemory


def test_kmeans_finds_blobs_and_confidence(spark, points, blobs):
    for init in ("random", "k-means++", "k-means||"):
        centres, inertia = K.kmeans(points, "id", "v", 3, n_init=5, init=init)
        d = brute.dist(blobs, centres)
        assert inertia == pytest.approx((d.min(1) ** 2).sum())
    rows = {r["song_id"]: r for r in K.kmeans_assign(points, "id", "v", centres).collect()}
    label = d.argmin(1)
    for i, r in rows.items():
        own = d[label == label[i], label[i]]
        assert r["confidence"] == pytest.approx(1 - d[i, label[i]] / own.max())
    lone = K.kmeans_assign(points.limit(1), "id", "v", centres).head()
    assert lone["confidence"] == 1.0


def test_elbow_falls(points):
    rows = K.kmeans_elbow(points, "id", "v", range(1, 5), n_init=3).orderBy("k").collect()
    assert [r["k"] for r in rows] == [1, 2, 3, 4] and all(a["inertia"] >= b["inertia"] for a, b in zip(rows, rows[1:]))


def test_em_matches_one_machine(points, blobs):
    start = blobs[[0, 45, 105]]
    means, r, ll, steps = brute.em(blobs, start, 25)
    model = M.gmm_em(points, "id", "v", 3, max_iters=25, start=start)
    assert model.log_likelihood == pytest.approx(ll) and np.allclose(model.means, means) and model.iterations == steps
    rows = M.responsibilities(points, "v", model).orderBy("id").collect()
    got = np.array([x["probabilities"] for x in rows])
    assert np.allclose(got, r, atol=1e-8) and np.allclose(got.sum(1), 1) and [x["cluster_id"] for x in rows] == list(r.argmax(1))
    out = M.gmm_assign(points, "id", "v", model).orderBy("song_id").head()
    assert out["confidence"] == pytest.approx(r[0].max())


def test_gmm_select_marks_the_best(points):
    rows = M.gmm_select(points, "id", "v", [1, 2, 3, 5000], max_iters=15).orderBy("k").collect()
    assert np.isnan(rows[-1]["log_likelihood"]) and sum(r["best_bic"] for r in rows) == 1 == sum(r["best_aic"] for r in rows)
    fitted = rows[:-1]
    assert min(fitted, key=lambda r: r["bic"])["best_bic"] and all(sum(r["sizes"]) == 110 for r in fitted)


TREES = [("single", "euclidean"), ("complete", "manhattan"), ("average", "euclidean"), ("ward", "euclidean"), ("average", "cosine")]


@pytest.mark.parametrize("tail", [6, 1000])
def test_trees_match_the_greedy_tree(spark, tail):
    x = np.random.default_rng(5).normal(size=(60, 4)) + 1
    df = spark.createDataFrame([(i * 3, [float(e) for e in p]) for i, p in enumerate(x)], "id int, v array<double>")
    rows = G.agglomerative_many(df, "id", "v", TREES, tail=tail, tile_rows=16).collect()
    for t, (linkage, metric) in enumerate(TREES):
        want = brute.tree(x, linkage, metric)
        got = sorted((r for r in rows if r["tree"] == t), key=lambda r: r["step"])
        order = sorted(want, key=lambda w: w[2])
        assert [r["height"] for r in got] == pytest.approx([w[2] for w in order])
        assert [r["size"] for r in got] == [w[3] for w in order]
        assert [(r["a"], r["b"]) for r in got] == [(3 * w[0], 3 * w[1]) for w in order]


def test_weighted_tree(spark):
    rng = np.random.default_rng(6)
    x, w = rng.normal(size=(30, 2)), rng.integers(1, 9, 30)
    df = spark.createDataFrame([(i, [float(e) for e in p], int(k)) for i, (p, k) in enumerate(zip(x, w))], "id int, v array<double>, w int")
    for linkage in ("ward", "average"):
        got = G.agglomerative(df, "id", "v", linkage, weight="w", tail=5, tile_rows=8).orderBy("step").collect()
        want = sorted(brute.tree(x, linkage, "euclidean", w), key=lambda m: m[2])
        assert [r["height"] for r in got] == pytest.approx([m[2] for m in want])


def test_ties_still_give_a_whole_tree(spark):
    df = spark.createDataFrame([(i, [float(i % 4), float(i // 4)]) for i in range(16)], "id int, v array<double>")
    every = G.agglomerative_many(df, "id", "v", [(l, "euclidean") for l in G.LINKAGES], tail=3, tile_rows=5).orderBy("step").collect()
    for t in range(len(G.LINKAGES)):
        rows = [r for r in every if r["tree"] == t]
        assert len(rows) == 15 and rows[-1]["size"] == 16
        assert all(a["height"] <= b["height"] for a, b in zip(rows, rows[1:]))


def test_cuts(spark):
    x = [0.0, 0.1, 5.0, 5.2, 9.0]
    df = spark.createDataFrame([(i + 10, [v]) for i, v in enumerate(x)], "id int, v array<double>")
    merges = G.agglomerative(df, "id", "v", "average")
    cut = lambda k: [(r["label"], round(r["merge_height"], 6)) for r in G.cut_levels(merges, df.select("id"), [k]).orderBy("id").collect()]
    assert cut(3) == [(0, 0.1), (0, 0.1), (1, 0.2), (1, 0.2), (2, 0.0)]
    assert [c for c, _ in cut(2)] == [0, 0, 1, 1, 1]
    assert [c for c, _ in cut(9)] == [0, 1, 2, 3, 4] and {c for c, _ in cut(1)} == {0}
    lone = df.limit(1)
    one = G.cut_tree(G.agglomerative(lone, "id", "v"), lone.select("id"), 2).collect()
    assert [tuple(r) for r in one] == [(10, 0)]


@pytest.mark.parametrize("mode,size", [("sample", 60), ("micro", 20)])
def test_large_mode_labels_every_row(points, blobs, mode, size):
    got = {r["id"]: r["label"] for r in G.hier_large(points, "id", "v", 3, "ward", mode=mode, size=size).collect()}
    assert len(got) == len(blobs) and set(got.values()) == {0, 1, 2}
    assert len({got[i] for i in range(40)}) == 1 and got[0] != got[50] != got[109]


def test_hier_assign_rules(points):
    shifted = points.withColumn("v", F.transform("v", lambda e: e + 12))
    rows = G.hier_assign(shifted, "id", "v").collect()
    assert len(rows) == 110 and {r["hier_level1_id"] for r in rows} == {0, 1} and {r["hier_level2_id"] for r in rows} == {0, 1, 2}
    assert all(0.1 <= r["confidence"] <= 1.0 and r["hier_distance"] > 0 for r in rows)
    large = G.hier_assign(shifted, "id", "v", mode="micro", size=20).collect()
    assert len(large) == 110 and {r["hier_level2_id"] for r in large} == {0, 1, 2}


def test_hier_select_scores_every_setting(points):
    rows = G.hier_select(points.withColumn("v", F.transform("v", lambda e: e + 12)), "id", "v", ks=[2, 3]).collect()
    assert len(rows) == 14 and all(sum(r["sizes"]) == 110 and len(r["sizes"]) == r["k"] for r in rows)
    assert all(r["composite"] == pytest.approx(0.4 * r["silhouette"] + 0.6 * r["balance"]) for r in rows)


def test_trees_store_no_matrix(spark):
    x = np.random.default_rng(8).normal(size=(1200, 3))
    df = spark.createDataFrame([(i, [float(e) for e in p]) for i, p in enumerate(x)], "id int, v array<double>")
    folder = scratch_dir(spark).removeprefix("file:")
    stored = lambda: sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)
    before = stored()
    assert G.agglomerative_many(df, "id", "v", [("average", "euclidean"), ("ward", "euclidean")], tail=2048).count() == 2 * 1199
    assert stored() - before < 1200 * 1200 * 8 / 4


def test_tiles_of_a_round_are_deleted(spark):
    """No round's tiles are left when a tree is done, and the tail takes no row for a pair."""
    x = np.random.default_rng(5).normal(size=(60, 4))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, v array<double>")
    before = set(os.listdir(scratch_dir(spark).removeprefix("file:")))
    trees = [("average", "cosine"), ("complete", "euclidean"), ("average", "manhattan")]
    assert G.agglomerative_many(df, "id", "v", trees, tail=6, tile_rows=9).count() == 3 * 59
    left = set(os.listdir(scratch_dir(spark).removeprefix("file:"))) - before
    assert not [name for name in left if name.startswith(("tiles-", "found-", "blocks-", "met-"))]


def test_stored_steps_leave_no_shuffle_files(spark):
    """What a tree shuffled is gone when it is done, and the setting is as before."""
    dirs = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    shuffled = lambda: {f for top in dirs for _, _, files in os.walk(top) for f in files if f.startswith("shuffle_")}
    x = np.random.default_rng(5).normal(size=(60, 4))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, v array<double>")
    setting, before = spark.conf.get(CLEANUP), shuffled()
    trees = [("average", "cosine"), ("complete", "euclidean")]
    merges = G.agglomerative_many(df, "id", "v", trees, tail=6, tile_rows=9)
    for _ in range(50):
        # Spark deletes them in the background.
        if len(left := shuffled() - before) <= 12:
            break
        time.sleep(0.2)
    # Numbering the rows and reading the weights are no stored steps.
    assert len(left) <= 12 and spark.conf.get(CLEANUP) == setting
    assert merges.count() == 2 * 59


def test_sums_finish_a_tree_as_its_pairs_do(spark):
    """Trees of sums send no statistics of pairs, and of a tile's own pairs each is sent once."""
    x = np.random.default_rng(9).normal(size=(40, 3))
    df = spark.createDataFrame([(i, [float(e) for e in p]) for i, p in enumerate(x)], "id int, v array<double>")
    asked = []
    inner = G._distances
    G._distances = lambda tiles, trees, every: asked.append((every, sorted(trees))) or inner(tiles, trees, every)
    try:
        trees = [("ward", "euclidean"), ("complete", "euclidean"), ("average", "cosine"), ("average", "manhattan"), ("average", "euclidean")]
        rows = G.agglomerative_many(df, "id", "v", trees, tail=12, tile_rows=7).collect()
    finally:
        G._distances = inner
    assert [t for every, t in asked if every] == [[1, 3], [4]]
    for t, (linkage, metric) in enumerate(trees):
        want = sorted(w[2] for w in brute.tree(x, linkage, metric))
        assert sorted(r["height"] for r in rows if r["tree"] == t) == pytest.approx(want)


def test_scores_keep_no_row_per_setting(points, spark):
    """Neither the rows of all settings nor the tiles of a silhouette are left."""
    names = lambda: set(os.listdir(scratch_dir(spark).removeprefix("file:")))
    before = names()
    labels = points.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("cfg"), "id", (F.col("id") % 3).alias("label"))
    assert Q.silhouette_many(points, "id", "v", labels).count() == 220
    assert not [n for n in names() - before if n.startswith("tiles-")]
    assert len(G.hier_select(points, "id", "v", ks=[2]).collect()) == 7
    assert not [n for n in names() - before if n.startswith("scored-")]


def test_only_merged_clusters_ask_again(spark, monkeypatch):
    """A cluster whose nearest one was merged goes on to the next one it knows of."""
    x = np.random.default_rng(11).normal(size=(300, 6))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, v array<double>")
    asked, inner = [], G._nearest
    monkeypatch.setattr(G, "_nearest", lambda tiles, trees: asked.append(trees[0].hot) or inner(tiles, trees))
    merges = G.agglomerative(df, "id", "v", "average", tail=100, tile_rows=5).collect()
    want = sorted(w[2] for w in brute.tree(x, "average", "euclidean"))
    assert sorted(r["height"] for r in merges) == pytest.approx(want)
    assert sum(asked) < 260


def test_single_linkage_meets_all_rows_once(spark, monkeypatch):
    """After the pass over all pairs only rows of components that know of no other one ask, those of the largest never."""
    x = np.random.default_rng(12).normal(size=(300, 3))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, v array<double>")
    passes, inner = [], G.run_tiles
    monkeypatch.setattr(G, "run_tiles", lambda tiles, *rest, **more: passes.append(tiles) or inner(tiles, *rest, **more))
    got = G.agglomerative(df, "id", "v", "single", tile_rows=50).collect()
    assert sorted(r["height"] for r in got) == pytest.approx(sorted(w[2] for w in brute.tree(x, "single", "euclidean")))
    assert len(passes) <= 3
