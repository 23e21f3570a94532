import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as St
from pyspark.sql.types import StructType

from tests import brute
from vecloom.functions import arrow
from vecloom.operators import cells as C
from vecloom.operators import components as P
from vecloom.operators import dbscan as D
from vecloom.operators import density as N
from vecloom.operators import quality as Q
from vecloom.operators import tiles as T


@pytest.fixture(autouse=True)
def small_tiles(monkeypatch):
    # Tests use tiles of a few rows, so that every job spans many of them, and cells of several levels.
    monkeypatch.setattr(T, "PARTNERS", 3)
    monkeypatch.setattr(C, "FAN", 4)
    monkeypatch.setattr(C, "GROUP", 64)


def test_only_large_cells_are_stored_again(spark, monkeypatch):
    # A dense half needs more levels than the rest, and forty rows are alike.
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 2, (200, 3)), rng.uniform(-9, 9, (160, 3)), np.full((40, 3), 12.0)])
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>").repartition(4)
    stored, snapshot = [], C.snapshot

    def counted(df, name="t"):
        out = snapshot(df, name)
        if name == "cells":
            stored.append(out.count())
        return out

    monkeypatch.setattr(C, "snapshot", counted)
    out, depth = C.split(rows, len(x), "euclidean", 16)
    got = {r["id"]: (r["code"], r["part"]) for r in out.collect()}
    # Before, each of the levels stored all rows again.
    assert depth == len(stored) > 2 and stored[0] == len(x) and all(b < a for a, b in zip(stored, stored[1:]))
    assert sorted(got) == list(range(len(x))) and out.count() == len(x)
    assert max(c for c, _ in got.values()) < 32**depth
    # Alike rows keep one cell down to the last level, cut into parts; no other cell says so.
    alike = {got[i][0] for i in range(360, 400)}
    assert len(alike) == 1 and alike.pop() % 32 == 31 and len({got[i] for i in range(360, 400)}) > 1
    assert all(got[i][0] % 32 != 31 for i in range(360))


@pytest.mark.parametrize("metric,eps", [("euclidean", 0.5), ("manhattan", 0.9), ("cosine", 0.01)])
@pytest.mark.parametrize("tile_rows", [7, 500])
def test_eps_join(points, blobs, metric, eps, tile_rows):
    x = blobs + 20 if metric == "cosine" else blobs
    df = points.withColumn("v", F.transform("v", lambda e: e + 20)) if metric == "cosine" else points
    d = brute.dist(x, x, metric)
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if d[i, j] <= eps}
    got = T.eps_join(df, "id", "v", eps, metric, collapse=False, tile_rows=tile_rows).collect()
    assert len(got) == len(want) and {(r["id_a"], r["id_b"]) for r in got} == want
    assert max(abs(r["distance"] - d[r["id_a"], r["id_b"]]) for r in got) < 1e-9


def test_copies_give_one_row(points, blobs):
    got = T.eps_join(points, "id", "v", 0.5, tile_rows=10).collect()
    d = brute.dist(blobs, blobs)
    total = sum(r["n_a"] * r["n_b"] if r["id_a"] != r["id_b"] else r["n_a"] * (r["n_a"] - 1) // 2 for r in got)
    assert total == int(np.triu(d <= 0.5, 1).sum())
    assert [(r["id_a"], r["n_a"]) for r in got if r["id_a"] == r["id_b"]] == [(0, 21)]


def test_far_tiles_are_not_visited(points):
    tiles = T.build_tiles(points, "id", "v", tile_rows=7, pivots=True)
    n = tiles.count()
    assert T.tile_pairs(tiles, 0.1).count() < n * (n + 1) / 2 == T.tile_pairs(tiles).count()


def given_clusters(spark, centres=40, each=60):
    """Tight clusters around the given vectors."""
    x = np.array([list(r[0]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").select("embedding").limit(centres).collect()], float)
    return np.repeat(x, each, axis=0) + np.random.default_rng(4).normal(0, 0.01, (len(x) * each, x.shape[1]))


def test_clustered_rows_visit_few_tile_pairs(spark):
    x = given_clusters(spark)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id int, v array<double>")
    tiles = T.build_tiles(df, "id", "v", tile_rows=64, pivots=True)
    n, depth = tiles.count(), tiles.first()["depth"]
    assert depth > 1 and tiles.agg(F.max("n")).first()[0] <= 64 and tiles.agg(F.sum("n")).first()[0] == len(x)
    assert T.tile_pairs(tiles, 0.3).count() < n * (n + 1) / 2 / 3
    got = T.eps_join(df, "id", "v", 0.2, collapse=False, tile_rows=64)
    d = brute.dist(x, x)
    assert got.count() == int(np.triu(d <= 0.2, 1).sum())
    _, pairs = T.nearest_pairs(tiles, 5)
    assert pairs.count() < n * (n - 1) / 3
    near = {(r["id"], r["rank"]): r["distance"] for r in T.knn_join(df, "id", "v", 5, tile_rows=64).collect()}
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :5]
    assert all(near[i, k + 1] == pytest.approx(want[i, k]) for i in range(len(x)) for k in range(5))


@pytest.mark.parametrize("metric", ["manhattan", "cosine"])
def test_knn_metrics(spark, points, blobs, metric):
    d = brute.dist(blobs, blobs, metric)
    np.fill_diagonal(d, np.inf)
    got = {(r["id"], r["rank"]): r["distance"] for r in T.knn_join(points, "id", "v", 3, metric, tile_rows=9).collect()}
    assert len(got) == 3 * len(blobs)
    assert all(got[i, k + 1] == pytest.approx(x, abs=1e-12) for i in range(len(blobs)) for k, x in enumerate(np.sort(d[i])[:3]))


def test_equal_rows_fill_tiles_by_number(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300)] + [(300, [5.0, 5.0])], "id int, v array<double>")
    tiles = T.build_tiles(df, "id", "v", tile_rows=50, pivots=True)
    assert tiles.agg(F.sum("n")).first()[0] == 301 and tiles.agg(F.max("n")).first()[0] < 90
    got = T.knn_join(df, "id", "v", 2, tile_rows=50)
    assert got.count() == 602 and got.where("id < 300 AND distance > 0").count() == 0
    assert T.knn_join(df.limit(1), "id", "v", 2).count() == 0 and T.knn_join(df.limit(0), "id", "v", 2).count() == 0
    assert T.knn_join(df.limit(3), "id", "v", 5).count() == 6


def test_folded_ids_come_back(points, blobs):
    got = {(r["id"], r["rep"]) for r in T.copies(points, "id", "v").collect()}
    first = {}
    for i, v in enumerate(map(tuple, blobs)):
        first.setdefault(v, []).append(i)
    assert got == {(i, ids[0]) for ids in first.values() if len(ids) > 1 for i in ids}


@pytest.mark.parametrize("skip_zero", [False, True])
def test_knn(points, blobs, skip_zero):
    d = brute.dist(blobs, blobs)
    np.fill_diagonal(d, np.inf)
    if skip_zero:
        d[d == 0] = np.inf
    got = {}
    for r in T.knn_join(points, "id", "v", 4, skip_zero=skip_zero, tile_rows=9).collect():
        got.setdefault(r["id"], {})[r["rank"]] = (r["distance"], r["neighbour"])
    for i in range(len(blobs)):
        order = np.lexsort((np.arange(len(blobs)), d[i].round(12)))[:4]
        assert [got[i][k][0] for k in range(1, 5)] == pytest.approx(list(d[i][order]))


def test_string_ids(spark, points, blobs):
    df = points.select(F.format_string("s%04d", "id").alias("id"), "v")
    got = T.eps_join(df, "id", "v", 0.5, collapse=False, tile_rows=10).collect()
    d = brute.dist(blobs, blobs)
    assert len(got) == int((np.triu(d <= 0.5, 1)).sum())


def test_components_chain_star_and_groups(spark):
    rng = np.random.default_rng(3)
    edges = [(0, i, i + 1) for i in range(60)] + [(0, 100, i) for i in range(101, 130)] + [(1, int(a), int(b)) for a, b in rng.integers(0, 80, (60, 2))]
    df = spark.createDataFrame(edges, "g int, u int, v int")
    got = {(r["g"], r["node"]): r["root"] for r in P.connected_components(df, ["g"]).collect()}
    for g in (0, 1):
        root = brute.components(200, [(a, b) for k, a, b in edges if k == g])
        nodes = {x for k, a, b in edges if k == g for x in (a, b)}
        assert {n: got[(g, n)] for n in nodes} == {n: root[n] for n in nodes}
    assert len(got) == len({(k, x) for k, a, b in edges for x in (a, b)})


@pytest.mark.parametrize("tile_rows", [11, 500])
def test_dbscan(points, blobs, tile_rows):
    configs = [(0.3, 3), (0.3, 25), (0.25, 4), (5.0, 3), (0.001, 2), (0.001, 50)]
    got = D.dbscan_many(points, "id", "v", configs, tile_rows=tile_rows).orderBy("id").collect()
    for cfg, (eps, least) in enumerate(configs):
        label, core = brute.dbscan(blobs, eps, least)
        mine = [r for r in got if r["cfg"] == cfg]
        assert [r["cluster_id"] for r in mine] == list(label)
        assert [r["is_core"] for r in mine] == list(core)
        assert sum(r["is_seed"] for r in mine) == len(set(label) - {-1})


@pytest.mark.parametrize("metric,eps", [("manhattan", 0.5), ("cosine", 0.002)])
def test_dbscan_metrics(points, blobs, metric, eps):
    df = points.withColumn("v", F.transform("v", lambda e: e + 20)) if metric == "cosine" else points
    label, _ = brute.dbscan(blobs + 20 if metric == "cosine" else blobs, eps, 4, metric)
    got = D.dbscan(df, "id", "v", eps, 4, metric, tile_rows=16).orderBy("id").collect()
    assert [r["cluster_id"] for r in got] == list(label)


def test_shared_border_goes_to_the_first_cluster(spark):
    x = [0.0, 0.1, 0.2, 1.1, 2.0, 2.1, 2.2]
    df = spark.createDataFrame([(i, [v]) for i, v in enumerate(x)], "id int, v array<double>")
    got = D.dbscan(df, "id", "v", 0.9, 4, tile_rows=2).orderBy("id").collect()
    want, core = brute.dbscan(np.array(x)[:, None], 0.9, 4)
    assert [r["cluster_id"] for r in got] == list(want)


def test_partition_does_not_depend_on_order(spark, blobs):
    rng = np.random.default_rng(0)
    turn = rng.permutation(len(blobs))
    df = spark.createDataFrame([(i, [float(v) for v in blobs[turn[i]]]) for i in range(len(blobs))], "id int, v array<double>")
    got = [r["cluster_id"] for r in D.dbscan(df, "id", "v", 0.3, 3, tile_rows=13).orderBy("id").collect()]
    label, core = brute.dbscan(blobs, 0.3, 3)
    seen = {}
    for i, c in enumerate(got):
        if core[turn[i]]:
            assert seen.setdefault(label[turn[i]], c) == c


def test_grid_shares_passes(points, blobs):
    configs = [(0.25, 4), (0.3, 3), (0.3, 25)]
    grid, sizes = N.dbscan_grid(points, "id", "v", configs, tile_rows=20)
    got = {(r["eps"], r["min_samples"]): r for r in grid.collect()}
    counted = {(r["eps"], r["min_samples"], r["cluster_id"]): r["size"] for r in sizes.collect()}
    for eps, least in configs:
        label, _ = brute.dbscan(blobs, eps, least)
        r = got[(eps, least)]
        assert r["n_clusters"] == len(set(label) - {-1}) and r["n_noise"] == int((label == -1).sum())
        assert [counted[(eps, least, c)] for c in range(1, r["n_clusters"] + 1)] == [int((label == c).sum()) for c in range(1, r["n_clusters"] + 1)]
        keep = label != -1
        if r["n_clusters"] > 1:
            want = brute.silhouette(brute.dist(blobs[keep], blobs[keep]), label[keep]).mean()
            assert r["silhouette"] == pytest.approx(want)
        else:
            assert np.isnan(r["silhouette"])


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine"])
def test_silhouettes(spark, blobs, metric):
    x = blobs + 20
    label = np.array([0] * 40 + [1] * 35 + [2] * 34 + [3])
    df = spark.createDataFrame([(i, [float(e) for e in p], int(c)) for i, (p, c) in enumerate(zip(x, label))], "id int, v array<double>, c int")
    got = [r["silhouette"] for r in Q.silhouette_samples(df, "id", "v", "c", metric, tile_rows=17).orderBy("id").collect()]
    assert got == pytest.approx(list(brute.silhouette(brute.dist(x, x, metric), label)), abs=1e-7)
    assert got[-1] == 0.0


def test_silhouette_needs_two_clusters(spark):
    df = spark.createDataFrame([(i, [float(i)], 0) for i in range(5)], "id int, v array<double>, c int")
    assert np.isnan(Q.silhouette(df, "id", "v", "c").head()["silhouette"])
    each = df.withColumn("c", F.col("id"))
    assert np.isnan(Q.silhouette(each, "id", "v", "c").head()["silhouette"])


def test_rand_index_of_equal_and_crossed_labels(spark):
    df = spark.createDataFrame([(i % 3, i % 3 + 5, i % 2) for i in range(30)], "a int, b int, c int")
    assert Q.adjusted_rand(df, "a", "b").head()[0] == pytest.approx(1.0)
    assert Q.adjusted_rand(df, "a", "c").head()[0] < 0.05


def test_k_distance_and_knee(points, blobs):
    d = brute.dist(blobs, blobs)
    np.fill_diagonal(d, np.inf)
    curve = N.k_distance_curve(N.k_distances(points, "id", "v", [3, 6], tile_rows=30))
    for m in (3, 6):
        want = np.sort(np.sort(d, axis=1)[:, m - 2])[::-1]
        rows = curve.filter(F.col("min_samples") == m).orderBy("position").collect()
        assert [r["k_distance"] for r in rows] == pytest.approx(list(want))
        bend = np.abs(np.diff(np.diff(np.array([r["k_distance"] for r in rows]))))
        got = N.knee(curve).filter(F.col("min_samples") == m).head()
        assert got["knee_position"] == bend.argmax() + 2
    assert N.knee(curve.filter("position < 10")).count() == 0


def test_radius_is_inclusive_on_rounded_features(spark):
    """A grid with many pairs exactly at the radius, where a product of rounded numbers falls on either side."""
    rng = np.random.default_rng(6)
    x = rng.integers(0, 5, (120, 3)) * 0.1
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id int, v array<double>")
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if np.sqrt(((x[i] - x[j]) ** 2).sum()) <= 0.3}
    got = {(r["id_a"], r["id_b"]) for r in T.eps_join(df, "id", "v", 0.3, collapse=False, tile_rows=16).collect()}
    assert got == want
    label, _ = brute.dbscan(x, 0.1, 4)
    assert [r["cluster_id"] for r in D.dbscan(df, "id", "v", 0.1, 4, tile_rows=16).orderBy("id").collect()] == list(label)


def test_a_tile_travels_once_for_a_block(spark, monkeypatch):
    """Not once for every tile, or few of them, that it meets."""
    monkeypatch.setattr(T, "PARTNERS", 32)
    df = spark.createDataFrame([(i, [float(i % 17), float(i)]) for i in range(600)], "id long, v array<double>")
    tiles = T.build_tiles(df, "id", "v", tile_rows=4)

    def kernel(a, partners):
        for b in partners:
            b.mark = getattr(b, "mark", uuid.uuid4().hex)
            yield {"a": [a.key], "b": [b.key], "mark": [b.mark]}

    pairs = T.tile_pairs(tiles, ordered=True)
    got = T.run_tiles(tiles, pairs, kernel, StructType.fromDDL("a long, b long, mark string")).collect()
    n = tiles.count()
    assert len(got) == len({(r["a"], r["b"]) for r in got}) == n * n
    assert len({r["mark"] for r in got}) <= n * n / 4


def test_links_of_a_block_are_one_forest(spark, monkeypatch):
    """At most an edge a row and pair of blocks, and not one for every pair of tiles."""
    monkeypatch.setattr(T, "PARTNERS", 32)
    links = []
    stored = D.snapshot
    monkeypatch.setattr(D, "snapshot", lambda df, name="t": links.append(stored(df, name)) or links[-1])
    df = spark.createDataFrame([(i, [float(i % 40) / 100]) for i in range(400)], "id long, v array<double>").withColumn("v", F.array(F.col("v")[0] + F.col("id") * 1e-6))
    got = D.dbscan(df, "id", "v", 0.5, 3, tile_rows=8)
    assert got.select("cluster_id").distinct().collect()[0][0] == 1 and got.count() == 400
    edges = next(x for x in links if x.columns == ["cfg", "kind", "u", "v"])
    tiles = 400 / 8
    assert edges.count() < 400 * tiles / 4


def test_links_fold_to_the_same_components():
    r = np.random.default_rng(2)
    cfg, kind, u, v = r.integers(0, 2, 300), np.repeat([0, 1], 150), r.integers(0, 90, 300), r.integers(0, 90, 300)
    u[150:] += 1000
    table = pa.table({"cfg": pa.array(cfg, pa.int32()), "kind": pa.array(kind, pa.int32()), "u": u, "v": v})
    less = D._fold_links(table)
    assert less.schema == table.schema and len(less) < len(table)

    def meaning(rows):
        parts, border = {}, set()
        for c, k, a, b in rows:
            if k == 0:
                one = parts.setdefault((c, a), {a}) | parts.setdefault((c, b), {b})
                parts.update({(c, x): one for x in one})
        for c, k, a, b in rows:
            if k == 1:
                border.add((c, a, min(parts.get((c, b), {b}))))
        return {(k[0], min(x)): len(x) for k, x in parts.items() if len(x) > 1}, border

    rows = lambda t: list(zip(*(t.column(c).to_pylist() for c in ("cfg", "kind", "u", "v"))))
    assert meaning(rows(less)) == meaning(rows(table))


def test_tiles_keep_single_precision_where_nothing_is_lost():
    x = np.random.default_rng(3).normal(size=(50, 4))
    assert len(arrow.packed(x)) == 8 + 50 * 4 * 8 and (arrow.unpacked(arrow.packed(x), 50) == x).all()
    y = x.astype("<f4").astype("<f8")
    assert len(arrow.packed(y)) == 8 + 50 * 4 * 4 and (arrow.unpacked(arrow.packed(y), 50) == y).all()


def test_manhattan_sums_form_no_pairs(spark, monkeypatch):
    """Sums to a cluster of some size come from its sorted columns; copies are at distance 0 exactly."""
    r = np.random.default_rng(4)
    x, y = np.round(r.normal(size=(30, 3)), 1), np.round(r.normal(size=(200, 3)), 1)
    slot = r.integers(0, 3, 200)
    want = np.stack([np.abs(x[:, None] - y[slot == c][None]).sum(axis=(1, 2)) for c in range(3)], axis=1)
    assert np.allclose(Q._manhattan_sums(x, Q._sorted_columns(y, slot, 3), 3), want, rtol=1e-12)
    alike = np.full((70, 3), 0.1)
    assert (Q._manhattan_sums(alike, Q._sorted_columns(alike, np.zeros(70, int), 1), 1) == 0).all()


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_silhouettes_of_large_and_small_clusters(spark, metric):
    """Large clusters over several tiles give sums to both sides, small ones share a tile."""
    r = np.random.default_rng(6)
    label = np.concatenate([np.zeros(90, int), np.full(75, 1), r.integers(2, 12, 60), [50]])
    x = np.round(r.normal(size=(len(label), 3)), 2) + label[:, None] % 5
    df = spark.createDataFrame([(i, row.tolist(), int(l)) for i, (row, l) in enumerate(zip(x, label))], "id long, v array<double>, label int")
    got = Q.silhouette_samples(df, "id", "v", "label", metric, tile_rows=20).orderBy("id").collect()
    d = np.abs(x[:, None] - x[None]).sum(2) if metric == "manhattan" else np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for i, row in enumerate(got):
        own = label == label[i]
        near = min(d[i][label == c].mean() for c in set(label.tolist()) - {label[i]})
        assert row["nearest"] == pytest.approx(near, rel=1e-9)
        assert own.sum() == 1 and row["intra"] is None or row["intra"] == pytest.approx(d[i][own].sum() / (own.sum() - 1), rel=1e-9)


def test_two_blocks_meet_in_one_task(spark, monkeypatch):
    """Every pair of tiles is visited once, and a tile goes once to a pair of blocks, in whatever order its pairs are listed."""
    df = spark.createDataFrame([(i, [float(i % 7), float(i // 7)]) for i in range(90)], "id long, v array<double>")
    tiles = T.build_tiles(df, "id", "v", tile_rows=6)
    seen = []
    inner = T.run_blocks
    monkeypatch.setattr(T, "run_blocks", lambda tiles, roles, *rest: seen.append(roles) or inner(tiles, roles, *rest))
    monkeypatch.setattr(T, "block_tiles", lambda count, cores: 4)
    schema = St.StructType([St.StructField("a", St.LongType()), St.StructField("b", St.LongType())])

    def kernel(a, partners):
        yield {"a": np.full(len(partners), a.key), "b": np.array([b.key for b in partners], np.int64)}

    pairs = T.tile_pairs(tiles, ordered=True)
    got = sorted(tuple(r) for r in T.run_tiles(tiles, pairs, kernel, schema).collect())
    assert got == sorted(tuple(r) for r in pairs.select("a", "b").collect())
    roles = [(r["left"], r["right"], r["tile"]) for r in seen[0].collect()]
    assert len(roles) == len(set(roles)) and all(left <= right for left, right, _ in roles)


@pytest.mark.parametrize("metric,radii", [("euclidean", [0.5, 1.0, 1.5]), ("manhattan", [2.0]), ("cosine", [0.05, 0.2])])
def test_pairs_within_a_radius_are_those_of_all_distances(metric, radii):
    """Single precision finds them, also far from the origin, next to a radius, and where nearly all are near."""
    rng = np.random.default_rng(4)
    grid = np.stack(np.meshgrid(*[np.arange(4) / 2] * 3), axis=-1).reshape(-1, 3)
    for x in (rng.normal(size=(300, 5)), rng.normal(size=(300, 5)) + 1e4, grid + 1, np.repeat(grid[:2] + 1, 50, axis=0), rng.normal(size=(60, 5)) * 1e20):
        a, b = x[: len(x) // 2], x[len(x) // 2 - 5:]
        d = arrow.distances(a, b, metric, radii)
        parts = list(arrow.within(a, b, metric, radii))
        i, j, near = (np.concatenate([p[k] for p in parts]) for k in range(3))
        for r in radii:
            assert sorted(zip(i[near <= r], j[near <= r])) == sorted(zip(*np.nonzero(d <= r)))
        assert near == pytest.approx(d[i, j], abs=1e-6 if metric == "euclidean" else 1e-9)
