import numpy as np
import pytest

from vecloom.llm import cover_tree as C


def brute(vectors, queries, k):
    out = {}
    for q, v in queries:
        scored = sorted((-int(np.dot(np.array(v, object), np.array(w, object))) if len(v) else 0, i) for i, w in vectors if i != q and len(w) == len(v))
        out.setdefault(q, []).append([(i, -s) for s, i in scored[:k]])
    return {q: sorted(x) for q, x in out.items()}


def gathered(found):
    by = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        by.setdefault((r.query_id, r.query_key), []).append((r.vec_id, r.score))
    out = {}
    for (q, _), rows in by.items():
        out.setdefault(q, []).append(rows)
    return {q: sorted(x) for q, x in out.items()}


def clusters(n, dim, seed=1, scale=400):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, scale, (9, dim))
    return [(int(i), [int(x) for x in centres[rng.integers(9)] + rng.normal(0, scale / 8, dim)]) for i in range(n)]


def test_bounds_hold_and_prune():
    rows = np.array([v for _, v in clusters(1500, 5)], np.int64)
    ids, keys = np.arange(len(rows)), np.zeros(len(rows), np.int64)
    tree, queries = C.Tree(ids, keys, rows), C.Tree(ids[:200], keys[:200], rows[:200])
    for node in range(0, len(tree.spans), 7):
        below = tree.rows[tree.below(node)]
        top = C.bounds(queries.centres[0], queries.norms[0], queries.radii[0], tree.centres[[node]], tree.norms[[node]], tree.radii[[node]])
        assert C.exact(queries.rows[queries.below(0)], below).max() <= top[0]
    assert sorted(tree.below(0).tolist()) == list(range(len(rows)))
    compared = 0
    search = C.Search(queries, 10, np.full(200, -np.inf))
    plain = search._compare

    def count(places, tree, at):
        nonlocal compared
        compared += len(places) * len(at)
        plain(places, tree, at)

    search._compare = count
    search.run(C.Tree.unpacked(tree.packed()))
    assert compared < 0.7 * 200 * 1500
    want = brute(list(zip(ids.tolist(), rows.tolist())), list(zip(ids[:200].tolist(), rows[:200].tolist())), 10)
    got = {int(q): [[(i, -s) for s, i in best]] for q, best in zip(queries.ids, search.best)}
    assert got == want


@pytest.mark.parametrize("block,group", [(2048, 1024), (40, 8)])
def test_equals_brute_force(spark, block, group):
    vectors = clusters(500, 4) + [(i, [7, 7, 7, 7]) for i in range(600, 700)] + [(900, [1, 2]), (901, [3, -4]), (902, [5, 5]), (905, []), (906, [])]
    vectors += [(5, [1, 1, 1, 1]), (0, [2**30, -2**30, 3, 1])]
    frame = spark.createDataFrame([(i, v, "q") for i, v in vectors + vectors[:50] + [(None, [1, 2]), (3000, None)]], "vec_id long, v array<bigint>, score string").repartition(5)
    asked = [(i, v) for i, v in vectors if i % 20 == 0 or i in (5, 901, 905)]
    queries = frame.where("vec_id % 20 = 0 OR vec_id IN (5, 901, 905)")
    assert gathered(C.top_k(frame, queries, k=7, block=block, group=group, pivots=4)) == {q: v for q, v in brute(vectors, asked, 7).items() if v[0]}


def test_queries_outside_the_table_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, [1, 2]), (2, [3, 4])], "vec_id long, v array<bigint>")
    other = spark.createDataFrame([(9, [1, 0]), (8, [1, 1, 1])], "vec_id long, v array<bigint>")
    assert gathered(C.top_k(frame, other, k=3)) == {9: [[(2, 3), (1, 1)]]}
    assert C.top_k(frame.limit(0), other).count() == 0 and C.top_k(frame, other.limit(0)).count() == 0


def test_quantized(spark):
    rows = [(1, [0.5, -0.0004]), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("-inf")]), (5, None), (6, [])]
    frame = spark.createDataFrame(rows, "i int, v array<float>").select("i", C.quantized("v").alias("q"))
    assert {r.i: r.q for r in frame.collect()} == {1: [512, -1], 2: None, 3: None, 4: None, 5: None, 6: []}
