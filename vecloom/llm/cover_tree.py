"""Exact top-k inner products by dual-tree cover-tree search.

Vectors are dealt into blocks of nearby rows, and the queries into groups; each block and each group is a cover tree. A node has a
centre and the largest distance from it to a row below it, its covering radius. For a query node (q, r) and a node (p, s) no inner
product exceeds ``q.p + r|p| + s|q| + rs``, so the pair is pruned if that is under the worst kth score of the queries below. Both
trees are descended together; rows are compared only between leaves that are left. Blocks and groups are first compared by their
roots, after each group has searched its own region for its first thresholds.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.session import snapshot

BLOCK, LEAF, PIVOTS, PIVOT_ROWS, CHUNK, SEED = 2048, 32, 64, 4096, 1024, 42


def quantized(vector: str, scale: int = 1024) -> Column:
    """``floor(scale * x)`` of each component, x as double; null if the vector is null or a component is null or not finite."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(v.isNotNull() & ~bad, F.transform(v, lambda x: F.floor(x * F.lit(float(scale)))))


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows; through doubles only where these are exact."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if top < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)


class Tree:
    """A cover tree over integer rows, with the rows in the order of its leaves."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        x = rows.astype(np.float64)
        norms = np.einsum("ij,ij->i", x, x)
        centres, radii, spans, kids, order = [], [], [], [], []

        def far(of: np.ndarray, to: int) -> np.ndarray:
            return np.sqrt(np.maximum(norms[of] - 2 * (x[of] @ x[to]) + norms[to], 0))

        # Depth first, without recursion: (rows, their centre, parent).
        todo = [(np.arange(len(x)), 0, -1)] if len(x) else []
        while todo:
            of, centre, parent = todo.pop()
            node, distance = len(centres), far(of, centre)
            centres.append(centre)
            radii.append(float(distance.max()))
            kids.append([])
            spans.append(None)
            if parent >= 0:
                kids[parent].append(node)
            if len(of) <= leaf or not distance.max() > 1e-6 * (1 + np.sqrt(norms[centre])):
                spans[node] = (sum(map(len, order)), len(of))
                order.append(of)
                continue
            # Children's centres lie farther than half the radius from each other, and cover every row within it.
            cover, chosen, owner = distance.max() / 2, [centre], np.zeros(len(of), np.int64)
            while distance.max() > cover:
                new = int(of[distance.argmax()])
                to_new = far(of, new)
                closer = to_new < distance
                owner[closer], distance = len(chosen), np.minimum(distance, to_new)
                chosen.append(new)
            todo += [(of[owner == j], c, node) for j, c in enumerate(chosen) if (owner == j).any()]
        order = np.concatenate(order) if order else np.zeros(0, np.int64)
        small = np.abs(rows).max(initial=0) < 2**31
        self.ids, self.keys, self.rows = ids[order], keys[order], rows[order].astype(np.int32 if small else np.int64)
        self.centres = x[centres] if centres else x[:0]
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.centres, self.centres))
        # Distances are rounded; a radius must not be short.
        self.radii = np.array(radii) * (1 + 1e-6) + 1e-3 * (np.array(radii) > 0)
        self.kids = [np.array(k, np.int64) for k in kids]
        self.spans = spans

    def packed(self) -> bytes:
        return pickle.dumps(vars(self), 5)

    @classmethod
    def unpacked(cls, state: bytes) -> Tree:
        tree = cls.__new__(cls)
        vars(tree).update(pickle.loads(state))
        return tree

    def below(self, node: int) -> np.ndarray:
        """Places of the rows under a node."""
        out, todo = [], [node]
        while todo:
            at = todo.pop()
            if self.spans[at] is not None:
                out.append(np.arange(self.spans[at][0], sum(self.spans[at])))
            todo += self.kids[at].tolist()
        return np.concatenate(out)


def bounds(centre, norm, radius, centres, norms, radii) -> np.ndarray:
    """No inner product between a row of the one node and a row of each of the others exceeds this."""
    top = centres @ centre + radius * norms + radii * (norm + radius)
    return top + 1e-9 * (norm + radius) * (norms + radii) + 1e-6


class Search:
    """The best ``k`` of one tree's rows for each query of another."""

    def __init__(self, queries: Tree, k: int, floor: np.ndarray):
        self.q, self.k = queries, k
        #: The kth score so far; a score below it can't matter.
        self.kth = floor.astype(np.float64)
        self.best: list[list[tuple[int, int]]] = [[] for _ in queries.ids]

    def _compare(self, places: np.ndarray, tree: Tree, rows: np.ndarray) -> None:
        scores = exact(self.q.rows[places], tree.rows[rows])
        ids = tree.ids[rows]
        useful = (scores >= self.kth[places][:, None]) & (ids[None, :] != self.q.ids[places][:, None])
        for i in np.flatnonzero(useful.any(axis=1)):
            at, hit = int(places[i]), np.flatnonzero(useful[i])
            found = self.best[at] + list(zip((-scores[i, hit]).tolist(), ids[hit].tolist()))
            found.sort()
            self.best[at] = found[:self.k]
            if len(found) >= self.k:
                self.kth[at] = max(self.kth[at], -found[self.k - 1][0])

    def _leaf(self, node: int, tree: Tree, nodes: np.ndarray) -> None:
        q, places = self.q, self.q.below(node)
        one = (q.centres[node], q.norms[node], q.radii[node])
        top = bounds(*one, tree.centres[nodes], tree.norms[nodes], tree.radii[nodes])
        while len(nodes):
            left = top >= self.kth[places].min()
            nodes, top = nodes[left], top[left]
            order = np.argsort(-top)
            now, nodes, later = nodes[order[:64]], nodes[order[64:]], top[order[64:]]
            rows = [np.arange(tree.spans[n][0], sum(tree.spans[n])) for n in now if tree.spans[n] is not None]
            if rows:
                self._compare(places, tree, np.concatenate(rows))
            more = [tree.kids[n] for n in now if tree.spans[n] is None]
            more = np.concatenate(more) if more else np.zeros(0, np.int64)
            top = np.concatenate((later, bounds(*one, tree.centres[more], tree.norms[more], tree.radii[more])))
            nodes = np.concatenate((nodes, more))

    def run(self, tree: Tree) -> None:
        todo = [(0, np.array([0]))] if len(self.q.ids) and len(tree.ids) else []
        while todo:
            node, nodes = todo.pop()
            q = self.q
            top = bounds(q.centres[node], q.norms[node], q.radii[node], tree.centres[nodes], tree.norms[nodes], tree.radii[nodes])
            nodes = nodes[top >= self.kth[q.below(node)].min()]
            if not len(nodes):
                continue
            if q.spans[node] is not None:
                self._leaf(node, tree, nodes)
                continue
            # Open the wider side: nodes wider than the query node give way to their children.
            wide = [n for n in nodes if tree.spans[n] is None and tree.radii[n] > q.radii[node]]
            kept = np.array([n for n in nodes if not (tree.spans[n] is None and tree.radii[n] > q.radii[node])], np.int64)
            nodes = np.concatenate([kept, *(tree.kids[n] for n in wide)])
            todo += [(int(child), nodes) for child in q.kids[node]]


def _pack(frame: pd.DataFrame) -> pd.DataFrame:
    rows = np.array(frame["v"].tolist(), np.int64).reshape(len(frame), -1)
    tree = Tree(frame["id"].to_numpy(), frame["key"].to_numpy(), rows)
    return frame[["dim", "cell", "part"]].iloc[:1].assign(centre=[tree.centres[0]], norm=tree.norms[0], radius=tree.radii[0], tree=tree.packed())


def _packed(rows: DataFrame, most: int, name: str) -> DataFrame:
    """A row per block: rows of one region, dealt by hash so that none has many more than ``most``."""
    sizes = snapshot(rows.groupBy("dim", "cell").agg(F.ceil(F.count("*") / most).alias("parts")), f"{name}-cells")
    placed = rows.join(sizes, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("id", "key"), F.col("parts")))
    found = placed.select("dim", "cell", "part", "id", "key", "v").groupBy("dim", "cell", "part").applyInPandas(
        _pack, "dim int, cell int, part long, centre array<double>, norm double, radius double, tree binary"
    )
    return snapshot(found, name)


FOUND = "query_id long, query_key long, vec_id long, score long"


def _search(pairs: DataFrame, k: int) -> DataFrame:
    """Search the rows' ``tree`` for the queries of ``queries``; ``floor``: scores known for each query, by place."""

    def run(frames):
        for frame in frames:
            for packed, own, floor in zip(frame["tree"], frame["queries"], frame["floor"]):
                queries = Tree.unpacked(own)
                start = np.full(len(queries.ids), -np.inf)
                for known in floor:
                    start[known["place"]] = known["score"]
                search = Search(queries, k, start)
                search.run(Tree.unpacked(packed))
                rows = [(q, key, vec, -score) for q, key, best in zip(queries.ids, queries.keys, search.best) for score, vec in best]
                yield pd.DataFrame(rows, columns=["query_id", "query_key", "vec_id", "score"], dtype=np.int64)

    return pairs.select("tree", "queries", "floor").mapInPandas(run, FOUND)


def _regions(rows: DataFrame, pivots: int, sample: int, seed: int) -> DataFrame:
    """Rows with the nearest of at most ``pivots`` spread rows, picked from ``sample`` rows (both bounds fixed)."""
    picked: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("id", "key", F.lit(seed)), "id", "key").limit(sample).collect():
        picked.setdefault(r["dim"], []).append(r["v"])
    centres = {}
    for dim, vectors in picked.items():
        x = np.array(vectors, np.float64).reshape(len(vectors), dim)
        chosen, distance = [0], ((x - x[0]) ** 2).sum(axis=1)
        while len(chosen) < pivots and distance.max() > 0:
            chosen.append(int(distance.argmax()))
            distance = np.minimum(distance, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
        centres[dim] = x[chosen]

    def run(frames):
        for frame in frames:
            cell = np.zeros(len(frame), np.int32)
            for dim, at in frame.groupby("dim").indices.items():
                if dim and dim in centres:
                    x = np.array(frame["v"].iloc[at].tolist(), np.float64)
                    cell[at] = ((centres[dim] ** 2).sum(axis=1) - 2 * x @ centres[dim].T).argmin(axis=1)
            yield frame.assign(cell=cell)

    return rows.mapInPandas(run, "id long, key long, dim int, v array<bigint>, cell int")


def top_k(vectors: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "v", k: int = 10, block: int = BLOCK, group: int = BLOCK // 2, pivots: int = PIVOTS, sample: int = PIVOT_ROWS, seed: int = SEED) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: of all ``vectors`` the ``k`` with the highest inner product with each of ``queries``.

    Both frames have an id and an array of integers. A row never meets rows of its own id, nor vectors of another length. Ties go to
    the smaller id. Null vectors and null ids take no part. Rows that repeat an id and its vector count once; an id with several
    vectors is several candidates and several queries (``query_key`` tells them apart). Fewer than ``k`` candidates: all. Empty
    tables give no rows. A score that doesn't fit into a long fails the job, it doesn't wrap. Other columns are not read.
    """

    def clean(df: DataFrame) -> DataFrame:
        df = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<bigint>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
        return df.select("id", F.xxhash64("v").alias("key"), F.size("v").alias("dim"), "v")

    rows = snapshot(_regions(clean(vectors).distinct(), pivots, sample, seed), "vectors")
    asked = clean(queries).distinct()
    blocks = _packed(rows, block, "blocks")
    # A query is a row of the table, as a rule; one that isn't gets its region here.
    known = asked.join(rows.select("id", "key", "cell"), ["id", "key"], "left").withColumn("cell", F.coalesce("cell", F.lit(0))).distinct()
    groups = _packed(known, group, "groups").select("dim", F.col("cell").alias("g_cell"), F.col("part").alias("g_part"), F.col("centre").alias("g_centre"), F.col("norm").alias("g_norm"), F.col("radius").alias("g_radius"), F.col("tree").alias("queries"))

    # First thresholds: each group searches one block of its own region.
    parts = blocks.groupBy("dim", F.col("cell").alias("g_cell")).agg(F.count("*").alias("parts"))
    # A region may hold queries but no candidate; its group starts without thresholds.
    home = groups.join(parts, ["dim", "g_cell"], "left").withColumn("h_part", F.coalesce(F.pmod("g_part", "parts"), F.lit(-1))).drop("parts")
    first = home.join(blocks, (home["dim"] == blocks["dim"]) & (home["g_cell"] == blocks["cell"]) & (home["h_part"] == blocks["part"])).drop(blocks["dim"])
    no_floor = F.array().cast("array<struct<place:int,score:double>>")
    near = snapshot(_search(first.withColumn("floor", no_floor), k), "near")

    # The kth score of each query, by its place in the group.
    kth = near.groupBy("query_id", "query_key").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("score")).where(F.col("n") >= k)

    def places(frames):
        for frame in frames:
            for r in frame.itertuples():
                tree = Tree.unpacked(r.queries)
                n = len(tree.ids)
                yield pd.DataFrame({"dim": r.dim, "g_cell": r.g_cell, "g_part": r.g_part, "place": np.arange(n, dtype=np.int32), "query_id": tree.ids, "query_key": tree.keys})

    at = groups.select("dim", "g_cell", "g_part", "queries").mapInPandas(places, "dim int, g_cell int, g_part long, place int, query_id long, query_key long")
    floors = at.join(kth, ["query_id", "query_key"], "left").groupBy("dim", "g_cell", "g_part").agg(
        F.collect_list(F.when(F.col("score").isNotNull(), F.struct("place", "score"))).alias("floor"), F.min(F.coalesce("score", F.lit(float("-inf")))).alias("worst")
    )
    ready = snapshot(home.join(floors, ["dim", "g_cell", "g_part"]), "ready")

    # Roots against roots: each group meets the blocks' roots in chunks, and the pairs that may matter are left.
    chunks = snapshot(blocks.groupBy("dim").agg(F.ceil(F.count("*") / CHUNK).alias("chunks")), "chunks")
    heads = blocks.join(chunks, "dim").select("dim", F.pmod(F.xxhash64("cell", "part"), F.col("chunks")).alias("chunk"), F.struct("cell", "part", "centre", "norm", "radius").alias("head"))
    heads = heads.groupBy("dim", "chunk").agg(F.collect_list("head").alias("heads"))
    lean = ready.select("dim", "g_cell", "g_part", "h_part", "g_centre", "g_norm", "g_radius", "worst").join(chunks, "dim")
    lean = lean.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))

    def prune(frames):
        for frame in frames:
            for r in frame.itertuples():
                c = np.array([h["centre"] for h in r.heads], np.float64).reshape(len(r.heads), -1)
                top = bounds(np.array(r.g_centre), r.g_norm, r.g_radius, c, np.array([h["norm"] for h in r.heads]), np.array([h["radius"] for h in r.heads]))
                kept = [(r.dim, r.g_cell, r.g_part, h["cell"], h["part"]) for h, t in zip(r.heads, top) if t >= r.worst and (h["cell"], h["part"]) != (r.g_cell, r.h_part)]
                yield pd.DataFrame(kept, columns=["dim", "g_cell", "g_part", "cell", "part"])

    pairs = lean.join(heads, ["dim", "chunk"]).mapInPandas(prune, "dim int, g_cell int, g_part long, cell int, part long")
    pairs = snapshot(pairs, "pairs").repartition("cell", "part", "g_cell", "g_part")
    rest = pairs.join(blocks.select("dim", "cell", "part", "tree"), ["dim", "cell", "part"]).join(ready.select("dim", "g_cell", "g_part", "queries", "floor"), ["dim", "g_cell", "g_part"])
    found = near.unionByName(_search(rest, k))
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query_key")
