"""Exact agglomerative trees without a distance matrix.

A round finds the nearest cluster of each cluster that lost the one it had,
merges all reciprocal pairs at once and goes on; for complete, average and
ward linkage this gives the same tree as merging one pair at a time. Ward and
average cosine linkage follow from the sums of a cluster's vectors, so their
rows are clusters. The others form the distances of the rows anew: tiles hold
whole clusters, a task folds distances by cluster and gives back the nearest
ones, and only a cluster of more than a tile is added up from its parts.
Several (linkage, metric) trees advance in the same rounds; single linkage is
the shortest spanning tree, found component by component. A round tells the
nearest few clusters of each that asks, so that a cluster asks again only when
it was merged or has none left. Single precision finds what may be near, and
only that is formed exactly.

The time of a round grows with the open clusters times the rows; what is
stored and shuffled is the rows. The driver keeps a few numbers per row, which
bounds what an exact tree can take; no function changes its method by itself.
Tiles of a round are deleted once the next ones are stored.
Over more rows ask for ``mode="micro"``, a tree over weighted k-means centres
of all rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.functions import arrow, scores
from vecloom.functions import vectors as V
from vecloom.operators import quality
from vecloom.operators.aggregates import mean_vector
from vecloom.operators.catalog import global_rank, sample_n
from vecloom.operators.kmeans import kmeans, point_to_centroid
from vecloom.operators.tiles import PARTNERS, TILE_ROWS, Tile, build_tiles, run_blocks, run_tiles, tile_pairs
from vecloom.session import discard, released, snapshot, stored

TAIL = 4096         # clusters left when one task finishes a tree, from a matrix of 128 MB
ASKING = 1 << 40    # what the tiles of rows that ask are numbered from
NEAR = 8            # nearest clusters that a round tells of a cluster
LONG = 32           # rows of a cluster that are added up by themselves
FINISHED = 2        # trees whose statistics of pairs are shuffled at a time, at most 64 MB each
ROWS_PER_GROUP = 4096   # rows of a tile handed on at a time
LINKAGES = ("single", "complete", "average", "ward")


def _height(stat, linkage, n_i, n_j):
    """Merge height from a row statistic."""
    if linkage == "average":
        return stat / (n_i * n_j)
    return np.sqrt(np.maximum(stat, 0.0)) if linkage == "ward" else stat


def _join_rows(rows: list[np.ndarray], sizes: list[float], linkage: str, between: float, others: np.ndarray) -> np.ndarray:
    """Statistics of a merged cluster to every other one, from its parts."""
    if linkage == "average":
        return np.sum(rows, axis=0)
    if linkage == "complete":
        return np.max(rows, axis=0)
    if len(rows) == 1:
        return rows[0]
    (a, b), (n_a, n_b) = rows, sizes
    return ((n_a + others) * a + (n_b + others) * b - others * between) / (n_a + n_b + others)


def _table(parts: list[dict], schema: T.StructType) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = to_arrow_schema(schema)
    if not parts:
        return wanted.empty_table()
    names = wanted.names
    return pa.concat_tables([pa.table([pa.array(p[n]) if not isinstance(p[n], pa.Array) else p[n] for n in names], names=names).cast(wanted) for p in parts])


class _Tree:
    """Driver-side record of one tree: a few numbers per row."""

    def __init__(self, linkage: str, metric: str, weights: np.ndarray):
        self.linkage, self.metric = linkage, metric
        self.summed = linkage == "ward" or (linkage, metric) == ("average", "cosine")
        #: Rows that the stored state has, and the cluster (its place among the active ones) of every row of the table.
        self.held = self.active = np.arange(len(weights))
        self.cluster = np.arange(len(weights))
        self.sizes, self.last = weights.astype(float), np.zeros(len(weights))
        #: The nearest clusters that are known of each, by rising distance; no other is nearer than ``bound``.
        self.near, self.d = np.full((len(weights), NEAR), -1, np.int32), np.full((len(weights), NEAR), np.inf)
        self.bound, self.ask = np.full(len(weights), np.inf), np.ones(len(weights), bool)
        self.merges = []
        #: Tiles of the last placing, how many of them ask, and whether a cluster has more than one.
        self.tiles, self.hot, self.split = 0, 0, False

    def place(self, tile_rows: int, every: bool) -> dict:
        """A tile for every row: clusters that ask for their nearest ones first, clusters of more than a tile apart."""
        rows = self.held if self.summed else np.arange(len(self.cluster))
        mine = self.cluster[rows]
        brought = np.ones(len(self.active), int) if self.summed else np.bincount(mine, minlength=len(self.active))
        first, number, hot, asked = np.zeros(len(self.active), int), 0, 0, self.ask | every
        for now in (asked, ~asked):
            small = np.flatnonzero(now & (brought <= tile_rows))
            if len(small):
                at = (np.cumsum(brought[small]) - brought[small]) // tile_rows
                first[small], number = number + at, number + int(at[-1]) + 1
            for c in np.flatnonzero(now & (brought > tile_rows)):
                first[c], number = number, number - (-int(brought[c]) // tile_rows)
            hot = hot or number
        order = np.argsort(mine, kind="stable")
        rank = np.empty(len(rows), int)
        rank[order] = np.arange(len(rows)) - np.searchsorted(mine[order], mine[order])
        whole = brought[mine] <= tile_rows
        tile = first[mine] + np.where(whole, 0, rank // tile_rows)
        self.tiles, self.hot, self.split = number, hot, not whole.all()
        return {"idx": rows, "cluster": self.active[mine], "size": self.sizes[mine], "bound": self.bound[mine], "part": tile, "hot": tile < hot, "whole": whole}

    def take(self, idx: np.ndarray, near: np.ndarray, d: np.ndarray) -> None:
        """Near clusters that a round found, among those known before; equal heights go to the least."""
        old, slot = np.nonzero(self.near >= 0)
        row = np.concatenate([np.searchsorted(self.active, idx), old])
        near, d = np.concatenate([near, self.near[old, slot]]), np.concatenate([d, self.d[old, slot]])
        _, once = np.unique(row * len(self.cluster) + near, return_index=True)
        row, near, d = row[once], near[once], d[once]
        order = np.lexsort((near, d, row))
        row, near, d = row[order], near[order], d[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        kept = rank < NEAR
        self.near[:], self.d[:] = -1, np.inf
        self.near[row[kept], rank[kept]], self.d[row[kept], rank[kept]] = near[kept], d[kept]
        self.bound = np.minimum(self.bound, self.d[:, -1])

    def _least(self, d: np.ndarray, e: np.ndarray, n_d: np.ndarray, n_e: np.ndarray, n: np.ndarray, between: np.ndarray) -> np.ndarray:
        """Least height to a merged cluster, of its parts' heights or what these are at least."""
        if self.linkage == "complete":
            return np.maximum(d, e)
        if self.linkage == "average":
            return (n_d * d + n_e * e) / (n_d + n_e)
        return np.sqrt(np.maximum(((n_d + n) * d * d + (n_e + n) * e * e - n * between * between) / (n_d + n_e + n), 0.0))

    def merge(self) -> None:
        """Merge reciprocal pairs as long as they are known for sure.

        No other cluster comes nearer by a merge. What lies near the parts of a merged cluster keeps a least height to it, and goes on to
        its next nearest one while that is nearer. Merged clusters, and those with no known cluster left, ask in the next round.
        """
        n = len(self.active)
        me, known = np.arange(n), self.near >= 0
        near = np.where(known, np.searchsorted(self.active, self.near), -1)
        pending, fresh, gone, root = np.full(n, np.inf), np.zeros(n, bool), np.zeros(n, bool), me.copy()
        while not (fresh | gone).all():
            top, to = self.d[:, 0], near[:, 0]
            sure = ~fresh & ~gone & (to >= 0) & (top <= self.bound) & (top <= pending)
            first = np.flatnonzero(sure & sure[to] & (to[to] == me) & (me < to))
            second = to[first]
            if not len(first):
                if fresh.any():
                    break
                # Rounding may tell the two sides of a pair apart; the nearest pair of all is right nevertheless.
                i = int(np.where(sure, top, np.inf).argmin())
                i, j = sorted((i, int(to[i]) if sure[i] else (i + 1) % n))
                first, second = np.array([i]), np.array([j])
            between = np.where(to[first] == second, top[first], np.where(to[second] == first, top[second], np.inf))
            # Rounding must not place a merge below the merges it contains.
            height = np.maximum(between, np.maximum(self.last[first], self.last[second]))
            partner, apart = np.full(n, -1), np.zeros(n)
            partner[first], partner[second] = second, first
            apart[first] = apart[second] = between
            row, slot = np.nonzero((near >= 0) & (partner[near] >= 0) & (partner < 0)[:, None])
            c = near[row, slot]
            other = near[row] == partner[c][:, None]
            there = other.any(axis=1)
            e = np.where(there, self.d[row, other.argmax(axis=1)], self.bound[row])
            least = self._least(self.d[row, slot], e, self.sizes[c], self.sizes[partner[c]], self.sizes[row], apart[c])
            np.minimum.at(pending, row, least * (1 - 1e-12))
            near[row, slot], self.d[row, slot] = -1, np.inf
            row = np.unique(row)
            order = np.argsort(self.d[row], axis=1, kind="stable")
            near[row], self.d[row] = np.take_along_axis(near[row], order, 1), np.take_along_axis(self.d[row], order, 1)
            size = self.sizes[first] + self.sizes[second]
            self.merges += zip(self.active[first].tolist(), self.active[second].tolist(), height.tolist(), size.tolist())
            fresh[first], gone[second], root[second] = True, True, first
            self.sizes[first], self.last[first] = size, height
        keep = ~gone
        self.ask = (fresh | (near[:, 0] < 0) | (self.d[:, 0] > self.bound))[keep]
        # The least member names the cluster.
        self.cluster = (np.cumsum(keep) - 1)[root][self.cluster]
        self.near, self.d, self.bound = np.where(near >= 0, self.active[near], -1).astype(np.int32)[keep], self.d[keep], self.bound[keep]
        self.near[self.ask], self.d[self.ask], self.bound[self.ask] = -1, np.inf, np.inf
        self.active, self.sizes, self.last = self.active[keep], self.sizes[keep], self.last[keep]


TILE = T.StructType(
    [
        T.StructField("tile", T.LongType()), T.StructField("tree", T.IntegerType()), T.StructField("hot", T.BooleanType()), T.StructField("n", T.IntegerType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("mat", T.BinaryType()), T.StructField("w", T.ArrayType(T.DoubleType())),
        T.StructField("cluster", T.ArrayType(T.IntegerType())), T.StructField("size", T.ArrayType(T.DoubleType())), T.StructField("about", T.ArrayType(T.IntegerType())),
        T.StructField("bound", T.ArrayType(T.DoubleType())),
    ]
)


def _pack(points: DataFrame, states: dict[int, tuple[str, DataFrame]], trees: dict[int, _Tree], tile_rows: int, every: bool) -> DataFrame:
    """Tiles of the given trees, rows in the order of their clusters; trees of sums get a row for each cluster, the others one for each point."""
    spark = points.sparkSession
    kinds = {t: (tree.metric, tree.summed) for t, tree in trees.items()}
    first, later = [], {}
    for t, tree in trees.items():
        place = {"tree": np.full(len(tree.held if tree.summed else tree.cluster), t, np.int32), **tree.place(tile_rows, every)}
        places = pa.table({c: pa.array(x.astype(np.int32)) if c in ("idx", "cluster") else pa.array(x) for c, x in place.items()})
        if t in states:
            later.setdefault(states[t][0], (states[t][1], []))[1].append(places)
        else:
            first.append(places)
        tree.held = tree.active
    parts = []
    if first:
        parts.append(points.select("idx", "vec", "w", F.lit(True).alias("fresh")).join(spark.createDataFrame(pa.concat_tables(first)), "idx"))
    for tiles, places in later.values():
        parts.append(_unpacked(tiles).join(spark.createDataFrame(pa.concat_tables(places)), ["tree", "idx"]))
    rows = reduce(DataFrame.unionByName, parts)

    def pack(key, table):
        t, part = key[0].as_py(), key[1].as_py()
        metric, summed = kinds[t]
        table = table.take(pc.sort_indices(table, [("cluster", "ascending"), ("idx", "ascending")]))
        x, w, cluster, ids = arrow.matrix(table.column("vec")), table.column("w").to_numpy(), table.column("cluster").to_numpy(), table.column("idx").to_numpy()
        size, bound = table.column("size").to_numpy(), table.column("bound").to_numpy()
        if summed:
            if table.column("fresh")[0].as_py():
                x = (arrow.unit(x) if metric == "cosine" else x) * w[:, None]
            at = np.flatnonzero(np.diff(cluster, prepend=-1))
            x, w, cluster, size, bound = np.add.reduceat(x, at, axis=0), np.add.reduceat(w, at), cluster[at], size[at], bound[at]
            ids = cluster
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        return pa.table(
            [pa.array([(t << 32) + part]), pa.array([t], pa.int32()), pa.array([table.column("hot")[0].as_py()]), pa.array([len(x)], pa.int32()), one(ids, pa.int32()),
             pa.array([arrow.packed(x)], pa.binary()), one(w, pa.float64()), one(cluster, pa.int32()), one(size, pa.float64()),
             one([t, int(table.column("whole")[0].as_py())], pa.int32()), one(bound, pa.float64())],
            names=TILE.names,
        )

    return rows.groupBy("tree", "part").applyInArrow(pack, TILE)


def _unpacked(tiles: DataFrame) -> DataFrame:
    """Rows of tiles as the next round's state."""
    def run(batches):
        for batch in batches:
            for tree, ids, mat, w in zip(batch.column("tree"), batch.column("ids"), batch.column("mat"), batch.column("w")):
                x = arrow.unpacked(mat.as_py(), len(ids))
                for at in range(0, len(ids), ROWS_PER_GROUP):
                    part = x[at:at + ROWS_PER_GROUP]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), tree.as_py(), np.int32)), ids.values.slice(at, len(part)), arrow.vectors(part), w.values.slice(at, len(part)), pa.array(np.zeros(len(part), bool))],
                        names=["tree", "idx", "vec", "w", "fresh"],
                    )

    return tiles.select("tree", "ids", "mat", "w").mapInArrow(run, "tree int, idx int, vec array<double>, w double, fresh boolean")


def _roles(trees: dict[int, _Tree], cores: int) -> pa.Table:
    """``(left, right, tile, mates)`` of ``run_blocks``: tiles that ask, in blocks, against blocks of all tiles of their tree, each pair of tiles once.

    A round knows its tiles, so no job has to find them; blocks are cut so that few rows travel and all cores work.
    """
    out = {"left": [], "right": [], "tile": [], "mates": []}
    for t, tree in trees.items():
        groups = max(1, round(np.sqrt(3 * cores * tree.hot / tree.tiles)))
        wide = min(PARTNERS, -(-tree.hot // groups))
        deep = min(PARTNERS, max(1, tree.tiles * -(-tree.hot // wide) // (3 * cores)))
        for i, a in enumerate(range(0, tree.hot, wide)):
            asking = range(a, min(a + wide, tree.hot))
            for j, b in enumerate(range(0, tree.tiles, deep)):
                others = range(max(a, b), min(b + deep, tree.tiles))
                met = [(x, [y for y in others if x <= y]) for x in asking]
                met = [(x, ys) for x, ys in met if ys]
                for x, ys in met + [(y, None) for y in others if met]:
                    for name, value in (("left", (t << 16) + i), ("right", j), ("tile", (t << 32) + x), ("mates", ys and [(t << 32) + y for y in ys])):
                        out[name].append(value)
    return pa.table({"left": pa.array(out["left"], pa.int64()), "right": pa.array(out["right"], pa.int64()), "tile": pa.array(out["tile"], pa.int64()), "mates": pa.array(out["mates"], pa.list_(pa.int64()))})


def _statistics(a, b, linkage: str, metric: str, summed: bool) -> np.ndarray:
    """Row statistics of the clusters of two tiles."""
    wa, wb = a.extra["w"].to_numpy()[:, None], b.extra["w"].to_numpy()[None, :]
    if summed and linkage == "ward":
        d = np.maximum(arrow.distances(a.x / wa, b.x / wb.T), 0.0)
        return d * d * (2.0 * wa * wb / (wa + wb))
    if summed:
        return np.maximum(wa * wb - a.x @ b.x.T, 0.0)
    d = np.maximum(arrow.distances(a.x, b.x, metric), 0.0)
    if a.key == b.key:
        np.fill_diagonal(d, 0.0)
    fold = np.maximum if linkage == "complete" else np.add
    if linkage == "average":
        d *= wa
        d *= wb
    return _by_cluster(d, a, b, fold)


def _starts(tile) -> np.ndarray:
    """First row of each cluster of a tile."""
    return np.flatnonzero(np.diff(tile.extra["cluster"].to_numpy(), prepend=-1))


def _by_cluster(d: np.ndarray, a, b, fold: np.ufunc) -> np.ndarray:
    """A matrix of the rows of two tiles folded to their clusters, row by row of a cluster: its inner loop is long, that of ``reduceat`` is not."""
    for tile in (a, b):
        at = _starts(tile)
        if len(at) < len(tile):
            rows = np.diff(np.append(at, len(tile)))
            out = d[at]
            for k in range(1, min(LONG, int(rows.max()))):
                some = np.flatnonzero((rows > k) & (rows <= LONG))
                out[some] = fold(out[some], d[at[some] + k])
            for c in np.flatnonzero(rows > LONG):
                out[c] = fold.reduce(d[at[c]:at[c] + rows[c]], axis=0)
            d = out
        d = np.ascontiguousarray(d.T) if tile is a and len(_starts(b)) < len(b) else d.T
    # Turned once for each tile.
    return d


def _rough(a, b, linkage: str, metric: str, summed: bool) -> tuple[np.ndarray, float, float]:
    """Least heights of the clusters of two tiles in single precision, the share that these may be too high, and by how much too low."""
    wa, wb = a.extra["w"].to_numpy(), b.extra["w"].to_numpy()
    share = 2.0 ** -21
    if summed and linkage == "average":
        low = (a.x / wa[:, None]).astype("f4") @ (b.x / wb[:, None]).astype("f4").T
        off = (a.x.shape[1] + 16) * 2.0 ** -22
        np.subtract(1.0 - off, low, out=low)
        return np.maximum(low, 0.0, out=low), share, 2 * off
    if summed:
        low, off = arrow.rough(a.x / wa[:, None], b.x / wb[:, None])
        low -= off
        factor = 1.0
        if not ((wa == 1.0).all() and (wb == 1.0).all()):
            inverse = (0.5 / wa).astype(low.dtype)[:, None] + (0.5 / wb).astype(low.dtype)[None, :]
            low /= inverse
            factor = 1.0 / inverse.min()
        np.maximum(low, 0.0, out=low)
        return np.sqrt(low, out=low), share, float(np.sqrt(2 * off * factor))
    low, off = arrow.rough(a.x, b.x, metric)
    if metric != "manhattan":
        low -= off
        np.maximum(low, 0.0, out=low)
    if metric == "euclidean":
        np.sqrt(low, out=low)
        off = np.sqrt(off)
    if linkage == "complete":
        return _by_cluster(low, a, b, np.maximum), share, 2 * off
    if not ((wa == 1.0).all() and (wb == 1.0).all()):
        low = low * wa.astype(low.dtype)[:, None] * wb.astype(low.dtype)[None, :]
    low = _by_cluster(low, a, b, np.add)
    na, nb = (np.add.reduceat(w, _starts(tile)).astype(low.dtype) for w, tile in ((wa, a), (wb, b)))
    low /= na[:, None]
    low /= nb[None, :]
    most = max(int(np.diff(np.append(_starts(tile), len(tile))).max()) for tile in (a, b))
    return low, share * most, 2 * off


def _exact(a, b, i: np.ndarray, j: np.ndarray, linkage: str, metric: str, summed: bool) -> np.ndarray:
    """Row statistics of the clusters ``i`` of tile ``a`` and ``j`` of tile ``b``, the same from both sides."""
    wa, wb = a.extra["w"].to_numpy(), b.extra["w"].to_numpy()
    if summed and linkage == "ward":
        d = arrow.listed(a.x / wa[:, None], b.x / wb[:, None], i, j)
        return d * d * (2.0 * wa[i] * wb[j] / (wa[i] + wb[j]))
    if summed:
        dots = [np.einsum("ij,ij->i", a.x[i[at:at + arrow.LISTED]], b.x[j[at:at + arrow.LISTED]]) for at in range(0, len(i), arrow.LISTED)]
        return np.maximum(wa[i] * wb[j] - np.concatenate([np.zeros(0), *dots]), 0.0)
    at_a, at_b = _starts(a), _starts(b)
    few, many = np.diff(np.append(at_a, len(a)))[i], np.diff(np.append(at_b, len(b)))[j]
    # Rows of the lower cluster first.
    turned = a.extra["cluster"].to_numpy()[at_a][i] > b.extra["cluster"].to_numpy()[at_b][j]
    pairs = few * many
    begin = np.cumsum(pairs) - pairs
    of = np.repeat(np.arange(len(i)), pairs)
    place = np.arange(len(of)) - begin[of]
    inner = np.where(turned, few, many)[of]
    out, into = np.divmod(place, inner)
    x = at_a[i][of] + np.where(turned[of], into, out)
    y = at_b[j][of] + np.where(turned[of], out, into)
    d = np.maximum(arrow.listed(a.x, b.x, x, y, metric), 0.0)
    if linkage == "average":
        d *= wa[x]
        d *= wb[y]
    return (np.maximum if linkage == "complete" else np.add).reduceat(d, begin) if len(i) else d


def _open(tile) -> None:
    """The nearest clusters found so far of those of a tile, and what a nearer one has to be under."""
    if not hasattr(tile, "limit"):
        at = _starts(tile)
        tile.names, tile.sizes, tile.limit = tile.extra["cluster"].to_numpy()[at], tile.extra["size"].to_numpy()[at], tile.extra["bound"].to_numpy()[at].copy()
        tile.near, tile.d = np.full((len(at), NEAR), -1, np.int64), np.full((len(at), NEAR), np.inf)


def _hold(tile, row: np.ndarray, near: np.ndarray, d: np.ndarray) -> None:
    """Keep the nearest of what is found and what is held; equal heights go to the least."""
    some = (d < tile.limit[row]) | ((d == tile.limit[row]) & (near < tile.near[row, -1]))
    row, near, d = row[some], near[some], d[some]
    if not len(row):
        return
    rows = np.unique(row)
    row, near, d = np.concatenate([np.repeat(rows, NEAR), row]), np.concatenate([tile.near[rows].ravel(), near]), np.concatenate([tile.d[rows].ravel(), d])
    order = np.lexsort((near, d, row))
    row = row[order]
    order = order[np.arange(len(row)) - np.searchsorted(row, row) < NEAR]
    tile.near[rows], tile.d[rows] = near[order].reshape(-1, NEAR), d[order].reshape(-1, NEAR)
    tile.limit[rows] = np.minimum(tile.limit[rows], tile.d[rows, -1])


def _compare(a, b, linkage: str, metric: str, summed: bool) -> None:
    """Hold the nearest clusters that two tiles have of each other: what single precision doesn't rule out is formed exactly."""
    low, share, off = _rough(a, b, linkage, metric, summed)
    same = a.key == b.key
    if same:
        np.fill_diagonal(low, np.inf)
    limits = []
    for tile, m in ((a, low), (b, low.T))[:1 if same else 2]:
        limit, open_ = tile.limit.copy(), np.flatnonzero(np.isinf(tile.limit))
        if len(open_) and m.shape[1] > NEAR:
            kth = np.partition(m[open_], NEAR - 1, axis=1)[:, NEAR - 1].astype(float)
            # A little more, so that what lies at the limit is found too.
            limit[open_] = (kth + off) * (1 + 4 * share) + 1e-37
        limits.append(limit)
    over = [(limit * (1 + 4 * share)).astype(low.dtype) for limit in limits]
    hit = low <= over[0][:, None]
    if not same:
        hit |= low <= over[1][None, :]
    i, j = np.divmod(np.flatnonzero(hit), low.shape[1])
    if same:
        i, j = i[i != j], j[i != j]
    few, many = (np.diff(np.append(_starts(tile), len(tile))) for tile in (a, b))
    if 8 * int((few[i] * many[j]).sum()) > len(a) * len(b):
        h = _height(_statistics(a, b, linkage, metric, summed), linkage, a.sizes[:, None], b.sizes[None, :])
        if same:
            np.fill_diagonal(h, np.inf)
        d = h[i, j]
    else:
        d = _height(_exact(a, b, i, j, linkage, metric, summed), linkage, a.sizes[i], b.sizes[j])
    _hold(a, i, b.names[j], d)
    if not same:
        _hold(b, j, a.names[i], d)


def _distances(tiles: DataFrame, trees: dict[int, _Tree], every: bool) -> DataFrame:
    """``(tree, x, y, d, nx, ny, stat)`` over the tiles that ask and all tiles of their trees.

    The nearest clusters ``y`` of each ``x`` with their height ``d``, for one that doesn't ask only those under its bound; where a tile has
    a part of a cluster the statistic of each pair instead, to be put together with those of other tiles. With ``every``: ``(tree, x, y, stat)``, the clusters of two tiles and the statistics
    of all their pairs, for a tile with itself those above the diagonal.
    """
    kinds = {t: (tree.linkage, tree.metric, tree.summed) for t, tree in trees.items()}
    pairs = "tree int, x int, y int, d double, nx double, ny double, stat double"
    schema = T.StructType.fromDDL("tree int, x array<int>, y array<int>, stat binary" if every else pairs)
    spark = tiles.sparkSession
    cores = spark.sparkContext.defaultParallelism
    roles = _roles(trees, cores)
    blocks = len(set(zip(roles.column("left").to_pylist(), roles.column("right").to_pylist())))
    slices = min(2 * blocks, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * cores))

    def clusters(tile):
        cluster = tile.extra["cluster"].to_numpy()
        at = np.flatnonzero(np.diff(cluster, prepend=-1))
        return cluster[at], tile.extra["size"].to_numpy()[at]

    def kernel(a, partners):
        t, whole = a.extra["about"].to_pylist()
        linkage, metric, summed = kinds[t]
        ca, na = clusters(a)
        for b in partners:
            cb, nb = clusters(b)
            apart = whole and b.extra["about"][1].as_py()
            if not apart and len(ca) == len(cb) == 1 and ca[0] == cb[0]:
                continue
            if apart and not every:
                _open(a)
                _open(b)
                _compare(a, b, linkage, metric, summed)
                continue
            stat = _statistics(a, b, linkage, metric, summed)
            if every:
                one = lambda names: pa.array([names], pa.list_(pa.int32()))
                # Of a tile's own pairs each is sent once.
                stat = stat[np.triu_indices(len(ca), 1)] if a.key == b.key else stat
                yield {"tree": np.full(1, t), "x": one(ca), "y": one(cb), "stat": pa.array([np.ascontiguousarray(stat, "<f8").tobytes()], pa.binary())}
                continue
            i, j = np.triu_indices(len(ca), 1) if a.key == b.key else (x.ravel() for x in np.indices(stat.shape))
            turned = ca[i] > cb[j]
            low, high, few, many = ca[i], cb[j], na[i], nb[j]
            yield {
                "tree": np.full(len(i), t), "x": np.where(turned, high, low), "y": np.where(turned, low, high), "d": pa.nulls(len(i), pa.float64()),
                "nx": np.where(turned, many, few), "ny": np.where(turned, few, many), "stat": stat[i, j],
            }

    def end(tiles):
        for tile in tiles:
            if hasattr(tile, "limit"):
                row, slot = np.nonzero(tile.near >= 0)
                yield {"tree": np.full(len(row), tile.extra["about"][0].as_py()), "x": tile.names[row], "y": tile.near[row, slot], "d": tile.d[row, slot], **{c: pa.nulls(len(row), pa.float64()) for c in ("nx", "ny", "stat")}}

    return run_blocks(tiles, F.broadcast(spark.createDataFrame(roles)), slices, kernel, schema, ["w", "cluster", "size", "about", "bound"], None, None if every else end)


def _put_together(found: DataFrame, trees: dict[int, _Tree]) -> DataFrame:
    """``(tree, x, y, nx, ny, stat)`` of cluster pairs from all tiles that have parts of them."""
    greatest = F.col("tree").isin([t for t, tree in trees.items() if tree.linkage == "complete"])
    return found.where("stat IS NOT NULL").groupBy("tree", "x", "y", "nx", "ny").agg(F.when(greatest, F.max("stat")).otherwise(F.sum("stat")).alias("stat"))


def _least_near(found: DataFrame, asking: int) -> DataFrame:
    """``(tree, x, y, d)``: the ``NEAR`` nearest ``y`` of each ``x``."""
    def nearest(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [(c, "ascending") for c in ("tree", "x", "d", "y")]))
        key = (table.column("tree").to_numpy().astype(np.int64) << 32) + table.column("x").to_numpy()
        return table.filter(pa.array(np.arange(len(key)) - np.searchsorted(key, key) < NEAR)).select(["tree", "x", "y", "d"])

    # A task gets some ten thousand.
    return found.groupBy(F.pmod("x", F.lit(1 + asking // 20000))).applyInArrow(nearest, "tree int, x int, y int, d double")


def _nearest(tiles: DataFrame, trees: dict[int, _Tree]) -> pa.Table:
    """``(tree, x, y, d)``: the nearest clusters, ``NEAR`` of each, among those that the tiles compare."""
    found = _distances(tiles, trees, False)
    held: list[str] = []
    if not any(tree.split for tree in trees.values()):
        one = found.select("tree", "x", "y", "d")
    else:
        found = stored(found, held, "found")
        of = lambda *kinds: F.col("tree").isin([t for t, tree in trees.items() if tree.linkage in kinds])
        height = F.when(of("average"), F.col("stat") / (F.col("nx") * F.col("ny"))).when(of("ward"), F.sqrt(F.greatest("stat", F.lit(0.0)))).otherwise(F.col("stat"))
        parts = _put_together(found, trees).withColumn("d", height)
        one = found.where("stat IS NULL").select("tree", "x", "y", "d").unionByName(parts.select("tree", "x", "y", "d"))
        one = one.unionByName(parts.select("tree", F.col("y").alias("x"), F.col("x").alias("y"), "d"))
    with released(tiles.sparkSession):
        best = _least_near(one, sum(len(tree.active) for tree in trees.values())).toArrow()
    discard(tiles.sparkSession, *held)
    return best


def _finish(trees: dict[int, _Tree], tiles: DataFrame) -> dict[int, list[tuple]]:
    """Merge the last clusters of each tree, at most ``TAIL`` per task, from the statistics of all their pairs, tile by tile.

    Trees of sums send the sums, a row for a cluster, and their task forms the statistics; the others form them in tiles of rows.
    """
    held = {t: (tree.linkage, tree.metric, tree.active, tree.sizes, tree.last) for t, tree in trees.items()}
    summed = [t for t, tree in trees.items() if tree.summed]
    others = {t: tree for t, tree in trees.items() if not tree.summed}
    schema = T.StructType(
        [T.StructField("tree", T.IntegerType()), T.StructField("step", T.IntegerType()), T.StructField("a", T.IntegerType()),
         T.StructField("b", T.IntegerType()), T.StructField("height", T.DoubleType()), T.StructField("size", T.DoubleType())]
    )

    def formed(table: pa.Table, linkage: str, metric: str):
        """Clusters of two tiles and the statistics of their pairs."""
        if "stat" in table.column_names:
            for x, y, stat in zip(*(table.column(c) for c in ("x", "y", "stat"))):
                yield x.values.to_numpy(), y.values.to_numpy(), np.frombuffer(stat.as_py(), "<f8")
            return
        some = sorted((Tile(table, row, ["w", "cluster"]) for row in range(len(table))), key=lambda tile: tile.key)
        for i, a in enumerate(some):
            for b in some[i:]:
                x, y = a.extra["cluster"].to_numpy(), b.extra["cluster"].to_numpy()
                stat = _statistics(a, b, linkage, metric, True)
                yield x, y, stat[np.triu_indices(len(x), 1)] if a is b else stat

    def run(table: pa.Table) -> pa.Table:
        tree = table.column("tree")[0].as_py()
        linkage, metric, active, sizes, last = held[tree]
        m = np.zeros((len(active), len(active)))
        together = np.maximum if linkage == "complete" else np.add
        for x, y, stat in formed(table, linkage, metric):
            x, y = np.searchsorted(active, x), np.searchsorted(active, y)
            # A cluster of more than a tile comes in parts.
            if np.array_equal(x, y):
                # Rounding may tell the two sides of a tile's own pairs apart; the upper one counts.
                part = np.zeros((len(x), len(x)))
                part[np.triu_indices(len(x), 1)] = stat
                part = part + part.T
            else:
                part = stat.reshape(len(x), len(y))
            m[np.ix_(x, y)] = together(m[np.ix_(x, y)], part)
            if not np.array_equal(x, y):
                m[np.ix_(y, x)] = together(m[np.ix_(y, x)], part.T)
        sizes, last, live = sizes.copy(), last.copy(), np.ones(len(active), bool)
        h = _height(m, linkage, sizes[:, None], sizes[None, :])
        h = h.copy() if h is m else h
        np.fill_diagonal(h, np.inf)
        nn = h.argmin(axis=1)
        d = h[np.arange(len(active)), nn]
        out = []
        for step in range(len(active) - 1):
            i = int(d.argmin())
            i, j = sorted((i, int(nn[i])))
            raw = m[i, j]
            height = max(float(h[i, j]), last[i], last[j])
            row = _join_rows([m[i], m[j]], [sizes[i], sizes[j]], linkage, raw, sizes)
            m[i], m[:, i] = row, row
            sizes[i] += sizes[j]
            last[i], live[j] = height, False
            out.append((tree, step, int(active[i]), int(active[j]), height, float(sizes[i])))
            far = _height(row, linkage, sizes[i], sizes).copy()
            far[~live] = far[i] = np.inf
            h[i], h[:, i], h[j], h[:, j] = far, far, np.inf, np.inf
            redo = live & ((nn == i) | (nn == j))
            redo[i], d[j] = True, np.inf
            at = np.flatnonzero(redo)
            nn[at] = h[at].argmin(axis=1)
            d[at] = h[at, nn[at]]
            near = live & ((far < d) | ((far == d) & (i < nn) & (d < np.inf)))
            nn[near], d[near] = i, far[near]
        cols = list(zip(*out))
        return _table([dict(zip([f.name for f in schema.fields], [np.asarray(c) for c in cols]))], schema)

    got = []
    with released(tiles.sparkSession):
        if summed:
            got += tiles.where(F.col("tree").isin(summed)).select("tree", "tile", "n", "ids", "mat", "w", "cluster").groupBy("tree").applyInArrow(run, schema).collect()
        for at in range(0, len(others), FINISHED):
            some = dict(list(others.items())[at:at + FINISHED])
            got += _distances(tiles.where(F.col("tree").isin(list(some))), some, True).groupBy("tree").applyInArrow(run, schema).collect()
    tails = {t: [] for t in trees}
    # Sorted here, at most ``TAIL`` a tree: a sort in Spark would run the trees twice to find its ranges.
    for r in sorted(got, key=lambda r: (r["tree"], r["step"])):
        tails[r["tree"]].append((r["a"], r["b"], r["height"], r["size"]))
    return tails


def agglomerative_many(df: DataFrame, id_col: str, vector: str, trees: Sequence[tuple[str, str]], weight: str | None = None, tail: int = TAIL, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Merge tables of several trees: ``(tree, step, a, b, height, size)``.

    ``trees`` are (linkage, metric) pairs; ``a`` and ``b`` are the least ids
    of the two clusters joined and steps rise with height. Weights, when
    given, say how many rows each point stands for.
    """
    trees = [(l, m) for l, m in trees]
    for linkage, metric in trees:
        if linkage not in LINKAGES:
            raise ValueError(f"unknown linkage {linkage!r}")
        if linkage == "ward" and metric != "euclidean":
            raise ValueError("ward needs the euclidean metric")
    spark = df.sparkSession
    n = df.count()
    id_field = df.schema[id_col]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(F.col(id_col).alias("id"), F.col(vector).alias("vec"), w.alias("w"))
    ranked = snapshot(global_rank(rows, ["id"], name="rank").withColumn("idx", (F.col("rank") - 1).cast("int")).drop("rank"), "points")
    weights = np.array([r["w"] for r in ranked.select("idx", "w").orderBy("idx").collect()])
    names = ranked.select("idx", "id")
    out_type = T.StructType([T.StructField("tree", T.IntegerType()), T.StructField("step", T.IntegerType()), T.StructField("ia", T.IntegerType()),
                             T.StructField("ib", T.IntegerType()), T.StructField("height", T.DoubleType()), T.StructField("size", T.DoubleType())])
    merges = []
    held = {t: _Tree(linkage, metric, weights) for t, (linkage, metric) in enumerate(trees) if linkage != "single"}
    if n >= 2:
        for t, (linkage, metric) in enumerate(trees):
            if linkage == "single":
                merges += _ordered(t, _single_links(ranked, n, metric, tile_rows), weights)
    if n >= 2 and held:
        # Where the sums of a tree's clusters were stored last; ``made`` are all tiles not deleted yet.
        states: dict[int, tuple[str, DataFrame]] = {}
        made: list[str] = []
        while moving := {t: tree for t, tree in held.items() if len(tree.active) > tail}:
            now: list[str] = []
            tiles = stored(_pack(ranked, states, moving, tile_rows, False), now, "tiles")
            found = _nearest(tiles, moving)
            of, x, y, d = (found.column(c).to_numpy() for c in ("tree", "x", "y", "d"))
            for t, tree in moving.items():
                mine = of == t
                tree.take(x[mine], y[mine], d[mine])
                tree.merge()
                if tree.summed:
                    states[t] = now[0], tiles
            live = {path for path, _ in states.values()}
            discard(spark, *[path for path in made if path not in live])
            made = [path for path in made if path in live] + now
        tiles = stored(_pack(ranked, states, held, tile_rows, True), made, "tiles")
        tails = _finish(held, tiles)
        discard(spark, *made)
        for t, tree in held.items():
            merges += _ordered(t, tree.merges + tails[t], weights)
    table = spark.createDataFrame(_table([dict(zip(out_type.names, zip(*merges)))] if merges else [], out_type))
    named = table.join(names.select(F.col("idx").alias("ia"), F.col("id").alias("a")), "ia").join(names.select(F.col("idx").alias("ib"), F.col("id").alias("b")), "ib")
    return named.select("tree", "step", F.col("a").cast(id_field.dataType).alias("a"), F.col("b").cast(id_field.dataType).alias("b"), "height", "size")


def _ordered(tree: int, merges: list[tuple], weights: np.ndarray) -> list[tuple]:
    """Merges by height, named by the least members of the clusters they join."""
    ranked = sorted(range(len(merges)), key=lambda i: (merges[i][2], i))
    out, parent, size = [], list(range(len(weights))), weights.astype(float).copy()

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for step, i in enumerate(ranked):
        a, b = sorted((find(merges[i][0]), find(merges[i][1])))
        parent[b] = a
        size[a] += size[b]
        out.append((tree, step, int(a), int(b), float(merges[i][2]), float(size[a])))
    return out


def _single_links(points: DataFrame, n: int, metric: str, tile_rows: int) -> list[tuple]:
    """Links (u, v, distance) of the shortest spanning tree, by rising distance.

    One pass over all pairs of tiles finds the ``NEAR`` nearest rows of each row. The shortest link out of a component is known while it
    is within what the lists of its rows reach; components are joined by it until none is known. Then rows whose lists have nothing
    outside their component ask for their nearest rows there, but for those of the largest component, so the components at least halve.
    """
    tiles = build_tiles(points, "idx", "vec", tile_rows=tile_rows)
    near, d, bound = np.full((n, NEAR), -1), np.full((n, NEAR), np.inf), np.full(n, np.inf)
    comp, links, ask = np.arange(n), [], None
    while (comp != comp[0]).any():
        x, y, found = _rows_near(points, tiles, metric, tile_rows, comp, ask)
        rows = np.arange(n) if ask is None else ask
        near[rows], d[rows] = -1, np.inf
        rank = np.arange(len(x)) - np.searchsorted(x, x)
        near[x, rank], d[x, rank] = y, found
        bound[rows] = d[rows, -1]
        while True:
            out = (near >= 0) & (comp[near] != comp[:, None])
            has, slot = out.any(axis=1), out.argmax(axis=1)
            u = np.flatnonzero(has)
            v, short = near[u, slot[u]], d[u, slot[u]]
            reach = np.full(n, np.inf)
            np.minimum.at(reach, comp[~has], bound[~has])
            low, high = np.minimum(u, v), np.maximum(u, v)
            order = np.lexsort((high, low, short, comp[u]))
            order = order[np.diff(comp[u][order], prepend=-1) != 0]
            best = np.full(n, np.inf)
            best[comp[u[order]]] = short[order]
            known = order[short[order] < reach[comp[u[order]]]]
            # Equal distances go to the lower pair of ids.
            known = known[np.lexsort((high[known], low[known], short[known]))]
            up = np.arange(n)
            for i, j, e in zip(low[known].tolist(), high[known].tolist(), short[known].tolist()):
                a, b = int(comp[i]), int(comp[j])
                while up[a] != a:
                    up[a] = a = up[up[a]]
                while up[b] != b:
                    up[b] = b = up[up[b]]
                if a != b:
                    up[max(a, b)] = min(a, b)
                    links.append((i, j, e))
            if not len(known):
                break
            while (up[up] != up).any():
                up = up[up]
            comp = up[comp]
        wants = ~has & np.isfinite(bound) & (bound <= best[comp])
        if not wants.any():
            break
        ask = np.flatnonzero(wants & (comp != np.bincount(comp).argmax()))
        ask = ask if len(ask) else np.flatnonzero(wants)
    return sorted(links, key=lambda x: (x[2], x[0], x[1]))


def _rows_near(points: DataFrame, tiles: DataFrame, metric: str, tile_rows: int, comp: np.ndarray, ask: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(x, y, d)``, by rising ``x`` and ``d``: the ``NEAR`` nearest rows outside its component of each asking row, or of all."""
    spark = points.sparkSession
    if ask is None:
        pairs = tile_pairs(tiles)
    else:
        rows = points.join(spark.createDataFrame(pa.table({"idx": pa.array(ask.astype(np.int32))})), "idx")
        asking = build_tiles(rows, "idx", "vec", tile_rows=tile_rows)
        # Numbered after the tiles of all rows.
        asking = asking.withColumn("tile", F.col("tile") + F.lit(ASKING))
        pairs = asking.select(F.col("tile").alias("a"), F.lit(0).alias("k")).join(tiles.select(F.col("tile").alias("b"), F.lit(0).alias("k")), "k").select("a", "b")
        tiles = tiles.unionByName(asking)

    def ready(tile):
        if not hasattr(tile, "limit"):
            tile.limit, tile.near, tile.d = np.full(len(tile), np.inf), np.full((len(tile), NEAR), -1, np.int64), np.full((len(tile), NEAR), np.inf)

    def kernel(a, partners):
        ready(a)
        for b in partners:
            ready(b)
            both = ask is None and a.key != b.key
            low, off = arrow.rough(a.x, b.x, metric)
            same = comp[a.ids][:, None] == comp[b.ids][None, :] if ask is not None or a.key == b.key else None
            if same is not None:
                low[same] = np.inf
            power = 2 if metric == "euclidean" else 1
            limits = []
            for tile, m in ((a, low), (b, low.T))[:1 + both]:
                limit, open_ = tile.limit ** power, np.flatnonzero(np.isinf(tile.limit))
                if len(open_) and m.shape[1] > NEAR:
                    limit[open_] = np.partition(m[open_], NEAR - 1, axis=1)[:, NEAR - 1].astype(float) + off
                limits.append(((limit + off) * (1 + 1e-6)).astype(low.dtype))
            hit = low <= limits[0][:, None]
            if both:
                hit |= low <= limits[1][None, :]
            if same is not None:
                hit &= ~same
            i, j = np.divmod(np.flatnonzero(hit), len(b))
            dense = metric == "manhattan" or 8 * len(i) > hit.size
            d = arrow.distances(a.x, b.x, metric)[i, j] if dense and metric != "manhattan" else low[i, j] if dense else arrow.listed(a.x, b.x, i, j, metric)
            _hold(a, i, b.ids[j], d)
            if both:
                _hold(b, j, a.ids[i], d)
        return iter(())

    def end(some):
        for tile in some:
            if hasattr(tile, "limit") and (ask is None or tile.key >= ASKING):
                row, slot = np.nonzero(tile.near >= 0)
                yield {"tree": np.zeros(len(row), np.int32), "x": tile.ids[row], "y": tile.near[row, slot], "d": tile.d[row, slot]}

    found = run_tiles(tiles, pairs, kernel, T.StructType.fromDDL("tree int, x int, y int, d double"), end=end)
    with released(spark):
        best = _least_near(found, len(comp) if ask is None else len(ask)).toArrow()
    best = best.take(pc.sort_indices(best, [("x", "ascending"), ("d", "ascending"), ("y", "ascending")]))
    return tuple(best.column(c).to_numpy() for c in ("x", "y", "d"))


def agglomerative(df: DataFrame, id_col: str, vector: str, linkage: str = "average", metric: str = "euclidean", **options) -> DataFrame:
    return agglomerative_many(df, id_col, vector, [(linkage, metric)], **options).drop("tree")


def cut_levels(merges: DataFrame, ids: DataFrame, ks: Sequence[int]) -> DataFrame:
    """``(tree, k, id, label, merge_height)`` for every level of every tree.

    A cut keeps the lowest ``n - k`` merges; labels run from 0 in the order of
    the least member. ``merge_height`` is the highest kept merge of the row's
    cluster, 0 for a row never merged. ``ids`` has one column. Each task cuts
    one tree, whose size ``agglomerative`` has bounded.
    """
    id_type = ids.schema[0].dataType
    ks = [int(k) for k in ks]
    schema = T.StructType(
        [T.StructField("tree", T.IntegerType()), T.StructField("k", T.IntegerType()), T.StructField("id", id_type),
         T.StructField("label", T.IntegerType()), T.StructField("merge_height", T.DoubleType())]
    )

    def run(table: pa.Table) -> pa.Table:
        tree = table.column("tree")[0].as_py()
        order = np.argsort(table.column("step").to_numpy())
        a, b = table.column("a").to_numpy()[order], table.column("b").to_numpy()[order]
        h = table.column("height").to_numpy()[order]
        names = np.unique(np.concatenate([a, b]))
        ia, ib = np.searchsorted(names, a), np.searchsorted(names, b)
        parts, n = [], len(names)
        for k in ks:
            kept = max(n - k, 0)
            up = np.arange(n)
            up[ib[:kept]] = ia[:kept]
            while True:
                on = up[up]
                if (on == up).all():
                    break
                up = on
            top = np.zeros(n)
            np.maximum.at(top, up[ia[:kept]], h[:kept])
            label = np.searchsorted(np.unique(up), up)
            parts.append({"tree": np.full(n, tree), "k": np.full(n, k), "id": names, "label": label, "merge_height": top[up]})
        return _table(parts, schema)

    with_tree = merges if "tree" in merges.columns else merges.withColumn("tree", F.lit(0))
    cut = with_tree.select("tree", "step", "a", "b", "height").groupBy("tree").applyInArrow(run, schema)
    lone = ids.select(F.col(ids.columns[0]).alias("id")).limit(2)
    # A single row has no merges; it is cluster 0 at every level.
    alone = (
        lone.agg(F.count("*").alias("n"), F.min("id").alias("id")).filter("n = 1")
        .select(F.lit(0).alias("tree"), F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"), "id", F.lit(0).alias("label"), F.lit(0.0).alias("merge_height"))
    )
    return cut.unionByName(alone)


def cut_tree(merges: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    return cut_levels(merges, ids, [k]).select("id", "label")


def merge_height(merges: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    return cut_levels(merges, ids, [k]).select("id", "merge_height")


def hier_assign(df: DataFrame, id_col: str, vector: str, linkage: str = "average", metric: str = "cosine", broad: int = 2, fine: int = 3, mode: str = "exact", **options) -> DataFrame:
    """Result rows with both levels, intra-cluster distance and confidence.

    Both levels come from one tree: over all rows, or with another ``mode``
    as ``large_levels`` builds it.
    """
    ks = sorted({broad, fine})
    if mode == "exact":
        merges = agglomerative(df, id_col, vector, linkage, metric, **options)
        cuts = cut_levels(merges, df.select(id_col), ks).select("k", "id", "label")
    else:
        cuts = large_levels(df, id_col, vector, ks, linkage, metric, mode, **options)
    cuts = snapshot(cuts, "cuts")
    level1 = cuts.filter(F.col("k") == broad).select("id", F.col("label").alias("hier_level1_id"))
    level2 = cuts.filter(F.col("k") == fine).select("id", F.col("label").alias("hier_level2_id"))
    rows = df.select(F.col(id_col).alias("id"), F.col(vector).alias("vec")).join(level2, "id")
    s = quality.silhouette_samples(rows, "id", "vec", "hier_level2_id", metric)
    return (
        level1.join(level2, "id").join(s.select("id", "intra", "silhouette"), "id")
        .select(
            F.col("id").alias("song_id"), F.lit("hierarchical").alias("algorithm"), "hier_level1_id", "hier_level2_id",
            scores.hier_distance(F.coalesce("intra", F.lit(0.0))).alias("hier_distance"),
            scores.hier_confidence(F.coalesce("silhouette", F.lit(0.0))).alias("confidence"),
        )
    )


def large_levels(df: DataFrame, id_col: str, vector: str, ks: Sequence[int], linkage: str = "average", metric: str = "euclidean", mode: str = "micro", size: int = 1000, seed: int = 42, **options) -> DataFrame:
    """``(k, id, label)`` of several levels for tables too large for an exact tree.

    sample  tree over a seeded sample; every row takes the cluster of the
            nearest sample-cluster mean
    micro   k-means with ``size`` centres; tree over the centres weighted by
            their rows; every row takes the cluster of its centre
    """
    ks = [int(k) for k in ks]
    rows = df.select(F.col(id_col).alias("id"), F.col(vector).alias("vec"))
    if metric == "cosine":
        norm = F.sqrt(V.dot("vec", "vec"))
        rows = rows.withColumn("vec", F.transform("vec", lambda x: F.when(norm > 0, x / norm).otherwise(x)))
    if mode == "micro":
        centres, _ = kmeans(rows, "id", "vec", size, n_init=1, seed=seed)
        near = point_to_centroid(rows, "vec", centres, "micro", "_d")
        near = snapshot(near.select("id", "micro"), "micro")
        counts = near.groupBy("micro").agg(F.count("*").alias("w"))
        table = df.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "micro int, vec array<double>")
        live = snapshot(table.join(counts, "micro"), "live")
        merges = agglomerative(live, "micro", "vec", linkage, metric, weight="w", **options)
        labels = cut_levels(merges, live.select("micro"), ks).select("k", F.col("id").alias("micro"), "label")
        return near.join(F.broadcast(labels), "micro").select("k", "id", "label")  # size * levels rows
    sample = snapshot(sample_n(rows, "id", size, seed), "sample")
    merges = agglomerative(sample, "id", "vec", linkage, metric, **options)
    labels = sample.join(cut_levels(merges, sample.select("id"), ks), "id")
    means = labels.groupBy("k", "label").agg(mean_vector("vec").alias("c")).orderBy("k", "label").collect()
    out = None
    for k in ks:
        centres = np.array([list(m["c"]) for m in means if m["k"] == k])
        one = point_to_centroid(rows, "vec", centres, "label", "_d").select(F.lit(k).alias("k"), "id", "label")
        out = one if out is None else out.union(one)
    return out


def hier_large(df: DataFrame, id_col: str, vector: str, k: int, linkage: str = "average", metric: str = "euclidean", mode: str = "micro", size: int = 1000, seed: int = 42, **options) -> DataFrame:
    """``(id, label)`` of one level; see ``large_levels``."""
    return large_levels(df, id_col, vector, [k], linkage, metric, mode, size, seed, **options).select("id", "label")


def selection_grid(ks: Sequence[int]) -> list[tuple[int, str, str]]:
    """Every (k, linkage, metric) tried by ``hier_select``."""
    grid = []
    for k in ks:
        grid.append((k, "ward", "euclidean"))
        grid += [(k, linkage, metric) for linkage in ("complete", "average") for metric in ("euclidean", "manhattan", "cosine")]
    return grid


def hier_select(df: DataFrame, id_col: str, vector: str, ks: Sequence[int] | None = None, max_samples: int | None = None, seed: int = 42, **options) -> DataFrame:
    """Scores of all settings, from one tree per linkage and metric.

    ``(cfg, k, linkage, metric, silhouette, calinski_harabasz,
    davies_bouldin, balance, composite, sizes, quality)``. All rows are
    scored, or a seeded sample of ``max_samples``.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.col(vector).alias("vec"))
    work = snapshot(rows if max_samples is None else sample_n(rows, "id", max_samples, seed), "sample")
    n = work.count()
    ks = [min(k, n - 1) for k in (ks or range(3, min(11, n)))]
    grid = [g for g in selection_grid(ks) if g[0] >= 2]
    trees = sorted({(l, m) for _, l, m in grid})
    merges = snapshot(agglomerative_many(work, "id", "vec", trees, **options), "merges")
    cuts = cut_levels(merges, work.select("id"), sorted(set(ks)))
    table = spark.createDataFrame([(i, k, l, m, trees.index((l, m))) for i, (k, l, m) in enumerate(grid)], "cfg int, k int, linkage string, metric string, tree int")
    labels = snapshot(cuts.join(F.broadcast(table), ["tree", "k"]).select("cfg", "id", "label", "metric"), "labels")
    sil = None
    for metric in sorted({m for _, _, m in grid}):
        mine = [i for i, g in enumerate(grid) if g[2] == metric]
        local = spark.createDataFrame([(c, i) for i, c in enumerate(mine)], "cfg int, slot int")
        some = labels.filter(F.col("metric") == metric).join(F.broadcast(local), "cfg").select(F.col("slot").alias("cfg"), "id", "label")
        got = quality.mean_silhouette(quality.silhouette_many(work, "id", "vec", some, metric, options.get("tile_rows", TILE_ROWS)), ["cfg"])
        part = got.withColumnRenamed("cfg", "slot").join(F.broadcast(local), "slot").select("cfg", "silhouette")
        sil = part if sil is None else sil.union(part)
    # Joined anew by each score: stored, every row would be there once for each setting.
    scored = work.join(labels.select("cfg", "id", "label"), "id")
    ch = quality.calinski_harabasz(scored, "vec", "label", ["cfg"]).select("cfg", "calinski_harabasz")
    db = quality.davies_bouldin(scored, "vec", "label", ["cfg"]).select("cfg", "davies_bouldin")
    sizes = labels.groupBy("cfg", "label").agg(F.count("*").alias("n")).groupBy("cfg").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("label", "n"))), lambda s: s["n"]).alias("sizes"),
        (F.min("n") / F.max("n")).alias("balance"),
    )
    return (
        table.drop("tree").join(sil, "cfg").join(ch, "cfg").join(db, "cfg").join(sizes, "cfg")
        .withColumn("composite", scores.composite_score("silhouette", "balance"))
        .withColumn("quality", scores.balance_quality("silhouette", "balance"))
    )


def hier_final(df: DataFrame, id_col: str, vector: str, k: int, linkage: str, metric: str, mode: str = "exact", **options) -> DataFrame:
    """``(id, label)`` of the chosen setting on the whole table."""
    if mode != "exact":
        return hier_large(df, id_col, vector, k, linkage, metric, mode, **options)
    merges = agglomerative(df, id_col, vector, linkage, metric, **options)
    return cut_tree(merges, df.select(id_col), k)
