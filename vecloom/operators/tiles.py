"""All-pairs work in bounded square tiles.

Rows are packed into tiles of at most ``tile_rows`` vectors. A task gets two
blocks of tiles, so that a tile travels once for a block it meets and not once
for a tile, forms the distances with a matrix product, and emits only what the
caller reduces them to (pairs within eps, counts, nearest rows, sums per
cluster). Where only near rows matter, a tile is a cell of nearby rows
(``cells``), and pairs of tiles that lie too far apart are never listed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vecloom.functions import arrow
from vecloom.functions.vectors import _total
from vecloom.operators import cells
from vecloom.session import snapshot

TILE_ROWS = 2048
#: Tiles of a block at most, and bytes of results that a task gathers before it hands them on.
PARTNERS = 32
BATCH_BYTES = 8 << 20
HOT_SHARE = 1000


def build_tiles(df: DataFrame, id_col: str, vector: str, carry: Sequence[str] = (), metric: str = "euclidean", tile_rows: int = TILE_ROWS, pivots: bool = False) -> DataFrame:
    """Pack rows into tiles: ``(tile, n, ids, mat, code, depth, centre, radius, <carry>...)``.

    ``mat`` holds the vectors row by row as ``arrow.packed`` writes them. For the
    cosine metric the vectors are normalised here, so that the euclidean
    distance of tile rows is ``sqrt(2 * cosine distance)``. With ``pivots``
    tiles are cells of nearby rows; else rows are dealt by a hash of the id.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(vector).alias("vec"), *carry)
    if metric == "cosine":
        norm = F.sqrt(_total(F.transform("vec", lambda x: x * x)))
        rows = rows.withColumn("_norm", norm).withColumn(
            "vec", F.transform("vec", lambda x: F.when(F.col("_norm") > 0, x / F.col("_norm")).otherwise(x))
        ).drop("_norm")
    n, shape = rows.count(), _shape(metric)
    if pivots:
        rows, depth = cells.split(rows, n, shape, tile_rows)
    else:
        rows, depth = rows.withColumn("code", F.lit(0).cast("long")).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(max(1, math.ceil(n / tile_rows)))).cast("int")), 0
    id_type = rows.schema["id"].dataType
    schema = T.StructType(
        [
            T.StructField("tile", T.LongType()),
            T.StructField("n", T.IntegerType()),
            T.StructField("ids", T.ArrayType(id_type)),
            T.StructField("mat", T.BinaryType()),
            T.StructField("code", T.LongType()),
            T.StructField("depth", T.IntegerType()),
            T.StructField("centre", T.ArrayType(T.DoubleType())),
            T.StructField("radius", T.DoubleType()),
            *[T.StructField(c, T.ArrayType(rows.schema[c].dataType)) for c in carry],
        ]
    )
    carry = list(carry)

    def pack(key, table):
        table = table.take(pc.sort_indices(table.column("id")))
        code, x = key[0].as_py(), arrow.matrix(table.column("vec"))
        one = lambda col: pa.array([col.combine_chunks().to_pylist()], type=pa.list_(col.type))
        centre, radius = cells.ball(x, shape)
        cols = [
            pa.array([(code << cells.PARTS) + key[1].as_py()], pa.int64()), pa.array([len(x)], pa.int32()), one(table.column("id")),
            pa.array([arrow.packed(x)], pa.binary()), pa.array([code], pa.int64()), pa.array([depth], pa.int32()),
            arrow.vectors(centre[None, :]), pa.array([radius]), *[one(table.column(c)) for c in carry],
        ]
        return pa.table(cols, names=[f.name for f in schema.fields])

    return snapshot(rows.groupBy("code", "part").applyInArrow(pack, schema), "tiles")


def _shape(metric: str) -> str:
    """Distance between tile rows; cosine tiles hold unit vectors."""
    return "euclidean" if metric == "cosine" else metric


def tile_pairs(tiles: DataFrame, radius: float | None = None, ordered: bool = False, metric: str = "euclidean") -> DataFrame:
    """Tile pairs to visit, ``(a, b)``; one row per pair of tiles.

    ``radius`` leaves pairs out whose balls lie further apart. ``ordered``
    yields both (a, b) and (b, a); otherwise each pair once with a <= b.
    Only tile descriptions take part: one small row per ``tile_rows`` rows.
    """
    if radius is not None:
        return cells.near_pairs(tiles, _shape(metric), radius)
    own = tiles.select(F.col("tile").alias("a"), F.lit(0).alias("k"))
    pairs = own.join(own.select(F.col("a").alias("b"), "k"), "k").select("a", "b")
    return pairs if ordered else pairs.where("a <= b")


class Tile:
    """One unpacked tile inside a task."""

    def __init__(self, table: pa.Table, row: int, carry: Sequence[str]):
        self.key = table.column("tile")[row].as_py()
        n = table.column("n")[row].as_py()
        self.x = arrow.unpacked(table.column("mat")[row].as_py(), n)
        self._ids = table.column("ids")[row].values
        self.ids = self._ids.to_numpy(zero_copy_only=False)
        self.extra = {c: table.column(c)[row].values for c in carry}

    def __len__(self):
        return len(self.x)


def block_tiles(count: int, cores: int) -> int:
    """Tiles of a block: fewer while there would be too few pairs of blocks to keep the cores busy."""
    return max(1, min(PARTNERS, count // math.ceil(math.sqrt(12 * cores))))


def run_tiles(tiles: DataFrame, pairs: DataFrame, kernel: Callable, schema: T.StructType, carry: Sequence[str] = (), order: Sequence[str] = ("tile",), fold: Callable | None = None, end: Callable | None = None) -> DataFrame:
    """Run ``kernel(a, partners)`` for each tile and those of its partners that share a block.

    ``kernel`` yields column dicts (name -> numpy or Arrow array). Tiles that
    follow each other in ``order`` form blocks of up to ``PARTNERS``; a task
    gets two blocks and the pairs between them. Blocks are smaller while there
    would be too few pairs of them to keep the cores busy. ``fold(table)``
    shortens what a task has gathered to a table that says the same; ``end``
    as for ``run_blocks``.
    """
    count = tiles.count()
    if not count:
        return tiles.sparkSession.createDataFrame([], schema)
    spark = tiles.sparkSession
    cores = spark.sparkContext.defaultParallelism
    wide = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * cores)
    n = math.ceil(count / block_tiles(count, cores))
    described = tiles.select("tile", *[c for c in order if c != "tile"])
    block = snapshot(described.repartitionByRange(n, *order).select("tile", F.spark_partition_id().alias("block")), "blocks")
    met = pairs.select("a", "b").join(block.select(F.col("tile").alias("a"), F.col("block").alias("left")), "a")
    met = met.join(block.select(F.col("tile").alias("b"), F.col("block").alias("right")), "b")
    # Two blocks meet in one task, whichever of them a pair begins in, and each of their tiles travels there once.
    met = met.select("a", "b", F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"))
    sides = F.explode(F.array(F.struct(F.col("a").alias("tile"), F.col("b").alias("mate")), F.struct(F.col("b").alias("tile"), F.lit(None).cast("bigint").alias("mate"))))
    # At most two blocks of partners for a tile.
    mates = F.sort_array(F.collect_list("mate"))
    roles = met.select("left", "right", sides.alias("s")).select("left", "right", "s.*").groupBy("left", "right", "tile").agg(F.when(F.count("mate") > 0, mates).alias("mates"))
    return run_blocks(tiles, snapshot(roles, "met"), min(n * n, wide), kernel, schema, carry, fold, *([end] if end else []))


def run_blocks(tiles: DataFrame, roles: DataFrame, slices: int, kernel: Callable, schema: T.StructType, carry: Sequence[str] = (), fold: Callable | None = None, end: Callable | None = None) -> DataFrame:
    """``run_tiles`` with ``roles`` ``(left, right, tile, mates)``: the tiles of every pair of blocks, and the partners of those that have some.

    ``end(tiles)`` yields what the kernel has left with the tiles of a pair of blocks.
    """
    carry = list(carry)
    work = roles.join(tiles.select("tile", "n", "ids", "mat", *carry), "tile")
    names = [f.name for f in schema.fields]
    target = T.StructType(schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(target)
        table = pa.Table.from_batches(batches).combine_chunks()
        mates = table.column("mates").to_pylist()
        opened = {}
        for i, key in enumerate(table.column("tile").to_pylist()):
            if key not in opened:
                opened[key] = Tile(table, i, carry)
        parts, held = [], 0
        asking = sorted((k, m) for k, m in zip(table.column("tile").to_pylist(), mates) if m is not None)
        steps = [partial(kernel, opened[key], [opened[b] for b in partners]) for key, partners in asking]
        for step in [*steps, partial(end, list(opened.values()))] if end else steps:
            for cols in step():
                parts.append(pa.table([pa.array(cols[c]) if not isinstance(cols[c], pa.Array) else cols[c] for c in names], names=names).cast(wanted))
                held += parts[-1].nbytes
                if held > BATCH_BYTES and fold:
                    parts = [fold(pa.concat_tables(parts)).cast(wanted)]
                    # Gather as much again as is left, so that the folds stay in proportion.
                    held = min(0, BATCH_BYTES - parts[0].nbytes)
                elif held > BATCH_BYTES:
                    yield from pa.concat_tables(parts).combine_chunks().to_batches()
                    parts, held = [], 0
        done = pa.concat_tables([wanted.empty_table(), *parts])
        yield from (fold(done).cast(wanted) if fold else done).combine_chunks().to_batches()

    # A fixed number of slices: the groups are heavy in work, not in bytes, and
    # must not be merged into few tasks by size.
    return work.repartition(slices, "left", "right").groupBy("left", "right").applyInArrow(run, schema)


def prune_radius(eps: float, metric: str) -> float:
    """Radius between tile rows that covers ``eps``; cosine tiles hold unit vectors."""
    return math.sqrt(2.0 * eps) if metric == "cosine" else eps


def collapse_copies(df: DataFrame, id_col: str, vector: str) -> tuple[DataFrame, DataFrame | None]:
    """``(representatives (id, vec, weight), members (id, rep) or None)``.

    Grouping combines on the map side, so a vector that fills a third of the
    table still reaches the reducer as one row per task. ``None`` means that
    there are no copies.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(vector).alias("vec"))
    reps = snapshot(rows.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").cast("double").alias("weight")), "reps")
    totals = reps.agg(F.count("*").alias("reps"), F.sum("weight").alias("rows")).head()
    if not totals["reps"] or totals["reps"] == totals["rows"]:
        return reps, None
    # Vectors that fill over a thousandth of the table (so under a thousand of
    # them) are matched by broadcast; no key of the shuffled rest is hot.
    least = totals["rows"] / HOT_SHARE
    named = reps.select("vec", F.col("id").alias("rep"), "weight")
    hot = F.broadcast(named.filter(F.col("weight") > least).drop("weight"))
    cold = named.filter(F.col("weight") <= least).drop("weight")
    members = rows.join(hot, "vec").select("id", "rep").union(
        rows.join(hot.select("vec"), "vec", "left_anti").join(cold, "vec").select("id", "rep")
    )
    return reps, members


def copies(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """``(id, rep)`` of every row whose vector another row has: ``rep`` is the least id with that vector, which stands for it in ``eps_join``."""
    reps, members = collapse_copies(df, id_col, vector)
    if members is None:
        return reps.select("id", F.col("id").alias("rep")).limit(0)
    return members.join(reps.where("weight > 1").select(F.col("id").alias("rep")), "rep").select("id", "rep")


def eps_join(df: DataFrame, id_col: str, vector: str, eps: float, metric: str = "euclidean", collapse: bool = True, tile_rows: int = TILE_ROWS) -> DataFrame:
    """All pairs at distance ``<= eps``: ``(id_a, id_b, distance, n_a, n_b)``; ``copies`` tells whom a row stands for.

    ``id_a < id_b``. Equal vectors stand as one row, named by their least id
    and counted in ``n_a`` and ``n_b``; a row with ``id_a = id_b`` tells that
    the vector occurs more than once. A group of m copies thus gives one row
    and not m * m. ``collapse=False`` lists every pair of ids instead, without
    the counts.
    """
    id_type = df.schema[id_col].dataType
    fields = [T.StructField("id_a", id_type), T.StructField("id_b", id_type), T.StructField("distance", T.DoubleType())]
    carry, source = [], df.select(F.col(id_col).alias("id"), F.col(vector).alias("vec"))
    if collapse:
        source, _ = collapse_copies(df, id_col, vector)
        carry = ["weight"]
        fields += [T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType())]
    schema = T.StructType(fields)
    tiles = build_tiles(source, "id", "vec", carry=carry, metric=metric, tile_rows=tile_rows, pivots=True)

    def kernel(a, partners):
        for b in partners:
            d = arrow.distances(a.x, b.x, metric, [eps])
            hit = d <= eps
            if a.key == b.key:
                hit = np.triu(hit, 1)
            i, j = np.nonzero(hit)
            left, right = a.ids[i], b.ids[j]
            swap = left > right
            out = {"id_a": np.where(swap, right, left), "id_b": np.where(swap, left, right), "distance": d[i, j]}
            if collapse:
                n, m = a.extra["weight"].to_numpy()[i], b.extra["weight"].to_numpy()[j]
                out.update(n_a=np.where(swap, m, n).astype(np.int64), n_b=np.where(swap, n, m).astype(np.int64))
            yield out

    pairs = run_tiles(tiles, tile_pairs(tiles, prune_radius(eps, metric), metric=metric), kernel, schema, carry=carry)
    if not collapse:
        return pairs
    n = F.col("weight").cast("bigint")
    copies = source.filter("weight > 1").select(F.col("id").alias("id_a"), F.col("id").alias("id_b"), F.lit(0.0).alias("distance"), n.alias("n_a"), n.alias("n_b"))
    return pairs.unionByName(copies)


def pairwise_distances(df: DataFrame, id_col: str, vector: str, metric: str = "euclidean", tile_rows: int = TILE_ROWS) -> DataFrame:
    """The distance matrix in row pieces: ``(id, tile, ids, distances)``.

    A row of the matrix comes in pieces of at most ``tile_rows`` entries, so
    it is never one unbounded value; ``ids`` names the columns of the piece.
    """
    tiles = build_tiles(df, id_col, vector, tile_rows=tile_rows)
    id_type = df.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("id", id_type),
            T.StructField("tile", T.LongType()),
            T.StructField("ids", T.ArrayType(id_type)),
            T.StructField("distances", T.ArrayType(T.DoubleType())),
        ]
    )

    def kernel(a, partners):
        for b in partners:
            d = arrow.distances(a.x, b.x, metric)
            if a.key == b.key:
                np.fill_diagonal(d, 0.0)
            offsets = pa.array(np.arange(len(a) + 1, dtype=np.int32) * len(b))
            columns = pa.ListArray.from_arrays(offsets, b._ids.take(pa.array(np.tile(np.arange(len(b)), len(a)))))
            yield {"id": a._ids, "tile": np.full(len(a), b.key), "ids": columns, "distances": arrow.vectors(d)}

    return run_tiles(tiles, tile_pairs(tiles, ordered=True), kernel, schema)


def _nearest(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the ``k`` least entries per row, ties by id."""
    k = min(k, d.shape[1])
    if k <= 0:
        return np.zeros(0, int), np.zeros(0, int)
    pick = np.argpartition(d, k - 1, axis=1)[:, :k]
    kth = np.take_along_axis(d, pick, 1).max(axis=1)
    tied = np.nonzero((d <= kth[:, None]).sum(axis=1) > k)[0]
    rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    for r in tied:
        pick[r] = np.lexsort((rank, d[r]))[:k]
    rows = np.repeat(np.arange(len(d)), k)
    cols = pick.ravel()
    keep = np.isfinite(d[rows, cols])
    return rows[keep], cols[keep]


def _better(old: tuple[np.ndarray, np.ndarray], d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` nearest of each row among those held and those of ``d``, ties by id."""
    rows, cols = _nearest(d, ids, k)
    kept_d, kept_i = np.full((len(d), k), np.inf), np.zeros((len(d), k), dtype=ids.dtype)
    slot = np.arange(len(rows)) - np.searchsorted(rows, rows)
    kept_d[rows, slot], kept_i[rows, slot] = d[rows, cols], ids[cols]
    all_d, all_i = np.hstack([old[0], kept_d]), np.hstack([old[1], kept_i])
    order = np.lexsort((np.argsort(np.argsort(all_i, axis=1), axis=1), all_d), axis=1)[:, :k]
    return np.take_along_axis(all_d, order, 1), np.take_along_axis(all_i, order, 1)


def nearest_pairs(tiles: DataFrame, k: int, metric: str = "euclidean", skip_zero: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(candidates, pairs)`` after each tile has searched itself.

    ``candidates`` (``tile``, ``id``, ``bound``, ``neighbour``, ``distance``): the nearest rows of the row's own tile; ``bound`` is its
    ``k``-th distance there, infinite if the tile has too few. ``pairs``: other tiles that may hold a row within the largest bound of a
    tile's rows. The distance of cosine rows is that of the unit vectors.
    """
    id_type, shape = tiles.schema["ids"].dataType.elementType, _shape(metric)
    fields = [("tile", T.LongType()), ("id", id_type), ("bound", T.DoubleType()), ("neighbour", id_type), ("distance", T.DoubleType())]

    def own(a, _):
        d = arrow.distances(a.x, a.x, shape)
        if skip_zero:
            d[d <= 0] = np.inf
        np.fill_diagonal(d, np.inf)
        best_d, best_i = _better((np.zeros((len(a), 0)), np.zeros((len(a), 0), dtype=a.ids.dtype)), d, a.ids, k)
        rows, cols = np.nonzero(np.isfinite(best_d))
        bound = best_d[:, -1] if best_d.shape[1] else np.full(len(a), np.inf)
        # A row without candidates still tells that its bound is infinite.
        lone = np.flatnonzero(~np.isfinite(best_d).any(axis=1))
        at = np.concatenate([rows, lone])
        yield {
            "tile": np.full(len(at), a.key), "id": a.ids[at], "bound": bound[at], "neighbour": np.concatenate([best_i[rows, cols], a.ids[lone]]),
            "distance": np.concatenate([best_d[rows, cols], np.full(len(lone), np.inf)]),
        }

    same = tiles.select(F.col("tile").alias("a"), F.col("tile").alias("b"))
    candidates = snapshot(run_tiles(tiles, same, own, T.StructType([T.StructField(*f) for f in fields])), "candidates")
    reach = candidates.groupBy("tile").agg((F.max("bound") * (1 + 1e-9) + 1e-9).alias("reach"))
    pairs = cells.near_pairs(tiles.join(reach, "tile"), shape).where("a <> b")
    return candidates, snapshot(pairs, "pairs")


def knn_join(df: DataFrame, id_col: str, vector: str, k: int, metric: str = "euclidean", skip_zero: bool = False, tile_rows: int = TILE_ROWS) -> DataFrame:
    """The ``k`` nearest other rows of every row: ``(id, neighbour, distance, rank)``.

    ``skip_zero`` ignores rows at distance 0. Two rounds: each tile searches
    itself, which bounds its rows' k-th distances; then it searches only tiles
    whose ball comes nearer than that, with those of its rows that it may help.
    Every task reduces its tiles to ``k`` candidates per row before anything is
    shuffled.
    """
    id_type = df.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField("id", id_type), T.StructField("neighbour", id_type), T.StructField("distance", T.DoubleType())]
    )
    w = Window.partitionBy("id").orderBy("distance", "neighbour")
    if metric == "cosine":
        # Zero vectors are at distance 1 from all, which no ball tells: all tiles meet.
        tiles = build_tiles(df, id_col, vector, tile_rows=tile_rows)

        def every(a, partners):
            best = np.zeros((len(a), 0)), np.zeros((len(a), 0), dtype=a.ids.dtype)
            for b in partners:
                d = arrow.distances(a.x, b.x, metric)
                if skip_zero:
                    d[d <= 0] = np.inf
                if a.key == b.key:
                    np.fill_diagonal(d, np.inf)
                best = _better(best, d, b.ids, k)
            rows, cols = np.nonzero(np.isfinite(best[0]))
            yield {"id": a.ids[rows], "neighbour": best[1][rows, cols], "distance": best[0][rows, cols]}

        found = run_tiles(tiles, tile_pairs(tiles, ordered=True), every, schema)
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    tiles = build_tiles(df, id_col, vector, metric=metric, tile_rows=tile_rows, pivots=True)
    found, pairs = nearest_pairs(tiles, k, metric, skip_zero)
    # At most tile_rows entries per tile.
    held = found.groupBy("tile", "id").agg(F.max("bound").alias("bound")).groupBy("tile").agg(F.sort_array(F.collect_list(F.struct("id", "bound"))).alias("bounds"))
    bounded = tiles.join(held.select("tile", F.col("bounds.bound").alias("bounds")), "tile")

    def kernel(a, partners):
        bounds = a.extra["bounds"].to_numpy()
        best = np.zeros((len(a), 0)), np.zeros((len(a), 0), dtype=a.ids.dtype)
        for b in partners:
            centre, radius = cells.ball(b.x, metric)
            rows = np.flatnonzero(arrow.distances(a.x, centre[None, :], metric)[:, 0] - radius <= bounds * (1 + 1e-9) + 1e-9)
            d = np.full((len(a), len(b)), np.inf)
            d[rows] = arrow.distances(a.x[rows], b.x, metric)
            if skip_zero:
                d[d <= 0] = np.inf
            best = _better(best, d, b.ids, k)
        rows, cols = np.nonzero(np.isfinite(best[0]))
        yield {"id": a.ids[rows], "neighbour": best[1][rows, cols], "distance": best[0][rows, cols]}

    near = found.where(F.col("distance") < float("inf")).select("id", "neighbour", "distance")
    candidates = near.unionByName(run_tiles(bounded, pairs, kernel, schema, carry=["bounds"]))
    return candidates.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
