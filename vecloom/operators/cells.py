"""Recursive cells of nearby vectors, and the pairs of cells that may hold near rows.

A cell with more rows than fit a tile is split: a few far-apart rows of it become pivots, and each row goes to its nearest one. The
pivots of a level are a table and meet their rows in bounded groups, so the number of cells may grow with the rows. A cell's code holds
its path, five bits a level.

Every cell has a ball around its rows, every inner node one around its children. Pairs are found from the root down: a pair of nodes
goes on to its children only while their balls are near enough, so pairs of tiles that are far apart are never listed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vecloom.functions import arrow
from vecloom.functions.vectors import _total
from vecloom.session import snapshot

#: Children of a cell at most, rows its pivots are chosen from, rows that meet their pivots in one group, and levels.
FAN, CHOICE, GROUP, LEVELS = 16, 256, 8192, 8
#: Room in a tile's number for the parts of a cell whose rows are all alike.
PARTS = 20


def _fan(n, tile_rows: int) -> Column:
    """Children of a cell of ``n`` rows: so many that they fill half a tile each."""
    return F.least(F.lit(FAN), F.greatest(F.lit(2), F.ceil(2 * n / F.lit(tile_rows)))).cast("int")


def _spread(x: np.ndarray, k: int, metric: str) -> np.ndarray:
    """``k`` rows of ``x`` or fewer, each the farthest from those before; equal rows count once."""
    picked = [0]
    near = arrow.distances(x[:1], x, metric)[0]
    while len(picked) < k and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, arrow.distances(x[picked[-1:]], x, metric)[0])
    return x[picked]


def split(rows: DataFrame, n: int, metric: str, tile_rows: int) -> tuple[DataFrame, int]:
    """``rows`` (with ``id``, ``vec``) and ``code`` and ``part``, and the levels of the codes: a part has at most about ``tile_rows`` rows.

    ``metric``: ``euclidean`` or ``manhattan``. Pivots come from the rows of least hash of a cell. A cell whose rows are alike there is
    not split further, but cut into parts by a hash of the id.
    """
    rows, depth, ready = rows.withColumn("code", F.lit(0).cast("long")), 0, []
    many = n > tile_rows
    order = [F.xxhash64("id"), F.col("id")]
    # The last number of a level says that a cell's rows are alike.
    alike = F.pmod("code", F.lit(32)) == 31
    while many and depth < LEVELS:
        sizes = rows.groupBy("code").agg(F.count("*").alias("_n")).where((F.col("_n") > tile_rows) & ~alike)
        # Large cells are at most one row for ``tile_rows`` rows.
        large = rows.join(F.broadcast(sizes), "code")
        first = large.withColumn("_rn", F.row_number().over(Window.partitionBy("code").orderBy(*order))).where(F.col("_rn") <= CHOICE)

        def choose(key, table):
            x = arrow.matrix(table.column("vec"))
            k = min(FAN, max(2, math.ceil(2 * table.column("_n")[0].as_py() / tile_rows)))
            pivots = _spread(x, k, metric)
            return pa.table({"code": pa.array([key[0].as_py()], pa.int64()), "pivots": pa.array([pivots.ravel()], pa.list_(pa.float64())), "n": pa.array([table.column("_n")[0].as_py()], pa.int64())})

        chosen = first.select("code", "vec", "_n").groupBy("code").applyInArrow(choose, "code long, pivots array<double>, n long")
        chosen = snapshot(chosen, "pivots")
        # Rows of a cell meet its pivots in groups of bounded size.
        groups = F.ceil(F.col("n") / F.lit(GROUP)).cast("int")
        at = chosen.select("code", F.posexplode(F.sequence(F.lit(0), groups - 1)).alias("group", "_"), "pivots").drop("_")
        sized = large.withColumn("group", F.pmod(F.xxhash64("id"), F.ceil(F.col("_n") / F.lit(GROUP))).cast("int")).drop("_n")
        schema = T.StructType([*rows.schema.fields])

        def assign(table: pa.Table, pivots: pa.Table) -> pa.Table:
            x = arrow.matrix(table.column("vec"))
            p = arrow.matrix(pivots.column("pivots")).reshape(-1, x.shape[1])
            child = arrow.distances(x, p, metric).argmin(axis=1) if len(p) > 1 else np.full(len(x), 31)
            code = table.column("code").to_numpy() * 32 + child
            return table.select(schema.names).set_column(schema.names.index("code"), "code", pa.array(code))

        moved = sized.groupBy("code", "group").cogroup(at.groupBy("code", "group")).applyInArrow(assign, schema)
        # Rows of other cells stay where they are stored.
        if depth:
            ready.append((depth, rows.join(F.broadcast(chosen.select("code")), "code", "left_anti")))
        rows, depth = snapshot(moved, "cells"), depth + 1
        many = not rows.groupBy("code").count().where((F.col("count") > tile_rows) & ~alike).isEmpty()
    if not depth:
        return rows.withColumn("part", F.lit(0)), depth
    for level, rest in ready:
        # The path goes on as the first child's, or as rows that are alike.
        wide = 32 ** (depth - level)
        rows = rows.unionByName(rest.withColumn("code", F.col("code") * F.lit(wide) + F.when(alike, F.lit(wide - 1)).otherwise(F.lit(0))))
    sizes = rows.groupBy("code").agg(F.ceil(F.count("*") / F.lit(tile_rows)).alias("_n"))
    return rows.join(F.broadcast(sizes), "code").withColumn("part", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int")).drop("_n"), depth


def ball(x: np.ndarray, metric: str) -> tuple[np.ndarray, float]:
    """Centre and radius of rows; the radius is never too small."""
    centre = x.mean(axis=0, keepdims=True)
    return centre[0], float(arrow.distances(centre, x, metric).max()) * (1 + 1e-9) + 1e-9


def _gap(a: str, b: str, metric: str) -> Column:
    parts = F.zip_with(a, b, lambda x, y: x - y)
    if metric == "manhattan":
        return _total(F.transform(parts, F.abs))
    return F.sqrt(_total(F.transform(parts, lambda g: g * g)))


def near_pairs(tiles: DataFrame, metric: str, reach: float | None = None) -> DataFrame:
    """Tile pairs ``(a, b)`` whose balls come as near as ``reach``, each once with ``a <= b``.

    Without ``reach``, ``tiles`` has a column ``reach``, and both orders are pairs of their own: those with a row of ``b`` perhaps within
    the reach of ``a``. ``tiles``: ``(tile, code, depth, centre, radius)``.
    """
    ordered = reach is None
    nodes = tiles.select("tile", "code", "centre", "radius", F.col("reach") if ordered else F.lit(float(reach) * (1 + 1e-9) + 1e-9).alias("reach"), "depth")
    depth = nodes.agg(F.max("depth")).first()[0] or 0
    schema = "node long, code long, centre array<double>, radius double, reach double"
    level = nodes.select(F.col("tile").alias("node"), F.shiftright("code", 5).alias("code"), "centre", "radius", "reach")
    levels = [level]

    def around(key, table):
        centres, radius = arrow.matrix(table.column("centre")), table.column("radius").to_numpy()
        centre = centres.mean(axis=0, keepdims=True)
        far = float((arrow.distances(centre, centres, metric)[0] + radius).max()) * (1 + 1e-9) + 1e-9
        code = key[0].as_py()
        return pa.table([pa.array([code]), pa.array([code >> 5]), arrow.vectors(centre), pa.array([far]), pa.array([float(table.column("reach").to_numpy().max())])], names=["node", "code", "centre", "radius", "reach"])

    for _ in range(depth - 1):
        levels.append(snapshot(levels[-1].groupBy("code").applyInArrow(around, schema), "balls"))
    pairs = None
    for level in reversed(levels):
        a = level.select(F.col("code").alias("pa"), F.col("node").alias("a"), F.col("centre").alias("ca"), F.col("radius").alias("ra"), "reach")
        b = level.select(F.col("code").alias("pb"), F.col("node").alias("b"), F.col("centre").alias("cb"), F.col("radius").alias("rb"))
        met = a.join(b, F.col("pa") == F.col("pb")) if pairs is None else pairs.join(a, "pa").join(b, "pb")
        if not ordered:
            met = met.where("pa < pb OR a <= b")
        met = met.where(_gap("ca", "cb", metric) - F.col("ra") - F.col("rb") <= F.col("reach"))
        pairs = met.select(F.col("a").alias("pa"), F.col("b").alias("pb"))
    return pairs.select(F.col("pa").alias("a"), F.col("pb").alias("b"))
