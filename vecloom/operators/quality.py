"""Exact cluster-quality metrics.

Functions take one table ``(id, vector, label)``; those that score several
labelings at once take labels in long form ``(cfg, id, label)``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vecloom.functions import arrow, scores
from vecloom.functions import vectors as V
from vecloom.operators.aggregates import running_total
from vecloom.operators.tiles import TILE_ROWS, build_tiles, run_tiles, tile_pairs
from vecloom.session import discard, snapshot, stored

#: Clusters whose sums a task holds at a time, and large clusters of a labeling up to which their tiles meet once and give sums to both.
RUN_LABELS = 1 << 14
BOTH_SIDES = 64
#: Rows of a cluster from which sorting its columns is cheaper than all differences.
SORTED_ROWS = 64


def one_row(*parts: DataFrame) -> DataFrame:
    """Columns of several one-row frames in one row."""
    stacked = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns])


def cluster_sizes(labels: DataFrame, label: str, group: Sequence[str] = ()) -> DataFrame:
    """Rows per cluster and their share in percent."""
    sizes = labels.groupBy(*group, label).agg(F.count("*").alias("size"))
    # The window runs over one row per cluster, not over the data.
    total = F.sum("size").over(Window.partitionBy(*group))
    return sizes.withColumn("pct", F.col("size") * 100.0 / total)


pct_of_total = cluster_sizes


def cluster_size_metrics(labels: DataFrame, label: str, group: Sequence[str] = ()) -> DataFrame:
    sizes = labels.groupBy(*group, label).agg(F.count("*").alias("size"))
    cv = F.try_divide(F.col("std_size"), F.col("mean_size"))
    return (
        sizes.groupBy(*group)
        .agg(
            F.count("*").alias("cluster_count"),
            F.sum("size").alias("total_points"),
            F.min("size").alias("min_size"),
            F.max("size").alias("max_size"),
            F.avg("size").alias("mean_size"),
            F.stddev_pop("size").alias("std_size"),
            F.percentile("size", 0.5).alias("median_size"),
        )
        .withColumn("expected_size", F.col("total_points") / F.col("cluster_count"))
        .withColumn("coefficient_of_variation", cv)
        .withColumn("balance_score", 1.0 / (1.0 + F.col("coefficient_of_variation")))
    )


def cluster_statistics(labels: DataFrame, label: str, group: Sequence[str] = ()) -> DataFrame:
    """Size statistics with the clipped balance ``1 - std / expected``."""
    sizes = labels.groupBy(*group, label).agg(F.count("*").alias("size"))
    stats = sizes.groupBy(*group).agg(
        F.count("*").alias("num_clusters"),
        F.sum("size").alias("total_points"),
        F.min("size").alias("min_cluster_size"),
        F.max("size").alias("max_cluster_size"),
        F.avg("size").alias("mean_cluster_size"),
        F.stddev_pop("size").alias("std_cluster_size"),
    )
    raw = 1.0 - F.col("std_cluster_size") / (F.col("total_points") / F.col("num_clusters"))
    return stats.withColumn("clipped_balance", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def validate_labels(labels: DataFrame, label: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """One row of checks; ``valid`` needs rows, no negative label, and the range."""
    c = F.col(label)
    facts = labels.agg(
        F.count("*").alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi"), F.count_distinct(c).alias("k")
    )
    in_range = F.lit(True) if low is None else (F.col("lo") >= low) & (F.col("hi") <= high)
    return facts.select(
        (F.col("n") > 0).alias("non_empty"),
        F.coalesce(F.col("lo") >= 0, F.lit(False)).alias("non_negative"),
        F.coalesce((F.col("lo") == 0) & (F.col("hi") == F.col("k") - 1), F.lit(False)).alias("contiguous"),
        F.coalesce(in_range, F.lit(False)).alias("in_range"),
    ).withColumn("valid", F.col("non_empty") & F.col("non_negative") & F.col("in_range"))


def cluster_moments(df: DataFrame, vector: str, label: str, group: Sequence[str] = ()) -> DataFrame:
    """Per cluster: size, centroid and inertia, in one combined pass.

    Inertia is ``(n - 1) * total sample variance``, accumulated about the
    running mean, which keeps the digits that a sum of squares would lose.
    """
    v = array_to_vector(F.col(vector))
    s = df.groupBy(*group, label).agg(Summarizer.metrics("count", "mean", "variance").summary(v).alias("s"))
    spread = V._total(vector_to_array(F.col("s.variance")))
    return s.select(
        *group, label, F.col("s.count").alias("n"), vector_to_array(F.col("s.mean")).alias("centroid"),
        F.when(F.col("s.count") > 1, spread * (F.col("s.count") - 1)).otherwise(0.0).alias("inertia"),
    )


def inertia(df: DataFrame, vector: str, label: str) -> DataFrame:
    return cluster_moments(df, vector, label).select(label, "n", "inertia")


def with_centroid_distance(df: DataFrame, vector: str, label: str, metric: str = "euclidean", group: Sequence[str] = ()) -> DataFrame:
    """Every row with its distance to its own cluster mean.

    One centroid row per cluster; Spark broadcasts that side by its size.
    """
    centres = cluster_moments(df, vector, label, group).select(*group, label, "centroid", F.col("n").alias("cluster_n"))
    return df.join(centres, [*group, label]).withColumn("centroid_distance", V.distance(vector, "centroid", metric))


def cosine_inertia(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Cosine distances to the cluster means of clusters of two or more, and min/max balance."""
    far = with_centroid_distance(df, vector, label, "cosine")
    per = far.groupBy(label).agg(F.count("*").alias("size"), F.sum("centroid_distance").alias("d"))
    return per.agg(
        F.coalesce(F.sum(F.when(F.col("size") > 1, F.col("d"))), F.lit(0.0)).alias("cosine_inertia"),
        (F.min("size") / F.max("size")).alias("balance_ratio"),
    )


def calinski_harabasz(df: DataFrame, vector: str, label: str, group: Sequence[str] = ()) -> DataFrame:
    """``(between / (k - 1)) / (within / (n - k))``.

    One pass over two grouping sets gives the inertia of every cluster and of
    the whole; what lies between the clusters is the difference. Null with one
    cluster, or when every row is a cluster of its own.
    """
    g = list(group)
    v = array_to_vector(F.col(vector))
    rows = df.filter(F.col(label).isNotNull())
    s = rows.groupingSets([[*g, label], g], *g, label).agg(
        F.grouping(label).alias("whole"), Summarizer.metrics("count", "variance").summary(v).alias("s")
    )
    n = F.col("s.count")
    spread = F.when(n > 1, V._total(vector_to_array(F.col("s.variance"))) * (n - 1)).otherwise(0.0)
    part = s.select(*g, "whole", n.alias("n"), spread.alias("spread"))
    each = F.col("whole") == 0
    out = part.groupBy(*g).agg(
        F.count_if(each).alias("k"),
        F.sum(F.when(each, F.col("n"))).alias("rows"),
        F.sum(F.when(each, F.col("spread"))).alias("within"),
        F.max(F.when(~each, F.col("spread"))).alias("total"),
    )
    value = F.try_divide(F.try_divide(F.col("total") - F.col("within"), F.col("k") - 1), F.try_divide("within", F.col("rows") - F.col("k")))
    return out.select(*g, F.col("k").alias("n_clusters"), F.when(F.col("k") > 1, value).alias("calinski_harabasz"))


def davies_bouldin(df: DataFrame, vector: str, label: str, group: Sequence[str] = (), tile_rows: int = TILE_ROWS) -> DataFrame:
    """Mean over clusters of the worst ``(S_i + S_j) / d_ij``.

    Centroids of all groups are compared in tiles that carry the group, and
    every task keeps only the maximum per cluster.
    """
    g = list(group)
    far = with_centroid_distance(df, vector, label, group=g)
    spread = far.groupBy(*g, label).agg(F.avg("centroid_distance").alias("s"), F.first("centroid").alias("centroid"))
    key = F.to_json(F.struct(*g)) if g else F.lit("")
    points = spread.select(F.to_json(F.struct(*g, label)).alias("id"), key.alias("grp"), "s", "centroid")
    tiles = build_tiles(points, "id", "centroid", carry=["grp", "s"], tile_rows=tile_rows)
    schema = T.StructType([T.StructField("grp", T.StringType()), T.StructField("id", T.StringType()), T.StructField("r", T.DoubleType())])

    def kernel(a, partners):
        ga, sa = a.extra["grp"].to_numpy(zero_copy_only=False), a.extra["s"].to_numpy()
        best = np.full(len(a), -1.0)
        for b in partners:
            gb, sb = b.extra["grp"].to_numpy(zero_copy_only=False), b.extra["s"].to_numpy()
            d = arrow.distances(a.x, b.x)
            with np.errstate(divide="ignore", invalid="ignore"):
                r = (sa[:, None] + sb[None, :]) / d
            r[(d == 0) | (ga[:, None] != gb[None, :])] = -1.0
            if a.key == b.key:
                np.fill_diagonal(r, -1.0)
            best = np.maximum(best, r.max(axis=1))
        yield {"grp": ga, "id": a.ids, "r": best}

    worst = run_tiles(tiles, tile_pairs(tiles, ordered=True), kernel, schema, carry=["grp", "s"])
    per = worst.groupBy("grp", "id").agg(F.greatest(F.max("r"), F.lit(0.0)).alias("r"))
    out = per.groupBy("grp").agg(F.count("*").alias("n_clusters"), F.avg("r").alias("r"))
    value = F.when(F.col("n_clusters") > 1, F.col("r")).alias("davies_bouldin")
    if not g:
        return out.select("n_clusters", value)
    spec = T.StructType([spread.schema[c] for c in g])
    return out.withColumn("_g", F.from_json("grp", spec)).select("_g.*", "n_clusters", value)


def adjusted_rand(pairs: DataFrame, a: str = "label_a", b: str = "label_b") -> DataFrame:
    """Adjusted Rand index from the contingency counts; noise is a class of its own."""
    def choose2(c):
        c = c.cast("double")
        return c * (c - 1) / 2

    cells = pairs.groupBy(a, b).agg(F.count("*").alias("n"))
    inside = cells.agg(F.coalesce(F.sum(choose2(F.col("n"))), F.lit(0.0)).alias("s"), F.sum("n").alias("n"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(choose2(F.col("n"))).alias("ra"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(choose2(F.col("n"))).alias("rb"))
    one = one_row(inside, rows, cols)
    expected = F.try_divide(F.col("ra") * F.col("rb"), choose2(F.col("n")))
    top = (F.col("ra") + F.col("rb")) / 2
    return one.select(
        F.when(top == expected, 1.0).otherwise((F.col("s") - expected) / (top - expected)).alias("adjusted_rand")
    )


def compare_clusterings(pairs: DataFrame, a: str = "label_a", b: str = "label_b", noise: int = -1) -> DataFrame:
    """ARI, clusters on each side (noise not counted) and noise rows on each side."""
    facts = pairs.agg(
        F.count("*").alias("n"),
        F.count_distinct(F.when(F.col(a) != noise, F.col(a))).alias("clusters_a"),
        F.count_distinct(F.when(F.col(b) != noise, F.col(b))).alias("clusters_b"),
        F.count_if(F.col(a) == noise).alias("noise_a"),
        F.count_if(F.col(b) == noise).alias("noise_b"),
    )
    return one_row(facts, adjusted_rand(pairs, a, b))


def _sorted_columns(x: np.ndarray, slot: np.ndarray, k: int) -> list[tuple]:
    """Per column and cluster: the least value, the others' excess in order, and its running sums."""
    groups = [np.flatnonzero(slot == c) for c in range(k)]
    out = []
    for column in x.T:
        for c, rows in enumerate(groups):
            v = np.sort(column[rows])
            over = v - v[0]
            out.append((c, v, v[0], np.concatenate([[0.0], np.cumsum(over)])))
    return out


def _manhattan_sums(x: np.ndarray, columns: list[tuple], k: int) -> np.ndarray:
    """Manhattan distances of each row of ``x`` to all rows of each cluster, added up column by column without pairs of rows."""
    sums = np.zeros((k, len(x)))
    for j in range(x.shape[1]):
        values = np.sort(x[:, j])
        back = np.argsort(np.argsort(x[:, j], kind="stable"), kind="stable")
        for c, v, least, run in columns[j * k:(j + 1) * k]:
            # Of all rows of the cluster, ``below`` are less than the value.
            below = np.searchsorted(v, values)
            sums[c] += ((values - least) * (2 * below - len(v)) + (run[-1] - 2.0 * run[below]))[back]
    return np.maximum(sums.T, 0.0)


def _cluster_tiles(points: DataFrame, metric: str, tile_rows: int, held: list[str]) -> DataFrame:
    """Tiles of whole clusters, ``(tile, cfg, unit, both, n, ids, mat, labels, sizes)``; a cluster of more than ``tile_rows`` rows has tiles of its own.

    ``points``: ``(cfg, id, vec, label)``. ``unit`` is the same for the tiles of one large cluster, and else the tile's own. ``both``
    marks tiles of large clusters of a labeling that has few of them. ``held`` gets the folder of the tiles.
    """
    sizes = points.groupBy("cfg", "label").agg(F.count("*").alias("size"))
    large = F.col("size") > tile_rows
    # Small clusters go by label into bins of about tile_rows rows.
    small = running_total(sizes.where(~large), "cfg", "label", "size", "before")
    units = small.select("cfg", "label", "size", F.floor(F.col("before") / tile_rows).alias("bin"), F.lit(False).alias("large"))
    units = units.unionByName(sizes.where(large).select("cfg", "label", "size", F.col("label").cast("long").alias("bin"), F.lit(True).alias("large")))
    units = snapshot(units, "units")
    few = units.groupBy("cfg").agg((F.count_if("large") <= BOTH_SIDES).alias("few"))
    placed = points.join(units.join(few, "cfg").withColumn("both", F.col("large") & F.col("few")).drop("few"), ["cfg", "label"])
    part = F.when(F.col("large"), F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / tile_rows))).otherwise(0)
    placed = placed.select("cfg", "large", "bin", part.cast("long").alias("part"), "id", "vec", "label", "size", "both")
    id_type = points.schema["id"].dataType
    schema = T.StructType([
        T.StructField("key", T.StringType()), T.StructField("cfg", T.IntegerType()), T.StructField("unit", T.StringType()), T.StructField("both", T.BooleanType()), T.StructField("n", T.IntegerType()),
        T.StructField("ids", T.ArrayType(id_type)), T.StructField("mat", T.BinaryType()), T.StructField("labels", T.ArrayType(T.IntegerType())), T.StructField("sizes", T.ArrayType(T.LongType())),
    ])

    def pack(key, table):
        cfg, big, number, piece = (k.as_py() for k in key)
        one = lambda name: pa.array([table.column(name).combine_chunks().to_pylist()], pa.list_(table.schema.field(name).type))
        x = arrow.matrix(table.column("vec"))
        unit = f"{cfg}:{int(big)}:{number}"
        return pa.table(
            [pa.array([f"{unit}:{piece}"]), pa.array([cfg], pa.int32()), pa.array([unit]), pa.array([table.column("both")[0].as_py()]), pa.array([len(x)], pa.int32()), one("id"), pa.array([arrow.packed(x)], pa.binary()), one("label"), one("size")],
            names=[f.name for f in schema.fields],
        )

    tiles = stored(placed.groupBy("cfg", "large", "bin", "part").applyInArrow(pack, schema), held, "tiles")
    return tiles.withColumn("tile", F.xxhash64("key")).drop("key")


def _sums(df: DataFrame, id_col: str, vector: str, labels: DataFrame, metric: str, tile_rows: int) -> DataFrame:
    """``(cfg, id, label, n, own, nearest)``: a row's distances to its own cluster added up, and the least mean distance to another.

    Every task has two blocks of tiles. Of clusters that it has whole it gives back the row's own sum and the least mean, one row
    for a row of the tile; only sums to parts of clusters that fill more tiles than that come back one by one. Two tiles of large
    clusters meet once and give the sums of both; a task adds up what it has for a row and a cluster. Manhattan sums to clusters of
    some size come from their sorted columns, so no pairs of rows are formed.
    """
    points = labels.join(df.select(F.col(id_col).alias("id"), F.col(vector).alias("vec")), "id").select("cfg", "id", "vec", "label")
    held: list[str] = []
    tiles = _cluster_tiles(points, metric, tile_rows, held)
    id_type = points.schema["id"].dataType
    schema = T.StructType([
        T.StructField("cfg", T.IntegerType()), T.StructField("id", id_type), T.StructField("label", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("own", T.DoubleType()), T.StructField("nearest", T.DoubleType()), T.StructField("other", T.IntegerType()), T.StructField("size", T.LongType()), T.StructField("total", T.DoubleType()),
    ])
    once = F.lit(metric != "manhattan")
    left = tiles.select("cfg", F.col("tile").alias("a"), (F.col("both") & once).alias("both_a"))
    right = tiles.select("cfg", F.col("tile").alias("b"), (F.col("both") & once).alias("both_b"))
    pairs = left.join(right, "cfg").where("a <= b OR NOT (both_a AND both_b)").select("a", "b")
    columns = {}

    def kernel(a, partners):
        if metric != "manhattan" and a.extra["boths"][0].as_py():
            large = [b for b in partners if b.extra["boths"][0].as_py()]
            partners = [b for b in partners if not b.extra["boths"][0].as_py()]
            yield from mutual(a, large)
            if not partners:
                return
        # Tiles of one large cluster side by side; runs of tiles with a bounded number of clusters.
        partners = sorted(partners, key=lambda b: b.extra["labels"][0].as_py())
        run, labels = [], 0
        for b in partners:
            more = len(np.unique(b.extra["labels"].to_numpy()))
            if run and labels + more > RUN_LABELS:
                yield from against(a, run)
                run, labels = [], 0
            run.append(b)
            labels += more
        yield from against(a, run)

    def part(tile, cluster, total):
        """Sums of a tile's rows to some rows of a cluster."""
        size, rows = cluster.extra["sizes"][0].as_py(), len(tile)
        empty = pa.nulls(rows, pa.float64())
        return {
            "cfg": np.full(rows, tile.extra["cfgs"][0].as_py()), "id": tile.ids, "label": tile.extra["labels"].to_numpy(), "n": tile.extra["sizes"].to_numpy(),
            "own": empty, "nearest": empty, "other": np.full(rows, cluster.extra["labels"][0].as_py()), "size": np.full(rows, size), "total": total,
        }

    def mutual(a, partners):
        totals = {}
        for b in partners:
            d = arrow.distances(a.x, b.x, metric)
            if a.key == b.key:
                np.fill_diagonal(d, 0.0)
            else:
                yield part(b, a, d.sum(axis=0))
            name = b.extra["labels"][0].as_py()
            totals[name] = b, totals[name][1] + d.sum(axis=1) if name in totals else d.sum(axis=1)
        for b, total in totals.values():
            yield part(a, b, total)

    def fold(table):
        keys = ["cfg", "id", "label", "n", "other", "size"]
        some = pc.is_valid(table.column("other"))
        parts = table.filter(some)
        if not len(parts):
            return table
        parts = parts.group_by(keys).aggregate([("total", "sum")]).select([*keys, "total_sum"]).rename_columns([*keys, "total"])
        empty = pa.nulls(len(parts), pa.float64())
        parts = parts.append_column("own", empty).append_column("nearest", empty)
        return pa.concat_tables([table.filter(pc.invert(some)), parts.select(table.column_names).cast(table.schema)])

    def sorted_sums(a, partners, slot, held):
        """Sums to clusters of at least ``SORTED_ROWS`` rows here, and whether the others are left."""
        many = held >= SORTED_ROWS
        sums = np.zeros((len(a), len(held)))
        if not many.any() or not np.isfinite(a.x).all():
            return sums, slice(None)
        key = tuple(b.key for b in partners)
        if columns.get("key") != key:
            x = np.concatenate([b.x for b in partners])
            to = np.where(many, np.cumsum(many) - 1, -1)[slot]
            columns.update(key=key, found=_sorted_columns(x[to >= 0], to[to >= 0], int(many.sum())) if np.isfinite(x).all() else None)
        if columns["found"] is None:
            return sums, slice(None)
        sums[:, many] = _manhattan_sums(a.x, columns["found"], int(many.sum()))
        return sums, np.flatnonzero(~many[slot])

    def against(a, partners):
        cfg, own, n = a.extra["cfgs"].to_numpy()[0], a.extra["labels"].to_numpy(), a.extra["sizes"].to_numpy()
        label = np.concatenate([b.extra["labels"].to_numpy() for b in partners])
        size = np.concatenate([b.extra["sizes"].to_numpy() for b in partners])
        names, first, slot, held = np.unique(label, return_index=True, return_inverse=True, return_counts=True)
        sums, rest = sorted_sums(a, partners, slot, held) if metric == "manhattan" else (np.zeros((len(a), len(names))), slice(None))
        left, at = np.zeros(len(slot), bool), 0
        left[rest] = True
        for b in partners:
            mine, some = slot[at:at + len(b)], left[at:at + len(b)]
            at += len(b)
            if not some.any():
                continue
            d = arrow.distances(a.x, b.x if some.all() else b.x[some], metric)
            if a.key == b.key:
                d[np.flatnonzero(some), np.arange(some.sum())] = 0.0
            # Columns of one cluster side by side, then added up.
            mine = mine[some]
            order = np.argsort(mine, kind="stable")
            cuts = np.flatnonzero(np.diff(mine[order], prepend=-1))
            sums[:, mine[order][cuts]] += np.add.reduceat(d[:, order], cuts, axis=1)
        size = size[first]
        whole = held == size
        same = own[:, None] == names[None, :]
        mean = np.where(whole[None, :] & ~same, sums / size[None, :], np.inf)
        best = mean.min(axis=1)
        at = same & whole[None, :]
        total = np.where(at.any(axis=1), (sums * at).sum(axis=1), np.nan)
        keep = np.flatnonzero(np.isfinite(best) | ~np.isnan(total))
        none = np.zeros(len(keep), np.int64)
        yield {
            "cfg": np.full(len(keep), cfg), "id": a.ids[keep], "label": own[keep], "n": n[keep], "own": pa.array(total[keep], mask=np.isnan(total[keep])),
            "nearest": pa.array(best[keep], mask=~np.isfinite(best[keep])), "other": pa.array(none, mask=none == 0), "size": none, "total": np.zeros(len(keep)),
        }
        for j in np.flatnonzero(~whole):
            empty = pa.array(np.zeros(len(a)), mask=np.ones(len(a), bool))
            yield {
                "cfg": np.full(len(a), cfg), "id": a.ids, "label": own, "n": n, "own": empty, "nearest": empty, "other": np.full(len(a), names[j]),
                "size": np.full(len(a), size[j]), "total": sums[:, j],
            }

    carried = tiles.withColumn("cfgs", F.array("cfg")).withColumn("boths", F.array("both"))
    # Tiles of one unit stand together, so that a block holds it whole if it can.
    raw = snapshot(run_tiles(carried, pairs, kernel, schema, carry=["cfgs", "boths", "labels", "sizes"], order=["cfg", "unit", "tile"], fold=fold), "sums")
    discard(df.sparkSession, *held)
    parts = raw.where("other IS NOT NULL").groupBy("cfg", "id", "label", "n", "other", "size").agg(F.sum("total").alias("total"))
    same = F.col("other") == F.col("label")
    parts = parts.select("cfg", "id", "label", "n", F.when(same, F.col("total")).alias("own"), F.when(~same, F.col("total") / F.col("size")).alias("nearest"))
    whole = raw.where("other IS NULL").select("cfg", "id", "label", "n", "own", "nearest").unionByName(parts)
    return whole.groupBy("cfg", "id", "label", "n").agg(F.max("own").alias("own"), F.min("nearest").alias("nearest"))


def silhouette_many(df: DataFrame, id_col: str, vector: str, labels: DataFrame, metric: str = "euclidean", tile_rows: int = TILE_ROWS) -> DataFrame:
    """Per-row silhouettes of several labelings.

    ``labels`` is ``(cfg, id, label)``; a row missing for a labeling takes no
    part in it. Returns ``(cfg, id, label, intra, nearest, silhouette)``;
    silhouette is 0 for singletons, null where a labeling has fewer than two
    clusters.
    """
    labels = labels.select(F.col("cfg").cast("int").alias("cfg"), "id", F.col("label").cast("int").alias("label")).filter("label IS NOT NULL")
    per = _sums(df, id_col, vector, labels, metric, tile_rows)
    per = per.withColumn("intra", F.when(F.col("n") > 1, F.col("own") / (F.col("n") - 1)))
    gap = F.try_divide(F.col("nearest") - F.col("intra"), F.greatest("nearest", "intra"))
    s = F.when(F.col("nearest").isNull(), F.lit(None).cast("double")).when(F.col("n") == 1, 0.0).otherwise(F.coalesce(gap, F.lit(0.0)))
    return per.select("cfg", "id", "label", "intra", "nearest", s.alias("silhouette"))


def cosine_silhouette_samples(df: DataFrame, id_col: str, vector: str, label: str, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Cosine silhouettes without pairs of rows.

    The mean cosine distance of a row to a cluster is one minus its product
    with the mean unit vector of that cluster, so a product with the cluster
    sums replaces all pairs. The sums are a table: tiles of rows meet tiles of
    sums, and every task gives back one row for a row.
    """
    norm = F.sqrt(V.dot(vector, vector))
    rows = df.select(
        F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"),
        F.transform(vector, lambda x: F.when(norm > 0, x / norm).otherwise(x)).alias("u"),
    ).filter("label IS NOT NULL")
    sums = rows.groupBy("label").agg(
        Summarizer.metrics("count", "sum").summary(array_to_vector(F.col("u"))).alias("s")
    ).select("label", F.col("s.count").alias("size"), vector_to_array(F.col("s.sum")).alias("sum"))
    id_type = rows.schema["id"].dataType
    points = rows.select(F.lit(0).alias("kind"), "id", "label", F.lit(0).cast("long").alias("size"), F.col("u").alias("vec"))
    points = points.unionByName(sums.select(F.lit(1).alias("kind"), F.lit(None).cast(id_type).alias("id"), "label", "size", F.col("sum").alias("vec")))
    points = points.withColumn("key", F.coalesce(F.col("id").cast("string"), F.col("label").cast("string")))
    points = snapshot(points, "points")
    counts = points.groupBy("kind").agg(F.ceil(F.count("*") / tile_rows).alias("parts"))
    placed = points.join(counts, "kind").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts"))).select("kind", "part", "id", "label", "size", "vec")
    tile = T.StructType([
        T.StructField("tile", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("ids", T.ArrayType(id_type)),
        T.StructField("mat", T.BinaryType()), T.StructField("labels", T.ArrayType(T.IntegerType())), T.StructField("sizes", T.ArrayType(T.LongType())),
    ])

    def pack(key, table):
        one = lambda name: pa.array([table.column(name).combine_chunks().to_pylist()], pa.list_(table.schema.field(name).type))
        x = arrow.matrix(table.column("vec"))
        kind, part = key[0].as_py(), key[1].as_py()
        return pa.table([pa.array([part * 2 + kind], pa.int64()), pa.array([kind], pa.int32()), pa.array([len(x)], pa.int32()), one("id"), pa.array([arrow.packed(x)], pa.binary()), one("label"), one("size")], names=[f.name for f in tile.fields])

    tiles = snapshot(placed.groupBy("kind", "part").applyInArrow(pack, tile), "tiles")
    left = tiles.where("kind = 0").select(F.col("tile").alias("a"), F.lit(0).alias("k"))
    pairs = left.join(tiles.where("kind = 1").select(F.col("tile").alias("b"), F.lit(0).alias("k")), "k")
    schema = T.StructType([T.StructField("id", id_type), T.StructField("label", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("intra", T.DoubleType()), T.StructField("nearest", T.DoubleType())])

    def kernel(a, partners):
        own, at = a.extra["labels"].to_numpy(), np.arange(len(a))
        inside, near, size = np.full(len(a), np.nan), np.full(len(a), np.inf), np.zeros(len(a), np.int64)
        for b in partners:
            names, n = b.extra["labels"].to_numpy(), b.extra["sizes"].to_numpy()
            order = np.argsort(names)
            names, n, sums = names[order], n[order], a.x @ b.x[order].T
            far = 1.0 - sums / n
            slot = np.minimum(np.searchsorted(names, own), len(names) - 1)
            mine = np.flatnonzero(names[slot] == own)
            k = slot[mine]
            total = n[k] - sums[mine, k] - (1.0 - np.einsum("ij,ij->i", a.x[mine], a.x[mine]))
            inside[mine], size[mine] = np.maximum(total / np.where(n[k] > 1, n[k] - 1, 1), 0.0), n[k]
            far[mine, k] = np.inf
            near = np.minimum(near, far.min(axis=1))
        yield {"id": a.ids[at], "label": own, "n": size, "intra": pa.array(inside, mask=np.isnan(inside) | (size <= 1)), "nearest": pa.array(near, mask=~np.isfinite(near))}

    per = run_tiles(tiles, pairs, kernel, schema, carry=["labels", "sizes"])
    per = per.groupBy("id", "label").agg(F.max("n").alias("n"), F.max("intra").alias("intra"), F.min("nearest").alias("nearest"))
    top = F.greatest("nearest", "intra")
    s = F.when((F.col("n") > 1) & (top > 0), (F.col("nearest") - F.col("intra")) / top).otherwise(0.0)
    return per.select("id", "label", "intra", "nearest", F.when(F.col("nearest").isNotNull(), s).alias("silhouette"))


def silhouette_samples(df: DataFrame, id_col: str, vector: str, label: str, metric: str = "euclidean", tile_rows: int = TILE_ROWS) -> DataFrame:
    """``(id, label, intra, nearest, silhouette)`` per row, exact for the metric."""
    if metric == "cosine":
        return cosine_silhouette_samples(df, id_col, vector, label, tile_rows)
    labels = df.select(F.lit(0).alias("cfg"), F.col(id_col).alias("id"), F.col(label).alias("label"))
    return silhouette_many(df, id_col, vector, labels, metric, tile_rows).drop("cfg")


def mean_silhouette(samples: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Mean silhouette, NaN unless there are 2 to n-1 clusters."""
    per = samples.groupBy(*group, "label").agg(F.count("*").alias("n"), F.sum("silhouette").alias("s"))
    total = per.groupBy(*group).agg(F.count("*").alias("n_clusters"), F.sum("n").alias("n_rows"), F.sum("s").alias("s"))
    ok = (F.col("n_clusters") >= 2) & (F.col("n_clusters") < F.col("n_rows"))
    value = F.when(ok, F.col("s") / F.col("n_rows")).otherwise(F.lit(float("nan")))
    return total.select(*group, "n_clusters", "n_rows", value.alias("silhouette"))


def silhouette(df: DataFrame, id_col: str, vector: str, label: str, metric: str = "euclidean", tile_rows: int = TILE_ROWS) -> DataFrame:
    return mean_silhouette(silhouette_samples(df, id_col, vector, label, metric, tile_rows))


def evaluate_clustering(df: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """One row per cluster (scope "cluster") and one for the whole (scope "all")."""
    samples = snapshot(silhouette_samples(df, id_col, vector, label), "silhouette")
    moments = snapshot(cluster_moments(df, vector, label).select(F.col(label).cast("int").alias("cluster_id"), "n", "inertia"), "moments")
    whole = mean_silhouette(samples)
    per = (
        samples.groupBy(F.col("label").alias("cluster_id")).agg(F.avg("silhouette").alias("silhouette"))
        .join(moments, "cluster_id")
        .select(F.lit("cluster").alias("scope"), "cluster_id", "n", "silhouette", "inertia")
    )
    ch = calinski_harabasz(df, vector, label).select("calinski_harabasz")
    db = davies_bouldin(df, vector, label).select("davies_bouldin")
    total = moments.agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"))
    top = (
        one_row(whole.select("silhouette"), total, ch, db).select(
            F.lit("all").alias("scope"), F.lit(None).cast("int").alias("cluster_id"), "n", "silhouette", "inertia",
            "calinski_harabasz", "davies_bouldin", scores.silhouette_quality("silhouette").alias("quality"),
        )
    )
    return top.unionByName(per, allowMissingColumns=True)


def evaluate_levels(df: DataFrame, id_col: str, vector: str, level1: str, level2: str) -> DataFrame:
    """Quality and size metrics of both levels; level 2 over rows that have one."""
    out = None
    for level, label in ((1, level1), (2, level2)):
        rows = df.filter(F.col(label).isNotNull())
        if level == 2:
            rows = rows.filter(F.col(label) != -1)
        quality = evaluate_clustering(rows, id_col, vector, label).filter("scope = 'all'").drop("scope", "cluster_id", "n")
        sizes = cluster_size_metrics(rows, label)
        one = one_row(quality, sizes).select(F.lit(level).alias("level"), "*")
        out = one if out is None else out.unionByName(one)
    return out
