"""Vector aggregates, scaling and projection on the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecloom.functions import vectors as V
from vecloom.operators import aggregates as A
from vecloom.operators import matrix as X
from vecloom.operators import running as R
from vecloom.operators.filters import verify_vectors
from vecloom.plans.prepare import prepare as prepare_plan
from vecloom.session import scratch_path
from workload.common import E, long, query, r6, sql_long, vectors
from workload.catalogue import WEIGHTS_SQL

L = f"{E}, l AS (SELECT vec_id, label, unnest(range(64))::INTEGER AS pos, unnest(v) AS x FROM e)"


@query("artist_mean_vector", f"WITH {L} SELECT label, count(DISTINCT vec_id) AS song_count, pos, round(avg(x), 6) + 0.0 AS x FROM l GROUP BY label, pos HAVING count(DISTINCT vec_id) >= 5")
def artist_mean_vector(s, d):
    good, _ = verify_vectors(vectors(s, d), "v", 64)
    return long(A.artist_mean_vector(good, "label", "v"), "mean_vector", "label", "song_count")


@query("artist_mean_online", f"WITH {L} SELECT label, count(DISTINCT vec_id) AS song_count, pos, round(avg(x), 6) + 0.0 AS x FROM l GROUP BY label, pos HAVING count(DISTINCT vec_id) >= 5")
def artist_mean_online(s, d):
    """All vectors, arriving in three parts: a stored state and two increments."""
    good, _ = verify_vectors(vectors(s, d), "v", 64)
    part, path = F.pmod(F.xxhash64("vec_id"), F.lit(3)), scratch_path(s, "means")
    state = R.start(good.where(part == 0), path, "label", "v", 8)
    for i in (1, 2):
        state = R.advance(state, path, good.where(part == i), "label", "v", 8)
    return long(R.running_mean(state, "label"), "mean_vector", "label", "song_count")


@query(
    "data_quality",
    f"""WITH {L} SELECT (SELECT max(len(v)) FROM e)::INTEGER AS total_features, count(DISTINCT vec_id) AS total_rows, round(avg(x), 6) + 0.0 AS matrix_mean,
        round(stddev_pop(x), 6) + 0.0 AS matrix_std, round(min(x), 6) + 0.0 AS matrix_min, round(max(x), 6) + 0.0 AS matrix_max, count(*) FILTER (x IS NULL OR isnan(x)) AS total_missing FROM l""",
)
def data_quality(s, d):
    q = A.data_quality(vectors(s, d), "v")
    return q.select("total_features", "total_rows", *[r6(c).alias(c) for c in ("matrix_mean", "matrix_std", "matrix_min", "matrix_max")], "total_missing")


@query("low_variance", f"WITH {L} SELECT pos, round(var_pop(x), 8) AS var_pop FROM l GROUP BY pos HAVING var_pop(x) < 0.0155")
def low_variance(s, d):
    return A.low_variance(vectors(s, d), "v", 0.0155).select("pos", F.round("var_pop", 8).alias("var_pop"))


@query("constant_features", f"WITH {L} SELECT pos, round(stddev_pop(x), 6) + 0.0 AS std_pop FROM (SELECT pos, CASE WHEN pos % 2 = 1 THEN 0.25 ELSE x END AS x FROM l) GROUP BY pos HAVING stddev_pop(x) < 1e-10")
def constant_features(s, d):
    # Every second position made constant.
    flat = F.transform("v", lambda x, i: F.when(i % 2 == 1, F.lit(0.25)).otherwise(x))
    return A.constant_features(vectors(s, d).withColumn("v", flat), "v").select("pos", r6("std_pop").alias("std_pop"))


@query(
    "group_stats",
    f"""WITH {L} SELECT CASE WHEN pos >= 32 THEN 'vggish' WHEN pos >= 16 THEN 'mfcc' WHEN pos >= 8 THEN 'spectral' ELSE 'rhythmic' END AS "group",
        round(avg(x), 6) + 0.0 AS mean, round(stddev_pop(x), 6) + 0.0 AS std, round(min(x), 6) + 0.0 AS min, round(max(x), 6) + 0.0 AS max
        FROM l WHERE pos >= 2 GROUP BY 1""",
)
def group_stats(s, d):
    g = A.group_stats(vectors(s, d), "v", V.GROUPS_64)
    return g.select("group", *[r6(c).alias(c) for c in ("mean", "std", "min", "max")])


@query(
    "high_corr_pairs",
    f"""WITH {L} SELECT a.pos AS i, b.pos AS j, round(corr(a.x, b.x), 6) + 0.0 AS corr FROM l a JOIN l b ON a.vec_id = b.vec_id AND a.pos < b.pos
        GROUP BY 1, 2 HAVING corr(a.x, b.x) > 0.1 AND corr(a.x, b.x) < 1.0""",
)
def high_corr_pairs(s, d):
    return A.high_corr_pairs(vectors(s, d), "v", 0.1).select("i", "j", r6("corr").alias("corr"))


@query(
    "percentiles",
    """SELECT l_returnflag, unnest([0.85, 0.90, 0.95, 0.99])::DOUBLE AS prob, unnest(list_transform(q, lambda x: round(x, 4) + 0.0)) AS value
       FROM (SELECT l_returnflag, quantile_cont(l_extendedprice, [0.85, 0.90, 0.95, 0.99]) AS q FROM lineitem GROUP BY 1)""",
)
def percentiles(s, d):
    q = A.percentiles(s.read.parquet(f"{d}/lineitem.parquet"), "l_extendedprice", group="l_returnflag")
    return q.select(F.col("key").alias("l_returnflag"), "prob", r6("value", 4).alias("value"))


@query(
    "percentiles_many_keys",
    """SELECT l_suppkey, unnest([0.1, 0.5, 0.9])::DOUBLE AS prob, unnest(list_transform(q, lambda x: round(x, 4) + 0.0)) AS value
       FROM (SELECT l_suppkey, quantile_cont(l_extendedprice, [0.1, 0.5, 0.9]) AS q FROM lineitem GROUP BY 1)""",
)
def percentiles_many_keys(s, d):
    q = A.percentiles(s.read.parquet(f"{d}/lineitem.parquet"), "l_extendedprice", (0.1, 0.5, 0.9), "l_suppkey")
    return q.select(F.col("key").alias("l_suppkey"), "prob", r6("value", 4).alias("value"))


def _scaled(method):
    return lambda s, d: long(X.scale(vectors(s, d), "v", method, "z"), "z", "vec_id")


STD = f"{L}, p AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS sd, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3, min(x) AS lo, max(x) AS hi FROM l GROUP BY pos)"
query("scale_standard", f"WITH {STD} SELECT vec_id, pos, round((x - m) / sd, 6) + 0.0 AS x FROM l JOIN p USING (pos)")(_scaled("standard"))
query("scale_robust", f"WITH {STD} SELECT vec_id, pos, round((x - q2) / (q3 - q1), 6) + 0.0 AS x FROM l JOIN p USING (pos)")(_scaled("robust"))
query("scale_minmax", f"WITH {STD} SELECT vec_id, pos, round(-2 + 4 * (x - lo) / (hi - lo), 6) + 0.0 AS x FROM l JOIN p USING (pos)")(_scaled("minmax"))


@query(
    "preprocess",
    f"""WITH {STD} SELECT vec_id, pos, round(greatest(-10.0, least(10.0, (x - q2) / (q3 - q1) * ({WEIGHTS_SQL})::DOUBLE)), 6) + 0.0 AS x FROM l JOIN p USING (pos)""",
)
def preprocess(s, d):
    return long(X.preprocess(vectors(s, d), "v", V.GROUPS_64, 64, "robust"), "v", "vec_id")


@query("pca")
def pca(s, d):
    out, _, _ = X.pca(vectors(s, d), "v")
    return long(out, "reduced", "vec_id", "label")


query("pca_2d")(lambda s, d: long(X.pca_2d(vectors(s, d), "v"), "xy", "vec_id", "label"))


@query("prepare")
def prepare(s, d):
    p = prepare_plan(s.read.parquet(f"{d}/embeddings.parquet"), "embedding", V.GROUPS_64, 64)
    return long(p.df, "reduced", "vec_id")
