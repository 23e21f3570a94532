"""Pair joins, clustering, selection and evaluation on the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecloom.operators import agglomerative as G
from vecloom.operators import catalog as C
from vecloom.operators import dbscan as D
from vecloom.operators import density as N
from vecloom.operators import gmm as M
from vecloom.operators import kmeans as K
from vecloom.operators import quality as Q
from vecloom.operators import tiles as T
from vecloom.plans import cluster, evaluate
from vecloom.session import snapshot
from workload.common import E, query, r6, vectors

EPS = 1.15
MIN_SAMPLES = 3
MANHATTAN = "list_sum(list_transform(range(1, 65), lambda i: abs(a.v[i] - b.v[i])))"
PAIRS = f"{E}, p AS (SELECT a.vec_id AS i, b.vec_id AS j, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id)"


@query(
    "eps_join",
    f"""WITH {E}, u AS (SELECT min(vec_id) AS i, v, count(*) AS n FROM e GROUP BY v)
        SELECT a.i AS id_a, b.i AS id_b, round(list_distance(a.v, b.v), 6) + 0.0 AS distance, a.n AS n_a, b.n AS n_b
        FROM u a JOIN u b ON a.i < b.i WHERE list_distance(a.v, b.v) <= {EPS}
        UNION ALL SELECT i, i, 0.0, n, n FROM u WHERE n > 1""",
)
def eps_join(s, d):
    return T.eps_join(vectors(s, d), "vec_id", "v", EPS).withColumn("distance", r6("distance"))


@query(
    "eps_join_copies",
    """WITH u AS (SELECT vec_id AS id, min(vec_id) OVER w AS rep, count(*) OVER w AS n FROM (SELECT vec_id, list_transform(embedding[1:2], lambda x: round(x::DOUBLE, 1) + 0.0) AS v FROM embeddings) WINDOW w AS (PARTITION BY v))
       SELECT id, rep FROM u WHERE n > 1""",
)
def eps_join_copies(s, d):
    """The ids behind the rows of a join over coarse vectors, which many rows share."""
    coarse = vectors(s, d).select("vec_id", F.transform(F.slice("v", 1, 2), lambda x: F.round(x, 1) + 0.0).alias("v"))
    return T.copies(coarse, "vec_id", "v")


@query(
    "pairwise_distances",
    f"""WITH {E}, p AS (SELECT a.vec_id AS id, list_distance(a.v, b.v) AS eu, {MANHATTAN} AS ma, list_cosine_distance(a.v, b.v) AS co FROM e a JOIN e b ON a.vec_id <> b.vec_id),
        q AS (SELECT id, unnest(['euclidean', 'manhattan', 'cosine']) AS metric, unnest([eu, ma, co]) AS d FROM p)
        SELECT id, metric, count(*) AS others, round(sum(d), 5) + 0.0 AS total, round(min(d), 6) + 0.0 AS nearest, round(max(d), 6) + 0.0 AS farthest FROM q GROUP BY 1, 2""",
)
def pairwise_distances(s, d):
    """The matrix, summed up per row inside the tiles' row pieces."""
    out = None
    for metric in ("euclidean", "manhattan", "cosine"):
        pieces = T.pairwise_distances(vectors(s, d), "vec_id", "v", metric)
        kept = F.filter(F.arrays_zip("ids", "distances"), lambda z: z["ids"] != F.col("id"))
        rows = pieces.select("id", F.transform(kept, lambda z: z["distances"]).alias("far"))
        one = rows.groupBy("id").agg(
            F.sum(F.size("far")).alias("others"), r6(F.sum(F.aggregate("far", F.lit(0.0), lambda a, x: a + x)), 5).alias("total"),
            r6(F.min(F.array_min("far"))).alias("nearest"), r6(F.max(F.array_max("far"))).alias("farthest"),
        ).withColumn("metric", F.lit(metric))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "knn_join",
    f"""WITH {PAIRS} SELECT i AS id, j AS neighbour, round(d, 6) + 0.0 AS distance, (row_number() OVER (PARTITION BY i ORDER BY d, j))::INTEGER AS rank
        FROM p QUALIFY rank <= 5""",
)
def knn_join(s, d):
    return T.knn_join(vectors(s, d), "vec_id", "v", 5).withColumn("distance", r6("distance"))


CENTRES = f"{E}, c0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS c, v FROM (SELECT * FROM e ORDER BY vec_id LIMIT 5))"


def _nearest(name: str, centres: str) -> str:
    return (
        f"{name} AS (SELECT vec_id, label, v, c, d FROM (SELECT e.vec_id, e.label, e.v, k.c, list_distance(e.v, k.v) AS d, "
        f"row_number() OVER (PARTITION BY e.vec_id ORDER BY list_distance(e.v, k.v), k.c) AS rn FROM e, {centres} k) WHERE rn = 1)"
    )


def _means(name: str, assigned: str) -> str:
    return (
        f"{name} AS (SELECT c, list(x ORDER BY pos) AS v FROM (SELECT c, pos, avg(x) AS x FROM "
        f"(SELECT c, unnest(range(64)) AS pos, unnest(v) AS x FROM {assigned}) GROUP BY 1, 2) GROUP BY 1)"
    )


FIVE = f"{CENTRES}, {_nearest('a0', 'c0')}"


def five(s, d):
    v = vectors(s, d)
    return v, K.first_rows(v, "vec_id", "v", 5)


def near_five(s, d):
    v, centres = five(s, d)
    return K.point_to_centroid(v, "v", centres)


@query("point_to_centroid", f"WITH {FIVE} SELECT vec_id, c::INTEGER AS cluster_id, round(d, 6) + 0.0 AS distance FROM a0")
def point_to_centroid(s, d):
    return near_five(s, d).select("vec_id", "cluster_id", r6("distance").alias("distance"))


CONF = """round(CASE WHEN count(*) OVER w > 1 AND max(d) OVER w > 0 THEN 1 - d / max(d) OVER w ELSE 1.0 END, 6) + 0.0 AS confidence"""


@query("kmeans_confidence", f"WITH {FIVE} SELECT vec_id, {CONF} FROM a0 WINDOW w AS (PARTITION BY c)")
def kmeans_confidence(s, d):
    return K.kmeans_confidence(near_five(s, d)).select("vec_id", r6("confidence").alias("confidence"))


LLOYD = (
    f"{FIVE}, {_means('c1', 'a0')}, {_nearest('a1', 'c1')}, {_means('c2', 'a1')}, {_nearest('a2', 'c2')}, {_means('c3', 'a2')}, {_nearest('a3', 'c3')}"
)


def lloyd_centres(s, d):
    v, start = five(s, d)
    return v, K.lloyd(v, "v", {0: start}, max_iters=3, tol=0.0)[0]


@query(
    "lloyd",
    f"WITH {LLOYD} SELECT c3.c::INTEGER AS cluster_id, (unnest(range(64)))::INTEGER AS pos, unnest(list_transform(c3.v, lambda x: round(x, 6) + 0.0)) AS x, "
    "(SELECT round(sum(d * d), 6) FROM a3) AS inertia FROM c3",
)
def lloyd(s, d):
    _, (centres, inertia, _) = lloyd_centres(s, d)
    rows = [(i, j, float(x)) for i, c in enumerate(centres) for j, x in enumerate(c)]
    return s.createDataFrame(rows, "cluster_id int, pos int, x double").select("cluster_id", "pos", r6("x").alias("x"), F.lit(round(inertia, 6)).alias("inertia"))


@query(
    "kmeans_assign",
    f"WITH {LLOYD} SELECT vec_id AS song_id, 'kmeans' AS algorithm, c::INTEGER AS kmeans_cluster_id, round(d, 6) + 0.0 AS kmeans_distance, {CONF} FROM a3 WINDOW w AS (PARTITION BY c)",
)
def kmeans_assign(s, d):
    v, (centres, _, _) = lloyd_centres(s, d)
    return K.kmeans_assign(v, "vec_id", "v", centres).withColumn("kmeans_distance", r6("kmeans_distance")).withColumn("confidence", r6("confidence"))


@query("kmeans")
def kmeans(s, d):
    v = vectors(s, d)
    centres, _ = K.kmeans(v, "vec_id", "v", 5)
    return K.kmeans_assign(v, "vec_id", "v", centres)


query("kmeans_elbow")(lambda s, d: K.kmeans_elbow(vectors(s, d), "vec_id", "v"))


@query("gmm_em")
def gmm_em(s, d):
    v = vectors(s, d)
    return M.responsibilities(v, "v", M.gmm_em(v, "vec_id", "v", 8)).select("vec_id", "cluster_id", "probabilities")


@query("gmm_assign")
def gmm_assign(s, d):
    v = vectors(s, d)
    return M.gmm_assign(v, "vec_id", "v", M.gmm_em(v, "vec_id", "v", 8))


query("gmm_select")(lambda s, d: M.gmm_select(vectors(s, d), "vec_id", "v"))


def _density_sql(eps: float = EPS, least: int = MIN_SAMPLES, p: str = "") -> str:
    """Labels by reachability; ``p`` prefixes the names of the steps."""
    return f"""{p}ed AS (SELECT i, j FROM p WHERE d <= {eps}),
    {p}core AS (SELECT vec_id FROM e LEFT JOIN {p}ed ON i = vec_id GROUP BY vec_id HAVING count(j) + 1 >= {least}),
    {p}ce AS (SELECT i, j FROM {p}ed WHERE i IN (SELECT vec_id FROM {p}core) AND j IN (SELECT vec_id FROM {p}core)),
    {p}reach(i, r) AS (SELECT vec_id, vec_id FROM {p}core UNION SELECT c.j, r.r FROM {p}reach r JOIN {p}ce c ON r.i = c.i),
    {p}comp AS (SELECT i AS vec_id, min(r) AS root FROM {p}reach GROUP BY i),
    {p}num AS (SELECT root, row_number() OVER (ORDER BY root) AS cid FROM (SELECT DISTINCT root FROM {p}comp)),
    {p}cl AS (SELECT vec_id, root, cid FROM {p}comp JOIN {p}num USING (root)),
    {p}bo AS (SELECT x.i AS vec_id, min(cid) AS cid FROM {p}ed x JOIN {p}cl c ON x.j = c.vec_id WHERE x.i NOT IN (SELECT vec_id FROM {p}core) GROUP BY 1),
    {p}lab AS (SELECT e.vec_id, e.v, coalesce(c.cid, b.cid, -1)::INTEGER AS cluster_id, c.vec_id IS NOT NULL AS is_core, coalesce(c.root = e.vec_id, FALSE) AS is_seed
              FROM e LEFT JOIN {p}cl c USING (vec_id) LEFT JOIN {p}bo b USING (vec_id))"""


def _silhouette_sql(labels: str, p: str = "", distance: str = "list_distance(a.v, b.v)", out: str = "ss") -> str:
    """Per-row silhouettes over ``labels (id, v, label)``."""
    return f"""{p}far AS (SELECT a.id, a.label, b.label AS other, sum({distance}) AS s, count(*) AS n FROM {labels} a, {labels} b GROUP BY 1, 2, 3),
    {p}ab AS (SELECT id, label, max(CASE WHEN other = label THEN n END) AS n, max(CASE WHEN other = label AND n > 1 THEN s / (n - 1) END) AS intra,
              min(CASE WHEN other <> label THEN s / n END) AS nearest FROM {p}far GROUP BY 1, 2),
    {p}{out} AS (SELECT id, label, intra, nearest, CASE WHEN nearest IS NULL THEN NULL WHEN n = 1 THEN 0.0 ELSE coalesce((nearest - intra) / nullif(greatest(nearest, intra), 0), 0.0) END AS silhouette FROM {p}ab)"""


DENSE = f"RECURSIVE {PAIRS}, {_density_sql()}"


def dense(s, d):
    return D.dbscan(vectors(s, d), "vec_id", "v", EPS, MIN_SAMPLES)


@query("dbscan", f"WITH {DENSE} SELECT vec_id AS id, cluster_id, is_core, is_seed FROM lab")
def dbscan(s, d):
    return dense(s, d)


@query("density_cluster_id", f"WITH {DENSE} SELECT cid::INTEGER AS cluster_id, root AS first_core, count(*) AS n_core FROM cl GROUP BY 1, 2")
def density_cluster_id(s, d):
    cores = dense(s, d).filter("is_core")
    return cores.groupBy("cluster_id").agg(F.min("id").alias("first_core"), F.count("*").alias("n_core"))


INFO_SQL = """info AS (SELECT (SELECT count(DISTINCT cluster_id) FROM lab WHERE cluster_id <> -1) AS n_clusters, count(*) FILTER (cluster_id = -1) AS n_noise,
  count(*) FILTER (is_core) AS n_core, count(*) FILTER (NOT is_core AND cluster_id <> -1) AS n_border, count(*) AS n_total FROM lab),
sz AS (SELECT cluster_id, count(*) AS size FROM lab GROUP BY 1)"""


@query(
    "dbscan_info",
    f"""WITH {DENSE}, {INFO_SQL} SELECT n_clusters, n_noise, n_core, n_border, round(n_noise / n_total, 6) + 0.0 AS noise_ratio,
        (SELECT max(size) FROM sz WHERE cluster_id <> -1) AS largest_cluster_size, (SELECT min(size) FROM sz WHERE cluster_id <> -1) AS smallest_cluster_size,
        (SELECT round(avg(size), 6) FROM sz WHERE cluster_id <> -1) AS avg_cluster_size, (SELECT round(stddev_pop(size), 6) FROM sz WHERE cluster_id <> -1) AS cluster_size_std,
        (SELECT round(min(size) / max(size), 6) FROM sz WHERE cluster_id <> -1) AS balance_ratio,
        CASE WHEN n_clusters >= 2 AND n_noise / n_total <= 0.05 THEN CASE WHEN n_clusters <= 10 THEN 'EXCELLENT' ELSE 'GOOD' END
             WHEN n_clusters >= 2 AND n_noise / n_total <= 0.2 THEN 'FAIR' ELSE 'POOR' END AS quality_score FROM info""",
)
def dbscan_info(s, d):
    info = D.density_info(dense(s, d))
    rounded = ("noise_ratio", "avg_cluster_size", "cluster_size_std", "balance_ratio")
    return info.select(*[r6(c).alias(c) if c in rounded else c for c in info.columns if c != "n_total"])


@query(
    "dbscan_assign",
    f"""WITH {DENSE}, {INFO_SQL}, real AS (SELECT vec_id AS id, v, cluster_id AS label FROM lab WHERE cluster_id <> -1), {_silhouette_sql('real')},
        m AS (SELECT avg(silhouette) AS s FROM ss)
        SELECT vec_id AS song_id, 'dbscan' AS algorithm, cluster_id AS dbscan_cluster_id, is_core AS dbscan_is_core, cluster_id = -1 AS is_noise_point,
          {EPS}::DOUBLE AS eps, {MIN_SAMPLES} AS min_samples, size AS dbscan_cluster_size, round(s, 6) + 0.0 AS dbscan_silhouette_score,
          n_clusters AS dbscan_n_clusters, n_noise AS dbscan_n_noise,
          round(greatest(0.1, least(1.0, CASE WHEN cluster_id = -1 THEN 0.1 WHEN is_core THEN 0.9 ELSE 0.6 END
            * CASE WHEN cluster_id <> -1 THEN 0.7 + 0.3 * least(1.0, size / 100.0::DOUBLE) ELSE 1.0 END
            * CASE WHEN s > 0 THEN 0.8 + 0.2 * least(1.0, s * 2) ELSE 1.0 END)), 6) + 0.0 AS confidence, is_seed
        FROM lab JOIN sz USING (cluster_id), info, m""",
)
def dbscan_assign(s, d):
    out = N.dbscan_assign(vectors(s, d), "vec_id", "v", EPS, MIN_SAMPLES)
    return out.withColumn("dbscan_silhouette_score", r6("dbscan_silhouette_score")).withColumn("confidence", r6("confidence"))


GRID = [(1.1, 3), (1.15, 3), (1.15, 6), (1.17, 4)]


def _grid_sql() -> str:
    steps, parts = [], []
    for n, (eps, least) in enumerate(GRID):
        p = f"g{n}"
        steps.append(_density_sql(eps, least, p))
        steps.append(f"{p}real AS (SELECT vec_id AS id, v, cluster_id AS label FROM {p}lab WHERE cluster_id <> -1)")
        steps.append(_silhouette_sql(f"{p}real", p))
        parts.append(
            f"SELECT {eps}::DOUBLE AS eps, {least} AS min_samples, count(DISTINCT cluster_id) FILTER (cluster_id <> -1) AS n_clusters, "
            f"count(*) FILTER (cluster_id = -1) AS n_noise, round(count(*) FILTER (cluster_id = -1) / count(*), 6) + 0.0 AS noise_ratio, "
            f"round((SELECT avg(silhouette) FROM {p}ss), 6) + 0.0 AS silhouette FROM {p}lab"
        )
    return f"WITH RECURSIVE {PAIRS}, {', '.join(steps)} " + " UNION ALL ".join(parts)


@query(
    "dbscan_grid_sizes",
    f"WITH RECURSIVE {PAIRS}, " + ", ".join(_density_sql(e, m, f"g{n}") for n, (e, m) in enumerate(GRID)) + " "
    + " UNION ALL ".join(
        f"SELECT {e}::DOUBLE AS eps, {m} AS min_samples, cluster_id, count(*) AS size FROM g{n}lab WHERE cluster_id <> -1 GROUP BY 3" for n, (e, m) in enumerate(GRID)
    ),
)
def dbscan_grid_sizes(s, d):
    return N.dbscan_grid(vectors(s, d), "vec_id", "v", GRID)[1]


@query("dbscan_grid", _grid_sql())
def dbscan_grid(s, d):
    grid, _ = N.dbscan_grid(vectors(s, d), "vec_id", "v", GRID)
    return grid.select("eps", "min_samples", "n_clusters", "n_noise", r6("noise_ratio").alias("noise_ratio"), r6(F.nanvl("silhouette", F.lit(None))).alias("silhouette"))


KD = f"""{PAIRS}, near AS (SELECT i, d, row_number() OVER (PARTITION BY i ORDER BY d) AS r FROM p),
kd AS (SELECT m AS min_samples, i AS id, d AS k_distance FROM near JOIN (SELECT unnest([3, 4, 5, 6, 8, 10]) AS m) ON r = m - 1),
curve AS (SELECT *, row_number() OVER (PARTITION BY min_samples ORDER BY k_distance DESC, id) - 1 AS position FROM kd)"""


def curve(s, d):
    return snapshot(N.k_distance_curve(N.k_distances(vectors(s, d), "vec_id", "v")))


@query("k_distance", f"WITH {KD} SELECT min_samples, id, round(k_distance, 6) + 0.0 AS k_distance, position FROM curve")
def k_distance(s, d):
    return curve(s, d).select("min_samples", "id", r6("k_distance").alias("k_distance"), "position")


KNEE = f"""{KD}, b AS (SELECT *, abs((lead(k_distance, 2) OVER w - lead(k_distance) OVER w) - (lead(k_distance) OVER w - k_distance)) AS bend,
  lead(k_distance, 2) OVER w AS k2, count(*) OVER (PARTITION BY min_samples) AS n FROM curve WINDOW w AS (PARTITION BY min_samples ORDER BY position)),
knees AS (SELECT min_samples, position + 2 AS knee_position, k2 AS knee FROM b WHERE bend IS NOT NULL AND n > 10
  QUALIFY row_number() OVER (PARTITION BY min_samples ORDER BY bend DESC, position) = 1)"""


@query("knee", f"WITH {KNEE} SELECT min_samples, knee_position, round(knee, 6) + 0.0 AS knee FROM knees")
def knee(s, d):
    return N.knee(curve(s, d)).withColumn("knee", r6("knee"))


@query(
    "suggest_eps",
    f"""WITH RECURSIVE {KNEE}, q AS (SELECT min_samples, quantile_cont(k_distance, 0.85) AS p85, quantile_cont(k_distance, 0.9) AS p90, quantile_cont(k_distance, 0.95) AS p95,
          avg(k_distance) + 0.5 * stddev_pop(k_distance) AS wide FROM kd GROUP BY 1),
        c AS (SELECT min_samples, p85, p90, p95, list_sort(list_filter([knee, p85, p90, p95, wide], lambda x: x > 0)) AS a FROM q LEFT JOIN knees USING (min_samples)),
        r(min_samples, i, kept) AS (
          SELECT min_samples, 1, []::DOUBLE[] FROM c
          UNION ALL
          SELECT r.min_samples, i + 1, CASE WHEN len(kept) = 0 OR abs(a[i] - kept[len(kept)]) > 0.1 * a[i] THEN list_append(kept, a[i]) ELSE kept END
          FROM r JOIN c USING (min_samples) WHERE i <= len(a))
        SELECT min_samples, round(p85, 6) + 0.0 AS p85, round(p90, 6) + 0.0 AS p90, round(p95, 6) + 0.0 AS p95, least(len(kept), 3)::INTEGER AS n, round(kept[1], 6) + 0.0 AS first
        FROM r JOIN c USING (min_samples) WHERE i = len(a) + 1""",
)
def suggest_eps(s, d):
    out = N.eps_suggestions(curve(s, d))
    return out.select("min_samples", *[r6(c).alias(c) for c in ("p85", "p90", "p95")], F.size("eps").alias("n"), r6(F.get("eps", F.lit(0))).alias("first"))


# --- trees -----------------------------------------------------------------


def _tree(linkage, metric):
    return lambda s, d: G.agglomerative(vectors(s, d), "vec_id", "v", linkage, metric)


query("agglomerative")(_tree("average", "euclidean"))
query("agglomerative_single")(_tree("single", "euclidean"))
query("agglomerative_ward")(_tree("ward", "euclidean"))


def tree(s, d):
    v = vectors(s, d)
    return v, G.agglomerative(v, "vec_id", "v", "average", "cosine")


@query("cut_tree")
def cut_tree(s, d):
    v, merges = tree(s, d)
    return G.cut_tree(merges, v.select("vec_id"), 3)


@query("cut_levels")
def cut_levels(s, d):
    v, merges = tree(s, d)
    return G.cut_levels(merges, v.select("vec_id"), [2, 3, 8]).drop("tree", "merge_height")


@query("merge_height")
def merge_height(s, d):
    v, merges = tree(s, d)
    return G.merge_height(merges, v.select("vec_id"), 3)


query("hier_assign")(lambda s, d: G.hier_assign(vectors(s, d), "vec_id", "v"))
query("hier_large")(lambda s, d: G.hier_large(vectors(s, d), "vec_id", "v", 3, "ward", mode="micro", size=200))
query("hier_large_micro")(lambda s, d: G.hier_large(vectors(s, d), "vec_id", "v", 3, "ward", mode="micro", size=100))


@query("hier_final")
def hier_final(s, d):
    v = vectors(s, d)
    best = G.hier_select(v, "vec_id", "v", ks=[3, 4]).orderBy(F.desc("composite"), "cfg").head()
    return G.hier_final(v, "vec_id", "v", best["k"], best["linkage"], best["metric"])


query("hier_select")(lambda s, d: G.hier_select(vectors(s, d), "vec_id", "v"))


@query("cluster_all")
def cluster_all(s, d):
    state, failures = cluster.cluster_all(vectors(s, d), "vec_id", "v", options={"dbscan": {"eps": EPS, "min_samples": MIN_SAMPLES}})
    if failures:
        raise RuntimeError(f"not all algorithms ended: {failures}")
    return cluster.tidy_clusters(state)


# --- quality ---------------------------------------------------------------


@query(
    "cluster_sizes",
    "SELECT label, count(*) AS size, round(count(*) * 100.0 / (SELECT count(*) FROM embeddings), 6) + 0.0 AS pct FROM embeddings GROUP BY 1",
)
def cluster_sizes(s, d):
    return Q.cluster_sizes(vectors(s, d), "label").withColumn("pct", r6("pct"))


@query(
    "pct_of_total",
    "SELECT o_orderpriority, o_orderstatus, count(*) AS size, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY o_orderpriority), 6) + 0.0 AS pct FROM orders GROUP BY 1, 2",
)
def pct_of_total(s, d):
    return Q.pct_of_total(s.read.parquet(f"{d}/orders.parquet"), "o_orderstatus", ["o_orderpriority"]).withColumn("pct", r6("pct"))


SIZES = "z AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)"


@query(
    "cluster_size_metrics",
    f"""WITH {SIZES} SELECT count(*) AS cluster_count, sum(n)::BIGINT AS total_points, min(n) AS min_size, max(n) AS max_size, round(avg(n), 6) AS mean_size,
        round(stddev_pop(n), 6) AS std_size, quantile_cont(n, 0.5)::DOUBLE AS median_size, round(sum(n) / count(*), 6) AS expected_size,
        round(stddev_pop(n) / avg(n), 6) AS coefficient_of_variation, round(1 / (1 + stddev_pop(n) / avg(n)), 6) AS balance_score FROM z""",
)
def cluster_size_metrics(s, d):
    m = Q.cluster_size_metrics(vectors(s, d), "label")
    whole = ("cluster_count", "total_points", "min_size", "max_size")
    return m.select(*[c if c in whole else r6(c).alias(c) for c in m.columns])


@query(
    "cluster_statistics",
    f"""WITH {SIZES} SELECT count(*) AS num_clusters, sum(n)::BIGINT AS total_points, min(n) AS min_cluster_size, max(n) AS max_cluster_size,
        round(avg(n), 6) AS mean_cluster_size, round(stddev_pop(n), 6) AS std_cluster_size,
        round(greatest(0.0, least(1.0, 1 - stddev_pop(n) / (sum(n) / count(*)))), 6) AS clipped_balance FROM z""",
)
def cluster_statistics(s, d):
    m = Q.cluster_statistics(vectors(s, d), "label")
    whole = ("num_clusters", "total_points", "min_cluster_size", "max_cluster_size")
    return m.select(*[c if c in whole else r6(c).alias(c) for c in m.columns])


MEANS = f"""{E}, mu AS (SELECT label, list(x ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS x FROM
  (SELECT label, unnest(range(64)) AS pos, unnest(v) AS x FROM e) GROUP BY 1, 2) GROUP BY 1),
gm AS (SELECT list(x ORDER BY pos) AS c FROM (SELECT pos, avg(x) AS x FROM (SELECT unnest(range(64)) AS pos, unnest(v) AS x FROM e) GROUP BY 1)),
own AS (SELECT vec_id, label, list_distance(v, c) AS d, list_cosine_distance(v, c) AS cd FROM e JOIN mu USING (label)),
per AS (SELECT label, count(*) AS n, sum(d * d) AS inertia, avg(d) AS s, sum(cd) AS cd FROM own GROUP BY 1)"""
CH_SQL = """ch AS (SELECT (sum(n * list_distance(mu.c, gm.c) ** 2) / (count(*) - 1)) / (sum(inertia) / (sum(n) - count(*))) AS calinski_harabasz FROM per JOIN mu USING (label), gm)"""
DB_SQL = """db AS (SELECT avg(r) AS davies_bouldin FROM (SELECT a.label, max((a.s + b.s) / list_distance(ma.c, mb.c)) AS r
  FROM per a JOIN mu ma USING (label) JOIN per b ON a.label <> b.label JOIN mu mb ON mb.label = b.label GROUP BY 1))"""


@query("inertia", f"WITH {MEANS} SELECT label, n, round(inertia, 6) + 0.0 AS inertia FROM per")
def inertia(s, d):
    return Q.inertia(vectors(s, d), "v", "label").withColumn("inertia", r6("inertia"))


@query(
    "cosine_inertia",
    f"WITH {MEANS} SELECT round(sum(CASE WHEN n > 1 THEN cd END), 6) + 0.0 AS cosine_inertia, round(min(n) / max(n), 6) + 0.0 AS balance_ratio FROM per",
)
def cosine_inertia(s, d):
    return Q.cosine_inertia(vectors(s, d), "v", "label").select(r6("cosine_inertia").alias("cosine_inertia"), r6("balance_ratio").alias("balance_ratio"))


@query("calinski_harabasz", f"WITH {MEANS}, {CH_SQL} SELECT (SELECT count(*) FROM per) AS n_clusters, round(calinski_harabasz, 6) + 0.0 AS calinski_harabasz FROM ch")
def calinski_harabasz(s, d):
    return Q.calinski_harabasz(vectors(s, d), "v", "label").withColumn("calinski_harabasz", r6("calinski_harabasz"))


@query("davies_bouldin", f"WITH {MEANS}, {DB_SQL} SELECT (SELECT count(*) FROM per) AS n_clusters, round(davies_bouldin, 6) + 0.0 AS davies_bouldin FROM db")
def davies_bouldin(s, d):
    return Q.davies_bouldin(vectors(s, d), "v", "label").withColumn("davies_bouldin", r6("davies_bouldin"))


LABELLED = f"{E}, x AS (SELECT vec_id AS id, v, label FROM e)"
COSINE = "list_cosine_distance(a.v, b.v)"


@query(
    "silhouette",
    f"""WITH {LABELLED}, {_silhouette_sql('x', 'e')}, {_silhouette_sql('x', 'm', MANHATTAN)}, {_silhouette_sql('x', 'c', COSINE)}
        SELECT 'euclidean' AS metric, round(avg(silhouette), 6) + 0.0 AS silhouette FROM ess UNION ALL
        SELECT 'manhattan', round(avg(silhouette), 6) + 0.0 FROM mss UNION ALL SELECT 'cosine', round(avg(silhouette), 6) + 0.0 FROM css""",
)
def silhouette(s, d):
    out = None
    for metric in ("euclidean", "manhattan", "cosine"):
        one = Q.silhouette(vectors(s, d), "vec_id", "v", "label", metric).select(F.lit(metric).alias("metric"), r6("silhouette").alias("silhouette"))
        out = one if out is None else out.union(one)
    return out


def _samples(metric):
    def run(s, d):
        out = Q.silhouette_samples(vectors(s, d), "vec_id", "v", "label", metric)
        return out.select("id", "label", *[r6(c).alias(c) for c in ("intra", "nearest", "silhouette")])

    return run


SAMPLES_OUT = "SELECT id, label, round(intra, 6) + 0.0 AS intra, round(nearest, 6) + 0.0 AS nearest, round(silhouette, 6) + 0.0 AS silhouette FROM ss"
query("silhouette_samples", f"WITH {LABELLED}, {_silhouette_sql('x')} {SAMPLES_OUT}")(_samples("euclidean"))
query("silhouette_samples_cosine", f"WITH {LABELLED}, {_silhouette_sql('x', distance=COSINE)} {SAMPLES_OUT}")(_samples("cosine"))


@query(
    "evaluate_clustering",
    f"""WITH {MEANS}, {CH_SQL}, {DB_SQL}, x AS (SELECT vec_id AS id, v, label FROM e), {_silhouette_sql('x')}
        SELECT 'all' AS scope, NULL::INTEGER AS cluster_id, (SELECT sum(n)::BIGINT FROM per) AS n, (SELECT round(avg(silhouette), 6) + 0.0 FROM ss) AS silhouette,
          (SELECT round(sum(inertia), 6) FROM per) AS inertia, (SELECT round(calinski_harabasz, 6) FROM ch) AS calinski_harabasz,
          (SELECT round(davies_bouldin, 6) FROM db) AS davies_bouldin, (SELECT CASE WHEN avg(silhouette) > 0.7 THEN 'Excellent' WHEN avg(silhouette) > 0.5 THEN 'Good' WHEN avg(silhouette) > 0.25 THEN 'Fair' ELSE 'Poor' END FROM ss) AS quality
        UNION ALL
        SELECT 'cluster', label, n, round(s2, 6) + 0.0, round(inertia, 6) + 0.0, NULL, NULL, NULL FROM per JOIN (SELECT label, avg(silhouette) AS s2 FROM ss GROUP BY 1) USING (label)""",
)
def evaluate_clustering(s, d):
    out = Q.evaluate_clustering(vectors(s, d), "vec_id", "v", "label")
    rounded = ("silhouette", "inertia", "calinski_harabasz", "davies_bouldin")
    return out.select(*[r6(c).alias(c) if c in rounded else c for c in out.columns])


@query(
    "evaluate_levels",
    f"""WITH {E}, x AS (SELECT vec_id AS id, v, label // 4 AS label FROM e), {_silhouette_sql('x', 'a')},
        y AS (SELECT vec_id AS id, v, label FROM e WHERE label <> 0), {_silhouette_sql('y', 'b')},
        z AS (SELECT 1 AS level, label, count(*) AS n FROM x GROUP BY 2 UNION ALL SELECT 2, label, count(*) FROM y GROUP BY 2)
        SELECT level, round(max(CASE level WHEN 1 THEN (SELECT avg(silhouette) FROM ass) ELSE (SELECT avg(silhouette) FROM bss) END), 6) + 0.0 AS silhouette,
          count(*) AS cluster_count, sum(n)::BIGINT AS total_points, round(1 / (1 + stddev_pop(n) / avg(n)), 6) AS balance_score FROM z GROUP BY level""",
)
def evaluate_levels(s, d):
    rows = vectors(s, d).select("vec_id", "v", F.floor(F.col("label") / 4).cast("int").alias("l1"), F.when(F.col("label") == 0, -1).otherwise(F.col("label")).alias("l2"))
    out = Q.evaluate_levels(rows, "vec_id", "v", "l1", "l2")
    return out.select("level", r6("silhouette").alias("silhouette"), "cluster_count", "total_points", r6("balance_score").alias("balance_score"))


@query(
    "evaluate_and_store",
    f"""WITH {LABELLED}, {_silhouette_sql('x')}, sz AS (SELECT label, count(*) AS n FROM x GROUP BY 1)
        SELECT id AS song_id, label AS kmeans_cluster_id, n AS kmeans_cluster_size, (SELECT round(avg(silhouette), 6) + 0.0 FROM ss) AS kmeans_silhouette_score FROM x JOIN sz USING (label)""",
)
def evaluate_and_store(s, d):
    songs = vectors(s, d).select(F.col("vec_id").alias("song_id"), F.col("v").alias("feature_vector"))
    rows = vectors(s, d).select(F.col("vec_id").alias("song_id"), F.lit("kmeans").alias("algorithm"), F.col("label").alias("kmeans_cluster_id"))
    state = C.union_results(cluster.empty_clusters(s, "bigint"), rows)
    done = evaluate.evaluate_and_store(songs, state, "kmeans")
    return done.select("song_id", "kmeans_cluster_id", "kmeans_cluster_size", r6("kmeans_silhouette_score").alias("kmeans_silhouette_score"))


def _stored(s, d, algorithm: str, column: str, label):
    songs = vectors(s, d).select(F.col("vec_id").alias("song_id"), F.col("v").alias("feature_vector"))
    rows = vectors(s, d).select(F.col("vec_id").alias("song_id"), F.lit(algorithm).alias("algorithm"), label.alias(column))
    return evaluate.evaluate_and_store(songs, C.union_results(cluster.empty_clusters(s, "bigint"), rows), algorithm)


@query(
    "evaluate_and_store_gmm",
    f"""WITH {LABELLED}, {_silhouette_sql('x')}, sz AS (SELECT label, count(*) AS n FROM x GROUP BY 1)
        SELECT id AS song_id, label AS gmm_cluster_id, n AS gmm_cluster_size, (SELECT round(avg(silhouette), 6) + 0.0 FROM ss) AS gmm_silhouette_score FROM x JOIN sz USING (label)""",
)
def evaluate_and_store_gmm(s, d):
    return _stored(s, d, "gmm", "gmm_cluster_id", F.col("label")).select("song_id", "gmm_cluster_id", "gmm_cluster_size", r6("gmm_silhouette_score").alias("gmm_silhouette_score"))


@query(
    "evaluate_and_store_hierarchical",
    f"""WITH {LABELLED}, {_silhouette_sql('x')}, sz AS (SELECT label, count(*) AS n FROM x GROUP BY 1)
        SELECT id AS song_id, label AS hier_level2_id, (SELECT round(avg(silhouette), 6) + 0.0 FROM ss) AS hier_silhouette_score,
          (SELECT round(1 / (1 + stddev_pop(n) / avg(n)), 6) + 0.0 FROM sz) AS hier_balance_score FROM x""",
)
def evaluate_and_store_hierarchical(s, d):
    done = _stored(s, d, "hierarchical", "hier_level2_id", F.col("label"))
    return done.select("song_id", "hier_level2_id", r6("hier_silhouette_score").alias("hier_silhouette_score"), r6("hier_balance_score").alias("hier_balance_score"))


@query(
    "evaluate_and_store_dbscan",
    f"""WITH {E}, a AS (SELECT vec_id AS id, v, CASE WHEN label = 0 THEN -1 ELSE label END AS label FROM e), x AS (SELECT * FROM a WHERE label <> -1), {_silhouette_sql('x')},
        sz AS (SELECT label, count(*) AS n FROM a GROUP BY 1)
        SELECT id AS song_id, label AS dbscan_cluster_id, n AS dbscan_cluster_size, (SELECT round(avg(silhouette), 6) + 0.0 FROM ss) AS dbscan_silhouette_score,
          (SELECT count(*) FROM sz WHERE label <> -1) AS dbscan_n_clusters, (SELECT sum(n)::BIGINT FROM sz WHERE label = -1) AS dbscan_n_noise FROM a JOIN sz USING (label)""",
)
def evaluate_and_store_dbscan(s, d):
    done = _stored(s, d, "dbscan", "dbscan_cluster_id", F.when(F.col("label") == 0, -1).otherwise(F.col("label")))
    return done.select("song_id", "dbscan_cluster_id", "dbscan_cluster_size", r6("dbscan_silhouette_score").alias("dbscan_silhouette_score"), "dbscan_n_clusters", "dbscan_n_noise")
