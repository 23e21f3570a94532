"""Filters, joins, fills, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecloom.functions import metadata as M
from vecloom.functions import scores
from vecloom.functions import vectors as V
from vecloom.operators import catalog as C
from vecloom.operators import filters, quality
from vecloom.session import snapshot
from workload.common import E, long, query, r6, sql_long, table, vectors

DOCS_SQL = "d AS (SELECT doc_id, source, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"


def described(s, d):
    return table(s, d, "documents").select("doc_id", "source", "lang").join(table(s, d, "labels"), "doc_id", "left")


@query("missing_any", f"WITH {DOCS_SQL} SELECT * FROM d WHERE quality IS NULL OR toxic IS NULL")
def missing_any(s, d):
    return filters.missing_any(described(s, d), ["quality", "toxic"])


HOSTS_SQL = "h AS (SELECT page_id, regexp_extract(url, '[?&]page=([0-9]+)', 1) AS artist_name FROM pages)"


def paged(s, d):
    return table(s, d, "pages").select("page_id", F.regexp_extract("url", r"[?&]page=([0-9]+)", 1).alias("artist_name"))


query("missing_blank", f"WITH {HOSTS_SQL} SELECT * FROM h WHERE artist_name = ''")(lambda s, d: filters.missing_blank(paged(s, d)))


@query("min_count", "SELECT o_custkey, count(*) AS song_count FROM orders GROUP BY 1 HAVING count(*) >= 5")
def min_count(s, d):
    return filters.min_count(C.song_count(table(s, d, "orders"), "o_custkey"), "song_count", 5)


@query("song_count", "SELECT o_custkey, count(*) AS song_count FROM orders GROUP BY 1")
def song_count(s, d):
    return C.song_count(table(s, d, "orders"), "o_custkey")


@query(
    "has_vector",
    "SELECT c_custkey, label FROM customer LEFT JOIN embeddings ON c_custkey = vec_id WHERE label = 3 AND embedding IS NOT NULL",
)
def has_vector(s, d):
    owned = table(s, d, "customer").select("c_custkey").join(vectors(s, d), F.col("c_custkey") == F.col("vec_id"), "left")
    return filters.has_vector(owned, "v", "label", 3).select("c_custkey", "label")


def tracks(s, d):
    return table(s, d, "conversations").select(
        "conv_id", "turn",
        F.when(
            F.col("role") != "system",
            F.struct(
                F.when(F.col("turn") == 4, "").otherwise(F.concat_ws("-", "conv_id", "turn")).alias("id"),
                F.when(F.col("turn") != 3, F.col("text")).alias("name"),
                F.when(F.col("role") == "assistant", F.array(F.struct(F.lit("a1").alias("id"), F.col("role").alias("name")), F.struct(F.lit("a2").alias("id"), F.lit("x").alias("name"))))
                .otherwise(F.array().cast("array<struct<id:string,name:string>>")).alias("artists"),
            ),
        ).alias("track"),
    )


@query("valid_tracks", "SELECT conv_id, turn FROM conversations WHERE role <> 'system' AND turn NOT IN (3, 4)")
def valid_tracks(s, d):
    from vecloom.sources.records import valid_tracks as keep

    return keep(tracks(s, d)).select("conv_id", "turn")


@query(
    "track_fields",
    """SELECT conv_id, turn, CASE WHEN role = 'system' THEN NULL WHEN turn = 4 THEN '' ELSE conv_id || '-' || turn END AS song_id,
              CASE WHEN role = 'assistant' THEN 'a1' ELSE 'unknown' END AS artist_id,
              CASE WHEN role <> 'system' AND turn <> 3 THEN text END AS song_name,
              CASE WHEN role = 'assistant' THEN role ELSE 'Unknown Artist' END AS artist_name FROM conversations""",
)
def track_fields(s, d):
    return tracks(s, d).select("conv_id", "turn", *M.track_fields("track"))


def texts(s, d):
    """Vectors as text in the stored encodings, some of them broken by label."""
    body = F.array_join(F.transform("v", lambda x: x.cast("string")), ",")
    text = (
        F.when(F.col("label") == 0, F.concat(F.lit("["), F.array_join(F.transform(F.slice("v", 1, 63), lambda x: x.cast("string")), ","), F.lit("]")))
        .when(F.col("label") == 1, F.concat(F.lit("["), F.array_join(F.transform(F.slice("v", 1, 63), lambda x: x.cast("string")), ","), F.lit(",NaN]")))
        .when(F.col("label") == 2, body)
        .when(F.col("label") == 3, F.array_join(F.transform("v", lambda x: x.cast("string")), " "))
        .when(F.col("label") == 4, F.concat(F.lit("["), body, F.lit(",x]")))
        .when(F.col("label") == 5, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("["), body, F.lit("]")))
    )
    return vectors(s, d).withColumn("text", text)


@query(
    "parse_vector",
    f"""WITH {E} SELECT vec_id,
        CASE WHEN label IN (1, 6, 7, 8, 9) THEN 64 END AS strict_size,
        CASE WHEN label IN (2, 3, 6, 7, 8, 9) THEN 64 END AS verified_size,
        CASE WHEN label = 0 THEN 63 WHEN label IN (1, 2, 6, 7, 8, 9) THEN 64 END AS loose_size,
        round(CASE WHEN label IN (2, 3, 6, 7, 8, 9) THEN list_sum(v) END, 6) + 0.0 AS verified_sum FROM e""",
)
def parse_vector(s, d):
    p = {m: V.parse_vector("text", m, 64) for m in ("strict", "verified", "loose")}
    return texts(s, d).select(
        "vec_id", F.size(p["strict"]).alias("strict_size"), F.size(p["verified"]).alias("verified_size"), F.size(p["loose"]).alias("loose_size"),
        r6(V._total(p["verified"])).alias("verified_sum"),
    )


@query(
    "verify_vectors",
    """SELECT vec_id, CASE WHEN label IN (3, 4, 5) THEN 'missing vector' WHEN label = 0 THEN 'wrong length' WHEN label = 1 THEN 'non-finite value' END AS reason
       FROM embeddings""",
)
def verify_vectors(s, d):
    rows = texts(s, d).select("vec_id", V.parse_vector("text", "loose").alias("v"))
    good, bad = filters.verify_vectors(rows.withColumn("v", F.when(F.size("v") > 1, F.col("v"))), "v", 64)
    return good.select("vec_id", F.lit(None).cast("string").alias("reason")).union(bad.select("vec_id", "reason"))


@query("vector_to_json", f"WITH {E}, j AS (SELECT vec_id, v AS w FROM e) " + sql_long("j", "w", "vec_id", places=8))
def vector_to_json(s, d):
    text = vectors(s, d).select("vec_id", V.vector_to_json("v").alias("t"))
    return long(text.select("vec_id", F.from_json("t", "array<double>").alias("w")), "w", "vec_id", places=8)


@query(
    "clean_vector",
    f"""WITH {E}, b AS (SELECT vec_id, list_concat(list_transform(list_slice(v, 1, CASE WHEN label = 0 THEN 60 ELSE 64 END),
          lambda x: CASE WHEN abs(x) > 0.3 THEN 0.0 ELSE x END), CASE WHEN label = 0 THEN [0.0, 0.0, 0.0, 0.0] ELSE [] END) AS w FROM e) """
    + sql_long("b", "w", "vec_id"),
)
def clean_vector(s, d):
    # Large items become infinite, label 0 loses its last items, label 1 gains some.
    broken = F.transform("v", lambda x: F.when(F.abs(x) > 0.3, F.lit(float("inf"))).otherwise(x))
    broken = F.when(F.col("label") == 0, F.slice(broken, 1, 60)).when(F.col("label") == 1, F.concat(broken, F.array(F.lit(9.0)))).otherwise(broken)
    return long(vectors(s, d).select("vec_id", V.clean_vector(broken, 64).alias("w")), "w", "vec_id")


WEIGHTS_SQL = (
    "CASE WHEN pos >= 32 THEN 1.02 WHEN pos >= 16 THEN 1.005 WHEN pos >= 8 THEN 0.985 WHEN pos >= 2 THEN 1.01 ELSE 1.0 END"
)


@query(
    "apply_group_weights",
    f"WITH {E}, l AS (SELECT vec_id, unnest(range(64))::INTEGER AS pos, unnest(v) AS x FROM e) "
    f"SELECT vec_id, pos, round(x * ({WEIGHTS_SQL})::DOUBLE, 6) + 0.0 AS x FROM l",
)
def apply_group_weights(s, d):
    return long(vectors(s, d).select("vec_id", V.apply_group_weights("v", V.GROUPS_64, 64).alias("w")), "w", "vec_id")


@query("clip", f"WITH {E}, c AS (SELECT vec_id, list_transform(v, lambda x: greatest(-10.0, least(10.0, x * 60))) AS w FROM e) " + sql_long("c", "w", "vec_id"))
def clip(s, d):
    big = F.transform("v", lambda x: x * 60)
    return long(vectors(s, d).select("vec_id", V.clip(big).alias("w")), "w", "vec_id")


@query(
    "distance",
    f"""WITH {E}, m AS (SELECT label, list(x ORDER BY pos) AS c FROM (
          SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(range(64)) AS pos, unnest(v) AS x FROM e) GROUP BY 1, 2) GROUP BY 1)
        SELECT vec_id, round(list_distance(v, c), 6) + 0.0 AS euclidean,
               round(list_sum(list_transform(range(1, 65), lambda i: abs(v[i] - c[i]))), 6) + 0.0 AS manhattan,
               round(list_cosine_distance(v, c), 6) + 0.0 AS cosine FROM e JOIN m USING (label)""",
)
def distance(s, d):
    from vecloom.operators.aggregates import mean_vector

    v = vectors(s, d)
    near = v.join(v.groupBy("label").agg(mean_vector("v").alias("c")), "label")
    return near.select("vec_id", *[r6(V.distance("v", "c", m)).alias(m) for m in ("euclidean", "manhattan", "cosine")])


# --- constraints ----------------------------------------------------------


@query(
    "constraints",
    """SELECT * FROM (
       SELECT 'unique' AS "constraint", '{"l_orderkey":' || l_orderkey || ',"l_linenumber":' || l_linenumber || '}' AS key, count(*) AS n_rows
         FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
       UNION ALL
       SELECT 'not null', '{"doc_id":' || doc_id || '}', 1 FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL
       UNION ALL
       SELECT 'domain', '{"o_orderkey":' || o_orderkey || '}', 1 FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
       UNION ALL
       SELECT 'orphan', '{"l_orderkey":' || l_orderkey || '}', count(*) FROM lineitem
         WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY l_orderkey)""",
)
def constraints(s, d):
    lines = table(s, d, "lineitem")
    orders = table(s, d, "orders")
    return C.union_results(
        filters.duplicate_keys(lines, ["l_orderkey", "l_linenumber"], "unique"),
        filters.null_columns(described(s, d), ["doc_id"], ["quality"], "not null"),
        filters.outside_domain(orders, ["o_orderkey"], "o_orderstatus", ["F", "O"], "domain"),
        filters.orphans(lines, orders.filter("o_orderstatus <> 'P'"), "l_orderkey", "o_orderkey", "orphan"),
    )


@query(
    "cascade_delete",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
)
def cascade_delete(s, d):
    kept = table(s, d, "customer").filter("c_acctbal > 0")
    return filters.cascade_delete(table(s, d, "orders"), kept, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query(
    "cascade_update",
    "SELECT o_orderkey, CASE WHEN c_acctbal < 0 THEN o_custkey + 1000000 ELSE o_custkey END AS o_custkey FROM orders JOIN customer ON c_custkey = o_custkey",
)
def cascade_update(s, d):
    moved = table(s, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") + 1000000).alias("new"))
    return filters.cascade_update(table(s, d, "orders").select("o_orderkey", "o_custkey"), moved, "o_custkey")


@query("noise_mask", "SELECT vec_id, label - 1 AS cluster_id FROM embeddings WHERE label <> 0")
def noise_mask(s, d):
    return filters.noise_mask(vectors(s, d).select("vec_id", (F.col("label") - 1).alias("cluster_id")))


# --- joins and sets --------------------------------------------------------


def cluster_table(s, d):
    """Two labelings in one table: k-means for most rows, density labels for some."""
    v = vectors(s, d)
    a = v.filter("label <> 2").select(F.col("vec_id").alias("song_id"), F.lit("kmeans").alias("algorithm"), F.col("label").alias("kmeans_cluster_id"))
    b = v.filter("label <> 5").select(
        F.col("vec_id").alias("song_id"), F.lit("dbscan").alias("algorithm"),
        F.when(F.element_at("v", 1) > 0, F.when(F.element_at("v", 2) > 0, 2).otherwise(1)).otherwise(-1).alias("dbscan_cluster_id"),
    )
    return C.union_results(a, b)


def songs(s, d):
    return vectors(s, d).select(F.col("vec_id").alias("song_id"), F.col("label").alias("artist_id"), F.col("v").alias("feature_vector"))


@query("songs_with_clusters", "SELECT vec_id AS song_id, label AS artist_id, label AS kmeans_cluster_id FROM embeddings WHERE label <> 2")
def songs_with_clusters(s, d):
    return C.songs_with_clusters(songs(s, d), cluster_table(s, d), "kmeans", require="kmeans_cluster_id").select("song_id", "artist_id", "kmeans_cluster_id")


PAIRS_SQL = """pairs AS (SELECT vec_id AS song_id, label AS label_a,
  CASE WHEN embedding[1] > 0 THEN CASE WHEN embedding[2] > 0 THEN 2 ELSE 1 END ELSE -1 END AS label_b FROM embeddings WHERE label NOT IN (2, 5))"""


def pairs(s, d):
    return C.label_pairs(songs(s, d), cluster_table(s, d), ("kmeans", "kmeans_cluster_id"), ("dbscan", "dbscan_cluster_id"))


query("label_pairs", f"WITH {PAIRS_SQL} SELECT * FROM pairs")(pairs)

ARI_SQL = """cells AS (SELECT label_a, label_b, count(*)::DOUBLE AS n FROM pairs GROUP BY 1, 2),
ra AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM cells GROUP BY label_a)),
rb AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM cells GROUP BY label_b)),
one AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM cells) AS s, (SELECT s FROM ra) AS ra, (SELECT s FROM rb) AS rb, (SELECT sum(n) FROM cells) AS n),
ari AS (SELECT (s - ra * rb / (n * (n - 1) / 2)) / ((ra + rb) / 2 - ra * rb / (n * (n - 1) / 2)) AS adjusted_rand FROM one)"""


@query("adjusted_rand", f"WITH {PAIRS_SQL}, {ARI_SQL} SELECT round(adjusted_rand, 6) + 0.0 AS adjusted_rand FROM ari")
def adjusted_rand(s, d):
    return quality.adjusted_rand(pairs(s, d)).select(r6("adjusted_rand").alias("adjusted_rand"))


@query(
    "compare_clusterings",
    f"""WITH {PAIRS_SQL}, {ARI_SQL} SELECT count(*) AS n, count(DISTINCT label_a) FILTER (label_a <> -1) AS clusters_a,
        count(DISTINCT label_b) FILTER (label_b <> -1) AS clusters_b, count(*) FILTER (label_a = -1) AS noise_a, count(*) FILTER (label_b = -1) AS noise_b,
        round((SELECT adjusted_rand FROM ari), 6) + 0.0 AS adjusted_rand FROM pairs""",
)
def compare_clusterings(s, d):
    return quality.compare_clusterings(pairs(s, d)).withColumn("adjusted_rand", r6("adjusted_rand"))


DONE_SQL = "done AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)"


def done_parts(s, d):
    return table(s, d, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 45").select("l_partkey")


@query("skip_processed", f"WITH {DONE_SQL} SELECT p_partkey, p_partkey NOT IN (SELECT l_partkey FROM done) AS todo FROM part")
def skip_processed(s, d):
    todo, done = C.skip_processed(table(s, d, "part").select("p_partkey"), done_parts(s, d), "p_partkey", "l_partkey")
    return todo.select("p_partkey", F.lit(True).alias("todo")).union(done.select("p_partkey", F.lit(False).alias("todo")))


@query("except_ids", f"WITH {DONE_SQL} SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM done)")
def except_ids(s, d):
    return C.except_ids(table(s, d, "part"), done_parts(s, d), "p_partkey", "l_partkey")


@query(
    "run_summary",
    f"""WITH {DONE_SQL} SELECT count(*) AS total, count(l_partkey) AS processed, count(*) - count(l_partkey) AS todo,
        round(count(l_partkey) * 100.0 / count(*), 6) + 0.0 AS percent_done, round(avg((p_size > 25)::INTEGER) * 100, 6) + 0.0 AS success_rate,
        round(avg(p_retailprice), 6) + 0.0 AS avg_seconds FROM part LEFT JOIN done ON l_partkey = p_partkey""",
)
def run_summary(s, d):
    part = table(s, d, "part").withColumn("ok", F.col("p_size") > 25)
    out = C.run_summary(part, done_parts(s, d), "p_partkey", "l_partkey", ok="ok", seconds="p_retailprice")
    return out.select("total", "processed", "todo", *[r6(c).alias(c) for c in ("percent_done", "success_rate", "avg_seconds")])


@query(
    "enrich_missing",
    """SELECT d.doc_id, coalesce(quality, 5) AS quality, CASE WHEN toxic IS NULL OR toxic = 0 THEN d.doc_id::INTEGER ELSE toxic END AS toxic
       FROM documents d LEFT JOIN labels USING (doc_id)""",
)
def enrich_missing(s, d):
    meta = table(s, d, "documents").select("doc_id", F.lit(5).alias("quality"), F.col("doc_id").cast("int").alias("toxic"))
    target = described(s, d).select("doc_id", "quality", "toxic")
    return C.enrich_missing(target, meta, "doc_id", {"quality": (), "toxic": (0,)})


@query("coalesce_fill", f"WITH {DOCS_SQL} SELECT doc_id, coalesce(quality, doc_id::INTEGER) AS quality FROM d")
def coalesce_fill(s, d):
    return described(s, d).select("doc_id", M.coalesce_fill("quality", F.col("doc_id").cast("int")).alias("quality"))


@query(
    "blank_fill",
    f"""WITH {HOSTS_SQL} SELECT page_id, CASE WHEN artist_name = '' OR artist_name = '2' THEN 'page ' || page_id ELSE artist_name END AS artist_name FROM h""",
)
def blank_fill(s, d):
    return paged(s, d).select("page_id", M.blank_fill("artist_name", F.concat(F.lit("page "), "page_id"), ("", "2")).alias("artist_name"))


@query("playlist_id", "SELECT page_id, nullif(regexp_extract(url, '//([a-zA-Z0-9.-]+)/en/', 1), '') AS playlist_id FROM pages")
def playlist_id(s, d):
    return table(s, d, "pages").select("page_id", M.playlist_id("url", r"//([a-zA-Z0-9.-]+)/en/").alias("playlist_id"))


@query(
    "song_metadata",
    """SELECT p_partkey, p_name AS song_name, CASE WHEN p_size > 5 THEN p_brand END AS artist_name,
              CASE WHEN p_size > 40 THEN '[{"id":"t","name":"' || p_type || '"}]' END AS sub_artists,
              p_size > 25 AS explicit, p_size AS popularity, p_partkey::INTEGER AS duration_ms, CASE WHEN p_size > 10 THEN '{"name":"' || p_type || '"}' END AS album FROM part""",
)
def song_metadata(s, d):
    ref = lambda i, n: F.struct(F.lit(i).alias("id"), F.col(n).alias("name"))
    none = F.array().cast("array<struct<id:string,name:string>>")
    record = F.struct(
        F.col("p_name").alias("name"),
        F.when(F.col("p_size") > 40, F.array(ref("b", "p_brand"), ref("t", "p_type"))).when(F.col("p_size") > 5, F.array(ref("b", "p_brand"))).otherwise(none).alias("artists"),
        (F.col("p_size") > 25).alias("explicit"), F.col("p_size").alias("popularity"), F.col("p_partkey").cast("int").alias("duration_ms"),
        F.when(F.col("p_size") > 10, F.struct(F.col("p_type").alias("name"))).alias("album"),
    )
    return table(s, d, "part").select("p_partkey", F.to_json(record).alias("t")).select("p_partkey", *M.song_metadata("t"))


@query(
    "artist_metadata",
    """SELECT c_custkey, c_name AS artist_name, c_nationkey AS followers, CASE WHEN c_acctbal > 0 THEN '["' || c_mktsegment || '"]' END AS genres,
              CASE WHEN c_nationkey > 10 THEN '[{"url":"u' || c_custkey || '","height":1,"width":2}]' END AS images, c_nationkey + 1 AS popularity FROM customer""",
)
def artist_metadata(s, d):
    image = F.struct(F.concat(F.lit("u"), "c_custkey").alias("url"), F.lit(1).alias("height"), F.lit(2).alias("width"))
    record = F.struct(
        F.col("c_name").alias("name"), F.struct(F.col("c_nationkey").alias("total")).alias("followers"),
        F.when(F.col("c_acctbal") > 0, F.array("c_mktsegment")).otherwise(F.array().cast("array<string>")).alias("genres"),
        F.when(F.col("c_nationkey") > 10, F.array(image)).alias("images"), (F.col("c_nationkey") + 1).alias("popularity"),
    )
    return table(s, d, "customer").select("c_custkey", F.to_json(record).alias("t")).select("c_custkey", *M.artist_metadata("t"))


@query(
    "union_results",
    """SELECT vec_id AS song_id, 'kmeans' AS algorithm, label AS kmeans_cluster_id, NULL::INTEGER AS dbscan_cluster_id FROM embeddings WHERE label <> 2
       UNION ALL SELECT vec_id, 'dbscan', NULL, CASE WHEN embedding[1] > 0 THEN CASE WHEN embedding[2] > 0 THEN 2 ELSE 1 END ELSE -1 END FROM embeddings WHERE label <> 5""",
)
def union_results(s, d):
    return cluster_table(s, d)


# --- scores ---------------------------------------------------------------

SUPPLY_SQL = """g AS (SELECT l_suppkey AS cfg, (avg(l_discount) * 1000 - 48) / 5 AS silhouette, (avg(l_quantity) - 24.5) / 2 AS balance,
  (sum(round(l_tax * 100)::BIGINT) * 10 // count(*) - 36)::INTEGER AS n_clusters, abs(avg(l_tax) * 1000 - 40) / 10 AS noise_ratio, count(*) AS size, (avg(l_discount) * 1000 - 49) / 3 AS s2 FROM lineitem GROUP BY 1)"""


def settings(s, d):
    """One made setting per supplier, so that scoring rules see varied input."""
    return snapshot(table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("cfg")).agg(
        ((F.avg("l_discount") * 1000 - 48) / 5).alias("silhouette"), ((F.avg("l_quantity") - 24.5) / 2).alias("balance"),
        F.expr("cast(sum(cast(round(l_tax * 100) as bigint)) * 10 div count(*) - 36 as int)").alias("n_clusters"), (F.abs(F.avg("l_tax") * 1000 - 40) / 10).alias("noise_ratio"), F.count("*").alias("size"),
        ((F.avg("l_discount") * 1000 - 49) / 3).alias("s2"),
    ))


@query(
    "quality_label",
    f"""WITH {SUPPLY_SQL} SELECT cfg,
        CASE WHEN n_clusters >= 2 AND noise_ratio <= 0.05 THEN CASE WHEN n_clusters <= 10 THEN 'EXCELLENT' ELSE 'GOOD' END
             WHEN n_clusters >= 2 AND noise_ratio <= 0.20 THEN 'FAIR' ELSE 'POOR' END AS density,
        CASE WHEN silhouette >= 0.5 AND balance >= 0.5 THEN 'EXCELLENT' WHEN silhouette >= 0.3 AND balance >= 0.3 THEN 'GOOD'
             WHEN silhouette >= 0.1 AND balance >= 0.1 THEN 'FAIR' ELSE 'POOR' END AS balanced,
        CASE WHEN s2 > 0.7 THEN 'Excellent' WHEN s2 > 0.5 THEN 'Good' WHEN s2 > 0.25 THEN 'Fair' ELSE 'Poor' END AS band FROM g""",
)
def quality_label(s, d):
    return settings(s, d).select(
        "cfg", scores.density_quality("n_clusters", "noise_ratio").alias("density"), scores.balance_quality("silhouette", "balance").alias("balanced"),
        scores.silhouette_quality("s2").alias("band"),
    )


@query(
    "dbscan_confidence",
    """SELECT vec_id, round(greatest(0.1, least(1.0, CASE WHEN label = 0 THEN 0.1 WHEN label < 5 THEN 0.9 ELSE 0.6 END
          * CASE WHEN label <> 0 AND n > 0 THEN 0.7 + 0.3 * least(1.0, n / 100.0::DOUBLE) ELSE 1.0 END
          * CASE WHEN embedding[1] > 0 THEN 0.8 + 0.2 * least(1.0, embedding[1]::DOUBLE * 2) ELSE 1.0 END)), 6) + 0.0 AS confidence,
          CASE WHEN label = 0 THEN 0.1 WHEN label < 5 THEN 0.8 ELSE 0.5 END::DOUBLE AS fallback
       FROM embeddings JOIN (SELECT label, count(*)::DOUBLE AS n FROM embeddings GROUP BY 1) USING (label)""",
)
def dbscan_confidence(s, d):
    v = vectors(s, d)
    rows = v.join(v.groupBy("label").agg(F.count("*").alias("n")), "label")
    noise, core = F.col("label") == 0, F.col("label") < 5
    return rows.select(
        "vec_id", r6(scores.dbscan_confidence(noise, core, F.col("n"), F.element_at("v", 1))).alias("confidence"),
        scores.dbscan_confidence_fallback(noise, core).cast("double").alias("fallback"),
    )


@query(
    "hier_confidence",
    """SELECT vec_id, round(greatest(0.1, least(1.0, (embedding[1]::DOUBLE * 4 + 1) / 2)), 6) + 0.0 AS confidence,
              round(CASE WHEN embedding[2] > 0 THEN embedding[2]::DOUBLE ELSE 0.1 END, 6) + 0.0 AS distance FROM embeddings""",
)
def hier_confidence(s, d):
    return vectors(s, d).select(
        "vec_id", r6(scores.hier_confidence(F.element_at("v", 1) * 4)).alias("confidence"), r6(scores.hier_distance(F.element_at("v", 2))).alias("distance")
    )


@query("composite_score", f"WITH {SUPPLY_SQL} SELECT cfg, round(0.4 * silhouette + 0.6 * balance, 6) + 0.0 AS composite FROM g")
def composite_score(s, d):
    return settings(s, d).select("cfg", r6(scores.composite_score("silhouette", "balance")).alias("composite"))


@query(
    "top_configs",
    f"""WITH {SUPPLY_SQL} SELECT cfg, round(0.4 * silhouette + 0.6 * balance, 6) + 0.0 AS composite,
        (row_number() OVER (ORDER BY 0.4 * silhouette + 0.6 * balance DESC, cfg))::INTEGER AS rank FROM g QUALIFY rank <= 5""",
)
def top_configs(s, d):
    from vecloom.operators.density import top_configs as top

    scored = settings(s, d).withColumn("composite", scores.composite_score("silhouette", "balance"))
    return top(scored, "composite").select("cfg", r6("composite").alias("composite"), "rank")


GRID_SQL = SUPPLY_SQL + """, gr AS (SELECT cfg / 100.0::DOUBLE AS eps, n_clusters AS min_samples, n_clusters, noise_ratio * 4 AS noise_ratio,
  CASE WHEN n_clusters > 1 THEN s2 END AS silhouette FROM g)"""


def grid_like(s, d):
    return settings(s, d).select(
        (F.col("cfg") / 100.0).alias("eps"), F.col("n_clusters").alias("min_samples"), "n_clusters", (F.col("noise_ratio") * 4).alias("noise_ratio"),
        F.when(F.col("n_clusters") > 1, F.col("s2")).otherwise(F.lit(float("nan"))).alias("silhouette"),
    )


@query(
    "recommend_params",
    f"""WITH {GRID_SQL} SELECT eps, min_samples, round(silhouette, 6) + 0.0 AS silhouette FROM gr
        WHERE n_clusters >= 2 AND noise_ratio <= 0.5 AND silhouette IS NOT NULL ORDER BY gr.silhouette DESC, min_samples, eps LIMIT 3""",
)
def recommend_params(s, d):
    from vecloom.operators.density import recommend_params as recommend

    return recommend(grid_like(s, d)).select("eps", "min_samples", r6("silhouette").alias("silhouette"))


@query(
    "best_params",
    f"""WITH {GRID_SQL}
        (SELECT 'silhouette' AS criterion, eps, min_samples, round(silhouette, 6) + 0.0 AS silhouette FROM gr WHERE silhouette IS NOT NULL
         ORDER BY gr.silhouette DESC, eps, min_samples LIMIT 1)
        UNION ALL
        (SELECT 'balanced', eps, min_samples, round(silhouette, 6) + 0.0 FROM gr WHERE silhouette IS NOT NULL AND noise_ratio < 0.3 AND n_clusters > 1
         ORDER BY gr.silhouette DESC, eps, min_samples LIMIT 1)""",
)
def best_params(s, d):
    from vecloom.operators.density import best_params as best

    return best(grid_like(s, d)).select("criterion", "eps", "min_samples", r6("silhouette").alias("silhouette"))


AIC_SQL = """m AS (SELECT label + 2 AS k, -sum(list_sum(list_transform(embedding::DOUBLE[], lambda x: abs(x)))) AS ll FROM embeddings GROUP BY 1)"""


@query(
    "aic_bic",
    f"""WITH {AIC_SQL} SELECT k, round(2 * p - 2 * ll, 4) + 0.0 AS aic, round(ln((SELECT count(*) FROM embeddings)) * p - 2 * ll, 4) + 0.0 AS bic
        FROM (SELECT *, k * 64 + k * 64 * 65 // 2 + (k - 1) AS p FROM m)""",
)
def aic_bic(s, d):
    from vecloom.operators.gmm import aic_bic as criteria

    v = vectors(s, d)
    rows = v.count()
    m = v.groupBy((F.col("label") + 2).alias("k")).agg((-F.sum(V._total(F.transform("v", F.abs)))).alias("ll"))
    return criteria(m, "ll", "k", 64, rows).select("k", r6("aic", 4).alias("aic"), r6("bic", 4).alias("bic"))


@query(
    "validate_labels",
    """SELECT count(*) > 0 AS non_empty, min(label) >= 0 AS non_negative, min(label) = 0 AND max(label) = count(DISTINCT label) - 1 AS contiguous,
              min(label) >= 0 AND max(label) <= 8 AS in_range, count(*) > 0 AND min(label) >= 0 AND max(label) <= 8 AS valid FROM embeddings""",
)
def validate_labels(s, d):
    return quality.validate_labels(vectors(s, d), "label", 0, 8)


@query(
    "eps_suggestions",
    """WITH RECURSIVE c AS (SELECT vec_id, list_sort(list_filter(list_transform(embedding[1:5], lambda x: x::DOUBLE), lambda x: x > 0)) AS a FROM embeddings),
       r(vec_id, i, kept) AS (
         SELECT vec_id, 1, []::DOUBLE[] FROM c
         UNION ALL
         SELECT r.vec_id, i + 1, CASE WHEN len(kept) = 0 OR abs(a[i] - kept[len(kept)]) > 0.1 * a[i] THEN list_append(kept, a[i]) ELSE kept END
         FROM r JOIN c USING (vec_id) WHERE i <= len(a))
       SELECT vec_id, least(len(kept), 3)::INTEGER AS n, round(coalesce(kept[1], 0.0), 6) + 0.0 AS first, round(coalesce(kept[3], 0.0), 6) + 0.0 AS third
       FROM r JOIN c USING (vec_id) WHERE i = len(a) + 1""",
)
def eps_suggestions(s, d):
    got = vectors(s, d).select("vec_id", scores.eps_suggestions(F.slice("v", 1, 5)).alias("eps"))
    return got.select(
        "vec_id", F.size("eps").alias("n"), r6(F.coalesce(F.get("eps", F.lit(0)), F.lit(0.0))).alias("first"),
        r6(F.coalesce(F.get("eps", F.lit(2)), F.lit(0.0))).alias("third"),
    )


@query(
    "eps_candidates",
    """WITH s AS (SELECT label AS min_samples, max(embedding[1]::DOUBLE) AS a, max(embedding[2]::DOUBLE) AS b FROM embeddings GROUP BY 1),
       every AS (SELECT a AS e FROM s UNION ALL SELECT b FROM s),
       ends AS (SELECT min(e) * 0.5 AS lo, max(e) * 1.5 AS hi FROM every),
       pool AS (SELECT DISTINCT round_even(e, 3) AS e FROM (SELECT e FROM every UNION ALL SELECT lo + (hi - lo) * i / 4.0::DOUBLE FROM ends, range(5) t(i))),
       shape AS (SELECT min(e) AS lo, max(e) AS hi FROM pool)
       SELECT round_even(lo + (hi - lo) * i / 4.0::DOUBLE, 3) AS eps, m AS min_samples FROM shape, range(5) t(i), (SELECT unnest([3, 6, 10]) AS m)""",
)
def eps_candidates(s, d):
    found = vectors(s, d).groupBy(F.col("label").alias("min_samples")).agg(F.array(F.max(F.element_at("v", 1)), F.max(F.element_at("v", 2))).alias("eps"))
    return C.eps_candidates(s, found)
