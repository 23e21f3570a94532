"""Scans, readers and writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecloom.operators import catalog, filters
from vecloom.session import scratch_path, snapshot
from vecloom.sources import buckets, records, sinks, tables
from workload.common import query, r6, table, vectors
from workload.signals import SEGMENT_SQL, song_parts

query("scan", "SELECT * FROM customer")(lambda s, d: tables.scan(s, f"{d}/customer.parquet"))

query("scan_paged", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000 OFFSET 2000")(
    lambda s, d: tables.scan_page(table(s, d, "orders"), "o_orderkey", 2, 1000).select("o_orderkey", "o_custkey", "o_totalprice")
)

query("scan_pages", "SELECT o_orderkey, o_totalprice, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS page FROM orders")(
    lambda s, d: tables.scan_pages(tables.scan_cols(s, f"{d}/orders.parquet", "o_orderkey", "o_totalprice"), "o_orderkey", 1000)
)

query("row_count", "SELECT count(*) AS n FROM lineitem")(lambda s, d: tables.row_count(table(s, d, "lineitem")))

query("scan_cols", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders")(
    lambda s, d: tables.scan_cols(s, f"{d}/orders.parquet", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
)


@query(
    "lookup_json_list",
    """SELECT (unnest(range(len(w))))::INTEGER AS pos, unnest(w) AS item
       FROM (SELECT string_split(text, ' ') AS w FROM documents WHERE doc_id = 1)""",
)
def lookup_json_list(s, d):
    docs = table(s, d, "documents").select("doc_id", F.to_json(F.split("text", " ")).alias("data"))
    return tables.lookup_json_list(docs, "doc_id", 1, "data")


@query(
    "read_features_json",
    SEGMENT_SQL
    + """
    SELECT 'signal ' || f.user_id AS song, round(f.duration_sec, 4) + 0.0 AS duration_sec, f.segments,
           round(avg(s.rms), 6) + 0.0 AS rms_mean, round(avg(s.bpm) * 3 / 7.3, 6) + 0.0 AS third_coefficient, 128 AS emb_size
    FROM signal f JOIN seg s USING (user_id) GROUP BY f.user_id, f.duration_sec, f.segments""",
)
def read_features_json(s, d):
    segments, items = song_parts(s, d)
    from vecloom.operators.segments import song_features

    kept, _ = song_features(segments, items, "user_id")
    path = scratch_path(s, "features")
    kept.select(
        F.concat(F.lit("signal "), F.col("user_id")).alias("song"), F.lit("events").alias("artist"), "audio_features"
    ).write.json(path)
    f = F.col("audio_features")
    return records.read_features_json(s, path, multiline=False).select(
        "song", r6(f["duration_sec"], 4).alias("duration_sec"), f["segments"].alias("segments"), r6(f["rms"]["mean"]).alias("rms_mean"),
        r6(f["mfcc_mean"][2]["mean"]).alias("third_coefficient"), F.size(f["vggish_emb"]).alias("emb_size"),
    )


def playlist_pages(s, d):
    """Conversations as stored playlist pages of up to four items.

    System turns lack a name, user turns have no artist.
    """
    turns = table(s, d, "conversations")
    track = F.struct(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        F.when(F.col("role") != "system", F.col("text")).alias("name"),
        F.when(F.col("role") == "assistant", F.array(F.struct(F.lit("a1").alias("id"), F.col("role").alias("name"))))
        .otherwise(F.array().cast("array<struct<id:string,name:string>>")).alias("artists"),
    )
    items = F.transform(F.array_sort(F.collect_list(F.struct("turn", track.alias("track")))), lambda x: F.struct(x["track"].alias("track")))
    return (
        turns.groupBy("conv_id", (F.floor(F.col("turn") / 4) * 4).alias("offset"))
        .agg(items.alias("items"))
        .select(F.col("conv_id").cast("string").alias("playlist_id"), "offset", "items")
    )


@query(
    "read_playlist_items",
    """SELECT conv_id::VARCHAR AS playlist_id, conv_id || '-' || turn AS song_id,
              CASE WHEN role = 'assistant' THEN 'a1' ELSE 'unknown' END AS artist_id, text AS song_name,
              CASE WHEN role = 'assistant' THEN role ELSE 'Unknown Artist' END AS artist_name
       FROM conversations WHERE role <> 'system'""",
)
def read_playlist_items(s, d):
    path = scratch_path(s, "pages")
    playlist_pages(s, d).write.json(path)
    return records.playlist_items(records.read_playlist_pages(s, path)).drop("position")


@query("append", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def append(s, d):
    orders = table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    path = scratch_path(s, "orders")
    sinks.append(orders.filter("o_orderstatus = 'F'"), path)
    sinks.append(orders.filter("o_orderstatus <> 'F'"), path)
    return s.read.schema(orders.schema).parquet(path)


@query(
    "insert_ignore",
    """SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, l_extendedprice FROM (
         SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS rn
         FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)) WHERE rn = 1""",
)
def insert_ignore(s, d):
    cols = ["l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]
    arriving = table(s, d, "lineitem").select(*cols)
    stored = table(s, d, "part").filter("p_size > 25").select(
        F.col("p_partkey").alias("l_partkey"), *[F.lit(None).cast(arriving.schema[c].dataType).alias(c) for c in cols[1:]]
    )
    return sinks.insert_ignore(stored, arriving, ["l_partkey"], cols[1:])


def stored_and_new(s, d):
    """A stored cluster table and incoming result rows that overlap it."""
    v = vectors(s, d)
    stored = v.filter("label < 6").select(
        F.col("vec_id").alias("song_id"), F.lit("kmeans").alias("algorithm"), F.col("label").alias("kmeans_cluster_id"),
        F.element_at("v", 1).alias("kmeans_distance"), F.lit(0.5).alias("confidence"),
        F.lit(7).cast("bigint").alias("kmeans_cluster_size"),
    )
    new = v.filter("label >= 3").select(
        F.col("vec_id").alias("song_id"), F.lit("kmeans").alias("algorithm"), (F.col("label") + 100).alias("kmeans_cluster_id"),
        F.when(F.col("label") != 4, F.element_at("v", 2)).alias("kmeans_distance"), F.lit(0.9).alias("confidence"),
    )
    return stored, new


@query(
    "upsert",
    """SELECT vec_id AS song_id, 'kmeans' AS algorithm,
              CASE WHEN label >= 3 THEN label + 100 ELSE label END AS kmeans_cluster_id,
              round(CASE WHEN label = 4 THEN NULL WHEN label >= 3 THEN embedding[2]::DOUBLE ELSE embedding[1]::DOUBLE END, 6) + 0.0 AS kmeans_distance,
              CASE WHEN label >= 3 THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS confidence,
              CASE WHEN label < 6 THEN 7::BIGINT END AS kmeans_cluster_size
       FROM embeddings""",
)
def upsert(s, d):
    stored, new = stored_and_new(s, d)
    state = sinks.upsert(stored, new)
    return state.withColumn("kmeans_distance", r6("kmeans_distance"))


@query(
    "upsert_buckets",
    """SELECT c_custkey, round(CASE WHEN b % 4 = 1 THEN c_acctbal + 1 ELSE c_acctbal END, 6) + 0.0 AS c_acctbal, b % 4 = 1 AS rewritten
       FROM (SELECT *, c_custkey % 16 AS b FROM customer)""",
)
def upsert_buckets(s, d):
    """Customers in sixteen buckets of their key; changes reach every fourth bucket, and only its files are new."""
    rows, path, by = table(s, d, "customer").select("c_custkey", "c_acctbal"), scratch_path(s, "customers"), F.pmod("c_custkey", F.lit(16))
    file = F.col("_metadata.file_path")
    stored = buckets.create(rows, path, by)
    before = snapshot(s.read.parquet(path).select(file.alias("old_file")).distinct(), "files")
    changed = rows.where(F.pmod("c_custkey", F.lit(4)) == 1).withColumn("c_acctbal", F.col("c_acctbal") + 1)
    buckets.upsert(stored, path, changed, by, ["c_custkey"], ["c_acctbal"])
    now = s.read.parquet(path).select("c_custkey", r6("c_acctbal").alias("c_acctbal"), file.alias("file"))
    return now.join(before, now.file == before.old_file, "left").select("c_custkey", "c_acctbal", F.col("old_file").isNull().alias("rewritten"))


@query(
    "update_by_key",
    """SELECT c_custkey, round(coalesce(a.m, c_acctbal), 6) + 0.0 AS c_acctbal
       FROM customer LEFT JOIN (SELECT o_custkey, avg(o_totalprice) AS m FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) a ON o_custkey = c_custkey""",
)
def update_by_key(s, d):
    target = table(s, d, "customer").select("c_custkey", "c_acctbal")
    new = (
        table(s, d, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("c_acctbal"))
    )
    return sinks.update_by_key(target, new, "c_custkey", "c_acctbal").withColumn("c_acctbal", r6("c_acctbal"))


@query(
    "update_by_group",
    """SELECT vec_id AS song_id, CASE WHEN label < 6 THEN 'kmeans' ELSE 'gmm' END AS algorithm, label AS kmeans_cluster_id,
              CASE WHEN label < 6 THEN n ELSE 0 END AS kmeans_cluster_size
       FROM embeddings JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) USING (label)""",
)
def update_by_group(s, d):
    rows = vectors(s, d).select(
        F.col("vec_id").alias("song_id"), F.when(F.col("label") < 6, "kmeans").otherwise("gmm").alias("algorithm"),
        F.col("label").alias("kmeans_cluster_id"), F.lit(0).cast("bigint").alias("kmeans_cluster_size"),
    )
    metrics = rows.groupBy("kmeans_cluster_id").agg(F.count("*").alias("kmeans_cluster_size"))
    return sinks.update_by_group(rows, metrics, "kmeans_cluster_id", ["kmeans_cluster_size"], F.col("algorithm") == "kmeans")


@query(
    "error_sink",
    "SELECT event_id, user_id, 'too long' AS error FROM events WHERE value > 50",
)
def error_sink(s, d):
    _, rejects = filters.max_duration(table(s, d, "events"), "value", 50.0)
    path = scratch_path(s, "errors")
    sinks.error_sink(rejects, path, ["event_id", "user_id"])
    return sinks.read_errors(s, path, "event_id bigint, user_id bigint, error string, timestamp string").drop("timestamp")


@query(
    "cap_per_playlist",
    "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn <= 4",
)
def cap_per_playlist(s, d):
    return catalog.cap_per_playlist(table(s, d, "conversations"), "conv_id", ["turn"], cap=4).select("conv_id", "turn", "role")


query("first_n", "SELECT page_id, url FROM pages ORDER BY page_id LIMIT 10")(
    lambda s, d: catalog.first_n(table(s, d, "pages").select("page_id", "url"), "page_id", 10)
)

query("sample_n", "SELECT vec_id, label FROM embeddings ORDER BY md5(concat(vec_id, ':42')), vec_id LIMIT 100")(lambda s, d: catalog.sample_n(vectors(s, d).select("vec_id", "label"), "vec_id", 100, 42))

