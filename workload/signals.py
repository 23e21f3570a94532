"""Signals and segments: ``events`` read as one signal per user.

A signal's samples are its events, ``t`` seconds after its first one; a
segment is five days long.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from vecloom.functions import vectors as V
from vecloom.operators import filters, segments as S
from workload.common import long, query, r6, sql_long, table

LENGTH = 432000.0


def samples(s, d):
    ev = table(s, d, "events").select(
        "event_id", "user_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )
    start = ev.groupBy("user_id").agg(F.min("us").alias("us0"), F.avg("value").alias("mean"))
    return ev.join(start, "user_id").select(
        "event_id", "user_id", "value", "k", ((F.col("us") - F.col("us0")) / 1e6).alias("t"), (F.col("value") - F.col("mean")).alias("centred")
    )


def segmented(s, d):
    return S.assign_segments(samples(s, d), "user_id", "t", LENGTH)


def segment_rows(s, d):
    """One measured row per segment, in the segment schema."""
    mean, spread = F.avg("value"), F.stddev_pop("value")
    scalars = segmented(s, d).groupBy("user_id", "segment").agg(
        F.count("*").alias("n_samples"), mean.alias("bpm"), F.min("value").alias("chroma_stft"), F.max("value").alias("spectral_centroid"),
        (F.max("value") - F.min("value")).alias("spectral_bandwidth"), F.sum("value").alias("rolloff"),
        F.avg((F.col("value") > 20).cast("double")).alias("zero_crossing_rate"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"),
        F.avg("k").alias("onset_env_mean"), F.count("*").cast("double").alias("onset_count"), mean.alias("loudness_mean"),
        spread.alias("loudness_std"), F.max("value").alias("loudness_max"), F.min("value").alias("loudness_min"),
    )
    return scalars.select(
        "*",
        F.transform(F.sequence(F.lit(1), F.lit(13)), lambda i: F.col("bpm") * i / 7.3).alias("mfcc_mean"),
        F.transform(F.sequence(F.lit(1), F.lit(13)), lambda i: F.col("loudness_std") / i).alias("mfcc_std"),
        F.transform(F.sequence(F.lit(1), F.lit(128)), lambda i: F.col("onset_env_mean") / (i * 7.3)).alias("vggish_emb"),
    )


def song_parts(s, d):
    items = samples(s, d).groupBy("user_id").agg(
        F.max("t").alias("duration_sec"),
        F.greatest(F.lit(1), F.floor(F.max("t") / LENGTH).cast("int")).alias("segments"),
        F.avg("value").alias("global_bpm"),
    )
    return segment_rows(s, d), items


SAMPLE_SQL = f"""WITH ev AS (
  SELECT event_id, user_id, value, epoch_us(ts) AS us, json_extract_string(props, '$.k')::DOUBLE AS k FROM events),
smp AS (
  SELECT event_id, user_id, value, k, (us - min(us) OVER w) / 1e6 AS t, value - avg(value) OVER w AS centred
  FROM ev WINDOW w AS (PARTITION BY user_id)),
signal AS (
  SELECT user_id, max(t) AS duration_sec, greatest(1, floor(max(t) / {LENGTH})::INTEGER) AS segments, avg(value) AS global_bpm
  FROM smp GROUP BY user_id),
cut AS (
  SELECT s.*, g.segments AS n_segments, floor(t / {LENGTH})::INTEGER AS segment FROM smp s JOIN signal g USING (user_id)
  WHERE floor(t / {LENGTH}) < g.segments)"""

SEGMENT_SQL = SAMPLE_SQL + """,
seg AS (
  SELECT user_id, segment, count(*) AS n_samples, avg(value) AS bpm, min(value) AS chroma_stft, max(value) AS spectral_centroid,
         max(value) - min(value) AS spectral_bandwidth, sum(value) AS rolloff, avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END) AS zero_crossing_rate,
         sqrt(avg(value * value)) AS rms, avg(k) AS onset_env_mean, count(*)::DOUBLE AS onset_count, avg(value) AS loudness_mean,
         stddev_pop(value) AS loudness_std, max(value) AS loudness_max, min(value) AS loudness_min
  FROM cut GROUP BY user_id, segment)"""


def _stat_sql(column: str) -> str:
    return (
        f"round(avg({column}), 6) + 0.0 AS mean, round(stddev_pop({column}), 6) + 0.0 AS std, "
        f"round(min({column}), 6) + 0.0 AS min, round(max({column}), 6) + 0.0 AS max"
    )


@query(
    "assign_segments",
    SAMPLE_SQL + " SELECT event_id, user_id, segment, n_segments FROM cut",
)
def assign_segments(s, d):
    return segmented(s, d).select("event_id", "user_id", "segment", "n_segments")


@query(
    "segment_energy",
    SAMPLE_SQL
    + """, f AS (SELECT *, coalesce(abs((centred < 0)::INTEGER - lag((centred < 0)::INTEGER) OVER (PARTITION BY user_id, segment ORDER BY t, event_id)), 0) AS flip FROM cut)
    SELECT user_id, segment, count(*) AS n_samples, round(sqrt(avg(centred * centred)), 6) + 0.0 AS rms,
           round(sum(flip)::DOUBLE / count(*), 6) + 0.0 AS zero_crossing_rate FROM f GROUP BY 1, 2""",
)
def segment_energy(s, d):
    e = S.segment_energy(segmented(s, d), "user_id", "segment", ["t", "event_id"], "centred")
    return e.withColumn("rms", r6("rms")).withColumn("zero_crossing_rate", r6("zero_crossing_rate"))


def peak_features(values: np.ndarray) -> dict:
    """A small stand-in for a measuring function; short segments fail."""
    if len(values) < 8:
        raise ValueError("segment too short")
    return {"bpm": float(len(values)), "rms": float(np.sqrt(np.mean(values * values))), "rolloff": float(values.sum())}


@query(
    "segment_featurize",
    SAMPLE_SQL
    + """ SELECT user_id, segment, CASE WHEN count(*) >= 8 THEN count(*)::DOUBLE END AS bpm,
          CASE WHEN count(*) >= 8 THEN round(sqrt(avg(value * value)), 6) + 0.0 END AS rms,
          CASE WHEN count(*) < 8 THEN 'ValueError: segment too short' END AS reason FROM cut GROUP BY 1, 2""",
)
def segment_featurize(s, d):
    good, bad = S.segment_featurize(segmented(s, d), "user_id", "segment", "value", "t", peak_features)
    return good.select("user_id", "segment", "bpm", r6("rms").alias("rms"), F.lit(None).cast("string").alias("reason")).unionByName(
        bad.select("user_id", "segment", F.lit(None).cast("double").alias("bpm"), F.lit(None).cast("double").alias("rms"), "reason")
    )


@query(
    "segment_gate",
    SEGMENT_SQL + " SELECT user_id, segment, n_samples, round(rms, 6) + 0.0 AS rms FROM seg WHERE n_samples >= 10 AND rms >= 25",
)
def segment_gate(s, d):
    kept = filters.segment_gate(segment_rows(s, d), "n_samples", 10, "rms", 25.0)
    return kept.select("user_id", "segment", "n_samples", r6("rms").alias("rms"))


@query("max_duration", SAMPLE_SQL + " SELECT user_id, duration_sec > 2500000 AS rejected FROM signal")
def max_duration(s, d):
    _, items = song_parts(s, d)
    kept, rejects = filters.max_duration(items, "duration_sec", 2_500_000.0)
    return kept.select("user_id", F.lit(False).alias("rejected")).union(rejects.select("user_id", F.lit(True).alias("rejected")))


@query("segment_stats", SEGMENT_SQL + f" SELECT user_id, {_stat_sql('rms')} FROM seg GROUP BY 1")
def segment_stats(s, d):
    st = S.segment_stats(segment_rows(s, d), "user_id", "rms")
    return st.select("user_id", *[r6(F.col("stat")[n]).alias(n) for n in ("mean", "std", "min", "max")])


@query(
    "segment_stats_vec",
    SEGMENT_SQL
    + """ SELECT user_id, i - 1 AS pos, round(avg(bpm * i / 7.3), 6) + 0.0 AS mean, round(stddev_pop(bpm * i / 7.3), 6) + 0.0 AS std
    FROM seg JOIN (SELECT unnest(range(1, 14))::INTEGER AS i) ON TRUE GROUP BY 1, 2""",
)
def segment_stats_vec(s, d):
    m = S.segment_stats_vec(segment_rows(s, d), "user_id", "mfcc_mean").select("user_id", F.posexplode("moments").alias("pos", "m"))
    return m.select("user_id", "pos", r6("m.mean").alias("mean"), r6("m.std").alias("std"))


@query(
    "mean_pool",
    SEGMENT_SQL
    + """ SELECT user_id, i - 1 AS pos, round(coalesce(avg(onset_env_mean / (i * 7.3)) FILTER (rms >= 25), 0.0), 6) + 0.0 AS x
    FROM seg JOIN (SELECT unnest(range(1, 129))::INTEGER AS i) ON TRUE GROUP BY 1, 2""",
)
def mean_pool(s, d):
    rows = segment_rows(s, d)
    pooled = S.mean_pool(rows.filter("rms >= 25"), "user_id", "vggish_emb", items=rows)
    return long(pooled, "pooled", "user_id")


@query(
    "loudness_rollup",
    SEGMENT_SQL
    + """ SELECT user_id, round(avg(loudness_mean), 6) + 0.0 AS mean, round(avg(loudness_std), 6) + 0.0 AS std,
          round(min(loudness_min), 6) + 0.0 AS min, round(max(loudness_max), 6) + 0.0 AS max FROM seg GROUP BY 1""",
)
def loudness_rollup(s, d):
    rolled = S.loudness_rollup(segment_rows(s, d), "user_id")
    return rolled.select("user_id", *[r6(F.col("loudness")[n]).alias(n) for n in ("mean", "std", "min", "max")])


def _song_sql() -> str:
    stats = ["bpm", "chroma_stft", "spectral_centroid", "spectral_bandwidth", "rolloff", "zero_crossing_rate", "rms"]
    four = lambda c: f"avg({c}), stddev_pop({c}), min({c}), max({c})"
    head = ", ".join(four(c) for c in stats)
    tail = ", ".join(four(c) for c in ("onset_env_mean", "onset_count"))
    return SEGMENT_SQL + f""", agg AS (
      SELECT user_id, [{head}] AS head, avg(bpm) AS mb, stddev_pop(bpm) AS sb, avg(loudness_std) AS ms, stddev_pop(loudness_std) AS ss,
             [{tail}, avg(loudness_mean), avg(loudness_std), min(loudness_min), max(loudness_max)] AS tail, avg(onset_env_mean) AS me
      FROM seg WHERE rms >= 25 GROUP BY user_id),
    flat AS (
      SELECT user_id, list_concat([duration_sec, segments::DOUBLE, global_bpm], head,
        flatten(list_transform(range(1, 14), lambda i: [mb * i / 7.3, sb * i / 7.3])),
        flatten(list_transform(range(1, 14), lambda i: [ms / i, ss / i])),
        tail, list_transform(range(1, 129), lambda i: me / (i * 7.3))) AS v
      FROM agg JOIN signal USING (user_id))"""


def flat_songs(s, d):
    rows, items = song_parts(s, d)
    kept, rejects = S.song_features(rows, items, "user_id", min_rms=25.0)
    return kept, rejects


@query("flatten_features", _song_sql() + " " + sql_long("flat", "v", "user_id"))
def flatten_features(s, d):
    kept, _ = flat_songs(s, d)
    return long(kept.select("user_id", V.flatten_features("audio_features").alias("v")), "v", "user_id")


@query(
    "song_features",
    SEGMENT_SQL
    + """ SELECT f.user_id, round(max(f.duration_sec), 4) + 0.0 AS duration_sec, max(f.segments) AS segments, round(max(f.global_bpm), 6) + 0.0 AS global_bpm,
      round(avg(s.spectral_centroid), 6) + 0.0 AS centroid_mean, round(stddev_pop(s.onset_count), 6) + 0.0 AS onset_std,
      round(avg(s.loudness_std), 6) + 0.0 AS loudness_std, round(stddev_pop(s.bpm) * 13 / 7.3, 6) + 0.0 AS last_coefficient_std,
      round(avg(s.onset_env_mean) / (128 * 7.3), 6) + 0.0 AS last_emb, CASE WHEN count(s.user_id) = 0 THEN 'no segment kept' END AS reason
    FROM signal f LEFT JOIN (SELECT * FROM seg WHERE rms >= 25) s USING (user_id) GROUP BY f.user_id""",
)
def song_features(s, d):
    kept, rejects = flat_songs(s, d)
    f = F.col("audio_features")
    good = kept.select(
        "user_id", r6(f["duration_sec"], 4).alias("duration_sec"), f["segments"].alias("segments"), r6(f["global_bpm"]).alias("global_bpm"),
        r6(f["spectral_centroid"]["mean"]).alias("centroid_mean"), r6(f["onset_count"]["std"]).alias("onset_std"), r6(f["loudness"]["std"]).alias("loudness_std"),
        r6(f["mfcc_mean"][12]["std"]).alias("last_coefficient_std"), r6(f["vggish_emb"][127]).alias("last_emb"), F.lit(None).cast("string").alias("reason"),
    )
    _, items = song_parts(s, d)
    bad = rejects.join(items, "user_id").select(
        "user_id", r6("duration_sec", 4).alias("duration_sec"), "segments", r6("global_bpm").alias("global_bpm"), "reason"
    )
    return good.unionByName(bad, allowMissingColumns=True)


DONE_SIGNALS = "done AS (SELECT DISTINCT user_id FROM events WHERE value > 350)"


@query(
    "ingest",
    _song_sql()
    + f""", {DONE_SIGNALS}, v AS (SELECT user_id, list_sum(v) AS total FROM flat)
    SELECT f.user_id, CASE WHEN duration_sec > 2570000 THEN 'too long' WHEN v.user_id IS NULL THEN 'no segment kept' END AS reason,
           CASE WHEN duration_sec <= 2570000 THEN round(total, 3) + 0.0 END AS total
    FROM signal f LEFT JOIN v USING (user_id) WHERE f.user_id NOT IN (SELECT user_id FROM done)""",
)
def ingest(s, d):
    """Signals without a loud event are still to do; their features, or why not."""
    from vecloom.plans.ingest import ingest as run

    events = table(s, d, "events")
    source, done = events.select("user_id").distinct(), events.filter("value > 350").select("user_id").distinct()
    rows, items = song_parts(s, d)
    got = run(source, done, items, rows, "user_id", min_rms=25.0, max_seconds=2_570_000.0)
    total = F.aggregate("feature_vector", F.lit(0.0), lambda a, x: a + x)
    good = got.rows.select("user_id", F.lit(None).cast("string").alias("reason"), r6(total, 3).alias("total"))
    return good.unionByName(got.rejects.select("user_id", "reason"), allowMissingColumns=True)


query(
    "refresh_owner_vectors",
    _song_sql()
    + """, l AS (SELECT event_type AS artist_id, user_id, v FROM flat JOIN (SELECT user_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY 1) USING (user_id)),
    x AS (SELECT artist_id, user_id, unnest(range(223))::INTEGER AS pos, unnest(v) AS x FROM l)
    SELECT artist_id, pos, round(avg(x), 4) + 0.0 AS x FROM x GROUP BY 1, 2 HAVING count(*) >= 5""",
)(lambda s, d: owner_vectors(s, d))


def owner_vectors(s, d):
    """Owners are the types of the signals' first events."""
    from vecloom.plans.ingest import refresh_owner_vectors

    first = table(s, d, "events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("artist_id"))
    kept, _ = flat_songs(s, d)
    songs = kept.select("user_id", V.flatten_features("audio_features").alias("feature_vector")).join(first, "user_id")
    artists = songs.groupBy("artist_id").agg(F.count("*").alias("n")).select("artist_id", F.lit(None).cast("array<double>").alias("feature_vector"))
    out = refresh_owner_vectors(artists, songs).filter("feature_vector IS NOT NULL")
    return long(out, "feature_vector", "artist_id", places=4)
