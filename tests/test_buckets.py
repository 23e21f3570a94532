from pyspark.sql import functions as F

from vecloom.operators import aggregates as A
from vecloom.operators import running as R
from vecloom.session import scratch_path
from vecloom.sources import buckets as B


def files(spark, path):
    return {r[0]: r[1] for r in spark.read.parquet(path).select("_metadata.file_path", "bucket").distinct().collect()}


def test_only_touched_buckets_are_rewritten(spark):
    path, by = scratch_path(spark, "t"), F.pmod("k", F.lit(4))
    rows = spark.createDataFrame([(i, f"v{i}", i) for i in range(20)], "k int, v string, n int")
    stored = B.create(rows, path, by)
    before = files(spark, path)
    new = spark.createDataFrame([(1, "x"), (1, "y"), (21, "z"), (6, None)], "k int, v string")
    assert B.upsert(stored, path, new, by, ["k"], ["v"]) == [1, 2]
    after = files(spark, path)
    assert {f for f, b in before.items() if b in (0, 3)} == {f for f, b in after.items() if b in (0, 3)}
    assert not {f for f, b in before.items() if b in (1, 2)} & set(after)
    got = {r.k: (r.v, r.n) for r in B.read(spark, path, rows).collect()}
    assert got == {i: (f"v{i}", i) for i in range(20)} | {1: ("y", 1), 6: (None, 6), 21: ("z", None)}


def test_keyed_update_adds_no_keys_and_no_change_writes_nothing(spark):
    path, by = scratch_path(spark, "t"), B.bucket_of(["k"], 3)
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, x double")
    stored = B.create(rows, path, by)
    before = files(spark, path)
    assert B.update_by_key(stored, path, rows.limit(0), by, "k", "x") == [] and files(spark, path) == before
    B.update_by_key(stored, path, spark.createDataFrame([("a", 5.0), ("q", 7.0)], "k string, x double"), by, "k", "x")
    assert sorted(map(tuple, B.read(spark, path, rows).collect())) == [("a", 5.0), ("b", 2.0)]


def test_running_mean_equals_the_mean_of_all_songs(spark):
    songs = spark.createDataFrame(
        [(i, "abc"[i % 3] if i % 10 else None, [float(i), i / 7] if i % 4 else None) for i in range(60)] + [(99, "only-null", None)],
        "id int, artist_id string, feature_vector array<double>",
    )
    path, part = scratch_path(spark, "means"), F.pmod(F.xxhash64("id"), F.lit(3))
    state = R.start(songs.where(part == 0), path, buckets=4)
    for i in (1, 2):
        state = R.advance(state, path, songs.where(part == i), buckets=4)
    state = R.advance(state, path, songs.limit(0), buckets=4)
    rows = lambda df: sorted([(r.artist_id, r.song_count, r.n_valid, [round(x, 9) for x in r.mean_vector]) for r in df.collect()], key=repr)
    # The batch form drops the owner that is null.
    got = [r for r in rows(R.running_mean(state)) if r[0] is not None]
    assert got == rows(A.artist_mean_vector(songs, min_valid=5)) and len(got) == 3
    assert {r.artist_id: r.song_count for r in state.collect()} == {r[0]: r[1] for r in songs.groupBy("artist_id").count().collect()}
