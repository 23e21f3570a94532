import json
import math

import pytest
from pyspark.sql import functions as F

from vecloom import schemas
from vecloom.functions import metadata as M
from vecloom.functions import scores
from vecloom.functions import vectors as V
from vecloom.operators import filters
from vecloom.sources import records, sinks, tables


def one(spark, value, kind, expr):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).head()["y"]


@pytest.mark.parametrize(
    "text,strict,verified,loose",
    [
        ("[1,2,3]", [1, 2, 3], [1, 2, 3], [1, 2, 3]),
        ("1, 2 ,3", None, [1, 2, 3], [1, 2, 3]),
        ("1 2 3", None, [1, 2, 3], None),
        ("[1,2]", None, None, [1, 2]),
        ("[1,2,3,4]", None, None, [1, 2, 3, 4]),
        ("[1,,2,3]", None, [1, 2, 3], [1, 2, 3]),
        ("[1,x,3]", None, None, None),
        ("[1,Infinity,3]", "any", None, "any"),
        ("", None, None, []),
        ("[]", None, None, []),
        (None, None, None, None),
    ],
)
def test_parse_contracts(spark, text, strict, verified, loose):
    for mode, want in (("strict", strict), ("verified", verified), ("loose", loose)):
        got = one(spark, text, "string", lambda c, m=mode: V.parse_vector(c, m, 3))
        if want != "any":
            assert got == want, mode


def test_strict_passes_nan(spark):
    got = one(spark, "[1,NaN,3]", "string", lambda c: V.parse_vector(c, "strict", 3))
    assert math.isnan(got[1])


def test_clean_pads_and_truncates(spark):
    bad = [1.0, float("nan"), float("inf"), None, -float("inf")]
    assert one(spark, bad, "array<double>", lambda c: V.clean_vector(c, 7)) == [1, 0, 0, 0, 0, 0, 0]
    assert one(spark, bad, "array<double>", lambda c: V.clean_vector(c, 2)) == [1, 0]


def test_group_weights_are_damped():
    w = V.group_weights(V.GROUPS_223, 223)
    assert [w[i] for i in (0, 3, 11, 31, 83, 95, 222)] == pytest.approx([1, 1.01, 0.985, 1.005, 1, 1.02, 1.02])


def record():
    stat = lambda k: {"mean": k + 0.1, "std": k + 0.2, "min": k + 0.3, "max": k + 0.4}
    r = {"duration_sec": 100.5, "segments": 10, "global_bpm": 120.0}
    for i, n in enumerate(schemas.STAT_FIELDS_HEAD + schemas.STAT_FIELDS_TAIL):
        r[n] = stat(float(i))
    r["mfcc_mean"] = [{"mean": float(i), "std": i + 0.5} for i in range(13)]
    r["mfcc_std"] = [{"mean": float(-i), "std": i + 0.25} for i in range(13)]
    r["vggish_emb"] = [float(i) for i in range(128)]
    return r


def flat(r):
    out = [r[n] for n in schemas.SCALAR_FIELDS]
    for n in schemas.STAT_FIELDS_HEAD:
        out += [r[n][m] for m in ("mean", "std", "min", "max")]
    for n in schemas.COEFFICIENT_FIELDS:
        for c in r[n]:
            out += [c["mean"], c["std"]]
    for n in schemas.STAT_FIELDS_TAIL:
        out += [r[n][m] for m in ("mean", "std", "min", "max")]
    return out + r["vggish_emb"]


def test_feature_file_flattens_to_the_layout(spark, tmp_path):
    broken = record()
    del broken["rms"]
    (tmp_path / "f.json").write_text(json.dumps([{"song": "a", "artist": "b", "audio_features": record()}, {"song": "c", "artist": "d", "audio_features": broken}]))
    df = records.read_features_json(spark, str(tmp_path / "f.json")).select("song", V.flatten_features("audio_features").alias("v"))
    got = {r["song"]: r["v"] for r in df.collect()}
    assert len(got["a"]) == schemas.VECTOR_SIZE and got["a"] == pytest.approx(flat(record()))
    assert got["c"] is None


def test_json_round_trip_is_half_even(spark):
    assert one(spark, [0.125, 1.0], "array<double>", lambda c: V.vector_to_json(c, 2)) == "[0.12,1.0]"


def test_verify_gives_reasons(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0]), (3, None), (4, [1.0, float("nan")]), (5, [1.0, None]), (6, [float("inf"), 1.0])]
    good, bad = filters.verify_vectors(spark.createDataFrame(rows, "id int, v array<double>"), "v", 2)
    assert [r["id"] for r in good.collect()] == [1]
    assert {r["id"]: r["reason"] for r in bad.collect()} == {
        2: "wrong length", 3: "missing vector", 4: "non-finite value", 5: "non-finite value", 6: "non-finite value",
    }


def test_duration_limit_is_strict(spark):
    kept, rejects = filters.max_duration(spark.createDataFrame([(900.0,), (900.1,)], "s double"), "s")
    assert kept.count() == 1 and rejects.head()["reason"] == "too long"


def test_upsert_rules_and_idempotence(spark):
    stored = spark.createDataFrame([("a", "kmeans", 1, 0.5, 9), ("b", "kmeans", 2, 0.6, 8)], "song_id string, algorithm string, kmeans_cluster_id int, confidence double, kmeans_cluster_size int")
    new = spark.createDataFrame([("a", "kmeans", 5, None), ("c", "gmm", None, 0.1)], "song_id string, algorithm string, kmeans_cluster_id int, confidence double")
    once = sinks.upsert(stored, new)
    rows = sorted(tuple(r) for r in once.collect())
    assert rows == [("a", "kmeans", 5, None, 9), ("b", "kmeans", 2, 0.6, 8), ("c", "gmm", None, 0.1, None)]
    assert sorted(tuple(r) for r in sinks.upsert(once, new).collect()) == rows


def test_upsert_of_a_repeated_key_takes_the_last(spark):
    stored = spark.createDataFrame([("a", "gmm", 1)], "song_id string, algorithm string, gmm_cluster_id int")
    new = spark.createDataFrame([("a", "gmm", 7, 2), ("a", "gmm", 5, 1), ("b", "gmm", 3, 1)], "song_id string, algorithm string, gmm_cluster_id int, t int")
    assert sorted(tuple(r) for r in sinks.upsert(stored, new, order=["t"]).collect()) == [("a", "gmm", 7), ("b", "gmm", 3)]


def test_insert_ignore_first_wins(spark):
    stored = spark.createDataFrame([("a", "old")], "k string, v string")
    new = spark.createDataFrame([("a", "x", 0), ("b", "second", 2), ("b", "first", 1)], "k string, v string, t int")
    fresh = sinks.insert_ignore(stored, new, ["k"], ["t"])
    assert [tuple(r) for r in fresh.collect()] == [("b", "first")]


def test_errors_survive_a_corrupt_log(spark, tmp_path):
    path = str(tmp_path / "log")
    kind = "id int, error string, timestamp string"
    assert sinks.read_errors(spark, path, kind).count() == 0
    sinks.error_sink(spark.createDataFrame([(1, "bad")], "id int, reason string"), path, ["id"])
    (tmp_path / "log" / "broken.json").write_text("{not json\n")
    sinks.error_sink(spark.createDataFrame([(2, "worse")], "id int, reason string"), path, ["id"])
    assert sorted(r["error"] for r in sinks.read_errors(spark, path, kind).collect()) == ["bad", "worse"]


def test_paging_covers_every_row_once(spark):
    df = spark.range(23)
    seen = [r["id"] for p in range(4) for r in tables.scan_page(df, "id", p, 7).collect()]
    assert seen == list(range(23))


def test_playlist_url(spark):
    pick = lambda url: M.playlist_id(url, "/lists/([A-Za-z0-9]+)/")
    assert one(spark, "https://api.example.org/v1/lists/37i9dQ/items?x=1", "string", pick) == "37i9dQ"
    assert one(spark, "https://elsewhere.example.org", "string", pick) is None


def test_criteria_match_published_rows(spark):
    rows = [(2, -589226, 1202265, 1183754), (8, -512418.44, 1120115, 1046051), (10, -504414, 1127927, 1035345)]
    df = spark.createDataFrame([(k, float(ll), float(b), float(a)) for k, ll, b, a in rows], "k int, ll double, b double, a double")
    for r in df.select("*", scores.aic("ll", "k", 50).alias("aic"), scores.bic("ll", "k", 50, 7963).alias("bic")).collect():
        assert abs(r["aic"] - r["a"]) <= 1.5 and abs(r["bic"] - r["b"]) <= 1.5


def test_eps_thinning(spark):
    got = one(spark, [1.0, 1.05, 0.0, -3.0, 1.2, 1.21, 2.0, 9.0], "array<double>", scores.eps_suggestions)
    assert got == [1.0, 1.2, 2.0]


def test_dbscan_quality_label(spark):
    df = spark.createDataFrame([(3, 0.019), (11, 0.01), (2, 0.2), (1, 0.0), (5, 0.5)], "k int, n double")
    assert [r[0] for r in df.select(scores.density_quality("k", "n")).collect()] == ["EXCELLENT", "GOOD", "FAIR", "POOR", "POOR"]


