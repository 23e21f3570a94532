"""Inputs at the edge: repeated keys, zero vectors, lone clusters, broken lines."""

import math

from pyspark.sql import functions as F

from vecloom.functions import vectors as V
from vecloom.operators import catalog, filters, quality, segments
from vecloom.sources import sinks


def test_keyed_updates_keep_the_rows(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, x string")
    twice = spark.createDataFrame([(1, "p", 2), (1, "q", 1), (3, "z", 1), (9, "n", 1)], "k int, x string, at int")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(sinks.update_by_key(target, twice, "k", "x")) == [(1, "q"), (2, "b"), (3, "z")]
    assert rows(sinks.update_by_key(target, twice, "k", "x", ["at"])) == [(1, "p"), (2, "b"), (3, "z")]
    assert rows(sinks.update_by_group(target, twice.drop("at"), "k", ["x"])) == [(1, "q"), (2, "b"), (3, "z")]
    assert rows(catalog.enrich_missing(target.withColumn("x", F.lit("").cast("string")), twice, "k", {"x": ("",)})) == [(1, "q"), (2, None), (3, "z")]
    assert rows(sinks.upsert(target, twice.drop("at"), ["k"], replace=["x"])) == [(1, "q"), (2, "b"), (3, "z"), (9, "n")]
    renames = spark.createDataFrame([(1, 10), (1, 11)], "old int, new int")
    assert rows(filters.cascade_update(target, renames, "k").select("k")) == [(2,), (3,), (11,)]


def test_cosine_of_a_zero_vector_is_one(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0], [1.0, 0.0]), (1, [2.0, 0.0], [3.0, 0.0]), (2, None, [1.0, 0.0])], "i int, a array<double>, b array<double>")
    assert [r.d for r in df.select("i", V.distance("a", "b", "cosine").alias("d")).orderBy("i").collect()] == [1.0, 0.0, None]
    zero = spark.createDataFrame([(0, 0, [1.0, 0.0]), (1, 0, [-1.0, 0.0]), (2, 1, [0.0, 0.0])], "id int, label int, v array<double>")
    assert quality.cosine_inertia(zero, "v", "label").first()["cosine_inertia"] == 2.0


def test_every_row_its_own_cluster(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "label int, v array<double>")
    assert tuple(quality.calinski_harabasz(df, "v", "label").first()) == (4, None)


def test_vectors_over_several_lines(spark):
    df = spark.createDataFrame([("[1,\n2,3]",), ("[1,null,3]",)], "s string")
    parse = lambda mode: [r.v for r in df.select(V.parse_vector("s", mode, 3).alias("v")).collect()]
    assert parse("verified") == [[1, 2, 3], None] and parse("loose") == [[1, 2, 3], None]
    strict = parse("strict")
    assert strict[0] == [1, 2, 3] and strict[1][0] == 1 and math.isnan(strict[1][1])


def test_the_function_of_a_segment_runs_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, s, float(i), i) for s in range(10) for i in range(3)], "signal int, segment int, value double, at int")

    def once(values, folder=str(tmp_path)):
        import tempfile

        tempfile.NamedTemporaryFile(dir=folder, delete=False).close()
        if values[0] > 5:
            raise ValueError
        return {"bpm": float(values.sum())}

    schema = segments.T.StructType([segments.T.StructField("bpm", segments.T.DoubleType())])
    kept, bad = segments.segment_featurize(rows, "signal", "segment", "value", "at", once, schema)
    assert kept.count() == 10 and bad.count() == 0 and len(list(tmp_path.iterdir())) == 10
