import numpy as np

from vecloom.llm import rules
from vecloom.llm.text import crc_mod


def test_stats_by_hand():
    got = dict(zip(rules.STATS, rules.text_stats([b"", b"AB cd cd!\n| cd 12", "\xe9".encode()])[1]))
    assert np.isclose(got["words"], np.log1p(6)) and np.isclose(got["same_as_before"], 0) and np.isclose(got["distinct"], 5 / 6)
    assert np.isclose(got["commonest"], 2 / 6) and np.isclose(got["upper"], 2 / 8) and np.isclose(got["bang"], 1 / 6) and np.isclose(got["pipe"], 1 / 6)
    assert not rules.text_stats([b""]).any() and rules.text_stats([]).shape == (0, len(rules.STATS))


def test_tree_paths():
    debug = """DecisionTreeClassificationModel: depth=2
  If (feature 0 <= 0.5)
   If (feature 1 <= 2.0)
    Predict: 0.0
   Else (feature 1 > 2.0)
    Predict: 1.0
  Else (feature 0 > 0.5)
   If (feature 0 <= 0.75)
    Predict: 1.0
   Else (feature 0 > 0.75)
    Predict: 0.0
"""
    assert rules.tree_rules(debug) == [
        ((0, "<=", 0.5),), ((0, "<=", 0.5), (1, "<=", 2.0)), ((0, "<=", 0.5), (1, ">", 2.0)),
        ((0, ">", 0.5),), ((0, "<=", 0.75), (0, ">", 0.5)), ((0, ">", 0.75),),
    ]


def test_held_out_accuracy_and_sparsity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = rules.fit(docs, labels.where(crc_mod("doc_id", 4) != 2))
    assert 0 < len(model.weights) < 150
    held = rules.scored(docs, model).join(labels.where(crc_mod("doc_id", 4) == 2).select("doc_id", "quality"), "doc_id").select("quality", "score").toPandas()
    assert ((held.score >= rules.THRESHOLD) == held.quality).mean() > 0.97
    assert (held.score.between(0, 1)).all()


def test_edges_of_the_input(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, "a b", 0.5), (3, "long " * 200000, 0.5)], "doc_id long, text string, score double")
    none = rules.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in rules.scored(docs, none).collect()} == {0.5}
    one = rules.fit(docs, spark.createDataFrame([(1, 1), (2, 1), (2, 1), (None, 0), (3, None)], "doc_id long, quality int"))
    assert rules.keep_quality(docs, one).columns == docs.columns and rules.keep_quality(docs, one).count() == 4
    two = rules.fit(docs, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int"))
    assert rules.scored(docs, two).count() == 4
    assert rules.scored(docs.limit(0), two).count() == 0
