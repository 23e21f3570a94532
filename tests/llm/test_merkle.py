import hashlib

from pyspark.sql import functions as F

from vecloom.llm import merkle as M


def leaves(spark, rows):
    return spark.createDataFrame([(i // 64, i % 64, 10 * (i % 64), 10 * (i % 64) + 10, h) for i, h in rows], "archive long, ordinal long, start long, stop long, hash string")


def test_damage_is_found_and_only_there(spark):
    good = {i: hashlib.sha256(bytes([i % 256, i // 256])).hexdigest() for i in range(300)}
    bad = dict(good)
    bad[17], bad[64], bad[299] = "x", "y", None
    del bad[130]
    bad[301] = "new"
    a, b = (M.merkle_tree(leaves(spark, list(x.items())), 4, 3) for x in (good, bad))
    assert [x.count() for x in a] == [300, 75, 19, 5]
    got = {(r.archive * 64 + r.ordinal): (r.status, r.first_hash, r.second_hash, r.start) for r in M.audit(a, b, 4).collect()}
    assert {i: s[0] for i, s in got.items()} == {17: "changed", 64: "changed", 299: "missing", 130: "missing", 301: "extra"}
    assert got[17][1:] == (good[17], "x", 170)
    assert M.audit(a, a, 4).count() == 0


def test_roots_cover_order_and_ranges(spark):
    root = lambda rows: M.merkle_tree(leaves(spark, rows), 4, 3)[-1].collect()
    (one,), (two,) = root([(0, "a"), (1, "b")]), root([(0, "b"), (1, "a")])
    assert one.hash != two.hash and (one.start, one.stop, one.records) == (0, 20, 2)
    leaf = [hashlib.sha256("|".join(f"{i}:{10 * i}:{10 * i + 10}:{h}" for i, h in enumerate("ab")).encode()).hexdigest()]
    for _ in range(2):
        leaf = [hashlib.sha256("|".join(f"{i}:0:20:{h}" for i, h in enumerate(leaf)).encode()).hexdigest()]
    assert one.hash == leaf[0]


def test_layout(spark):
    rows = [(3, "b", 5), (1, "z", 7), (3, "a", 2), (None, "n", 1), (3, "a", 2)]
    frame = spark.createDataFrame([(*r, "k") for r in rows], "record_id long, tie string, length long, archive string").drop("archive")
    got = [tuple(r) for r in M.layout(frame, fanout=2, depth=1).select("record_id", "tie", "archive", "ordinal", "start", "stop").orderBy("archive", "ordinal").collect()]
    assert got == [(None, "n", 0, 0, 0, 1), (1, "z", 0, 1, 1, 8), (3, "a", 1, 0, 0, 2), (3, "a", 1, 1, 2, 4), (3, "b", 2, 0, 0, 5)]
    assert M.layout(frame.limit(0)).count() == 0
    empty = M.merkle_tree(leaves(spark, []))
    assert M.audit(empty, empty).count() == 0
    record = spark.createDataFrame([(7, "http://x", "hé")], "i int, u string, p string").select(M.warc_record(F.col("i"), F.col("u"), F.col("p")).alias("r")).first().r
    assert record == "WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:7>\r\nWARC-Target-URI: http://x\r\nContent-Type: text/html\r\nContent-Length: 3\r\n\r\nhé\r\n\r\n"
