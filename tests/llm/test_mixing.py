import itertools
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from vecloom.llm import mixing


def deal(sizes, weights=(5, 2, 1), most=3):
    """Targets by brute force: fix whoever is above, deal the rest again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else left * weight[s] / w for s in names}
        over = {s for s in names if target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def test_fit_is_the_best_sum():
    rng = random.Random(2)
    for _ in range(200):
        lengths = np.array(rng.sample(range(0, 30), rng.randint(1, 6)))
        counts = np.array([rng.randint(1, 4) for _ in lengths])
        budget = rng.randint(0, int((lengths * counts).sum()) + 3)
        take = mixing.fit(lengths, counts, budget)
        sums = {sum(a * b for a, b in zip(c, lengths)) for c in itertools.product(*[range(n + 1) for n in counts])}
        assert (take <= counts).all() and int((take * lengths).sum()) == max(s for s in sums if s <= budget)


def test_fit_spreads_a_large_budget():
    rng = random.Random(3)
    lengths = np.array(sorted(rng.sample(range(1, 3000), 400)))
    counts = np.array([rng.randint(1, 60) for _ in lengths])
    whole = int((lengths * counts).sum())
    for part in (0.1, 0.5, 0.97):
        budget = int(whole * part)
        take = mixing.fit(lengths, counts, budget, window=5000)
        assert (take <= counts).all() and int((take * lengths).sum()) == budget
        share = take / counts
        assert abs(np.average(share[:200], weights=counts[:200]) - np.average(share[200:], weights=counts[200:])) < 0.15


def check(docs, rows):
    sizes = defaultdict(int)
    for _, text, source in docs:
        sizes[source] += len((text or "").encode().split())
    target, got = deal(sizes), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) <= 1e-6 * max(1, target[r.source])
        assert r.size * r.copies <= 3 * r.size or r.size == 0
        got[r.source] += r.size * r.copies
    return target, got


def test_mixture_meets_targets(spark):
    rng = random.Random(4)
    docs = []
    for i in range(3000):
        source = rng.choice([None, "a", "b", "B", "é", "\U0001F600", "hot", "hot", "hot"])
        docs.append((i, " ".join(["w"] * rng.choice([0, 1, 2, 3, 7, 20, 50, 50, 50, rng.randint(1, 300)])), source))
    docs += [(3000, None, "a"), (None, "x y z", "b"), (3001, "y " * 40000, "solo")]
    frame = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, source string, size int, key string")
    lean, plan = mixing.mixture(frame)
    rows = mixing.with_copies(lean, plan).collect()
    assert len(rows) == len(docs)
    target, got = check(docs, rows)
    for s in target:
        assert abs(got[s] - target[s]) <= (1 if s != "solo" else 40000)
    lean, plan = mixing.mixture(frame.repartition(7))
    assert sorted(map(str, mixing.with_copies(lean, plan).collect())) == sorted(map(str, rows))
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns
    assert mixed.count() == sum(r.copies for r in rows if r.size)


def test_hot_length_is_split(spark):
    """20,000 documents of one length in one source: the last key is found without ordering them together."""
    docs = spark.range(20000).selectExpr("id AS doc_id", "'p q r' AS text", "if(id < 15000, 'a', 'b') AS source")
    lean, plan = mixing.mixture(docs)
    found = mixing.with_copies(lean, plan).groupBy("source").agg(F.sum("copies").alias("t"), F.max("target").alias("target"))
    got = {r.source: (r.t, r.target) for r in found.collect()}
    for source, (copies, target) in got.items():
        assert abs(copies * 3 - target) < 3


def test_empty_and_wordless(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    lean, plan = mixing.mixture(empty)
    assert mixing.with_copies(lean, plan).count() == 0 and mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, " ", "a"), (2, None, None)], "doc_id long, text string, source string")
    lean, plan = mixing.mixture(blank)
    assert [(r.size, r.target, r.copies * r.size) for r in mixing.with_copies(lean, plan).collect()] == [(0, 0.0, 0)] * 2
    assert mixing.mix(blank).count() == 0
