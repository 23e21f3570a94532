import random
import re
from collections import Counter, defaultdict

import numpy as np

from vecloom.llm import collocations as C
from vecloom.llm import queries


def brute(rows, least, longest, top, percent):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und" if lang is None else lang
        lower = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, *words[i:i + k]) for i in range(len(words) - k + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    gone = {(q[0], *q[i:j]) for q, a in cand.items() for i in range(1, len(q)) for j in range(i + 2, len(q) + 1) if j - i < len(q) - 1 and 100 * a >= percent * f[(q[0], *q[i:j])]}
    out = defaultdict(list)
    for p, a in cand.items():
        if p not in gone:
            lang, words = p[0], p[1:]
            best = min((1000 * a * n[lang] // (f[(lang, *words[:k])] * f[(lang, *words[k:])]), k) for k in range(1, len(words)))
            k = best[1]
            out[lang].append((-best[0], -a, " ".join(words).encode(), f[(lang, *words[:k])], f[(lang, *words[k:])]))
    return [(lang, i, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, xs in out.items() for i, x in enumerate(sorted(xs)[:top], 1)]


def corpus(seed=1, n=300):
    rng = random.Random(seed)
    vocab = ["the", "The", "new", "york", "of", "caf\xe9", "\xc9t\xe9", "a", "x\xa0y", "漢字", "don't", "b\x1cc"]
    rows = []
    for _ in range(n):
        words = [rng.choice(vocab) if rng.random() > 0.3 else "in new york city" for _ in range(rng.randrange(0, 30))]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!?"]) for w in words)
        rows.append((rng.choice(["en", "en", "de", None, "und", ""]), text))
    return rows + [("en", None), (None, ""), ("en", " . \t"), ("de", "a a a a a " * 900), ("de", "once only")]


def test_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(None if i % 7 == 0 else i, t, x, 0, "k") for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string, f int, fp string").repartition(4)
    for least, longest, top, percent in ((5, 5, 2000, 100), (20, 4, 3, 100), (8, 5, 50, 80), (3, 2, 10, 100)):
        got = C.collocations(docs, least=least, longest=longest, top=top, percent=percent)
        assert sorted(map(tuple, got.collect())) == sorted(brute(rows, least, longest, top, percent))
    # A filter of one word of bits lets nearly everything through, and the result is the same.
    assert sorted(map(tuple, C.collocations(docs, least=20, bits=64).collect())) == sorted(brute(rows, 20, 5, 2000, 100))


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    rows = corpus(2, 40)
    rng = np.random.default_rng(0)
    docs = [(t or "").encode() for _, t in rows]
    known = [C.Sieve(np.full(1, 2**64 - 1, np.uint64))] * 3

    class Clash(C.Runs):
        def fingerprints(self, at, n):
            return super().fingerprints(at, n) % np.uint64(3)

    def run(kind):
        monkeypatch.setattr(C, "Runs", kind)
        out = Counter()
        for runs, names, of, _ in C._blocks([batch]):
            words, lang = runs.ids(), of[runs.text]
            for n in (1, 2, 3):
                at = C._alive(runs, n, None)
                for lg, phrase, count in C._exact(runs, n, at, words, lang):
                    out[names[lg], phrase] += count
        return out

    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array([x or "und" for x, _ in rows]), pa.array(docs, pa.binary())], names=["doc_id", "lang", "text"])
    assert run(Clash) == run(C.Runs) and len(known) == 3 and rng is not None


def test_scores_are_exact(spark):
    rng = random.Random(3)
    rows = [tuple(rng.randrange(10**k, 10 ** (k + 1)) for k in (rng.randrange(2, 14), 14, rng.randrange(2, 14), rng.randrange(2, 14))) for _ in range(300)]
    rows = [(a, n, max(l, a), max(r, a)) for a, n, l, r in rows] + [(100, 10**15 - 1, 100, 100), (7, 7, 7, 7)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    got = [r["s"] for r in df.select(C.cut_score("a", "n", "l", "r").alias("s")).collect()]
    assert got == [1000 * a * n // (l * r) for a, n, l, r in rows]


def test_sieve_finds_all(spark):
    fps = [r[0] for r in spark.range(500).selectExpr("xxhash64(id)").collect()]
    found = C.sieve(spark.createDataFrame([(x,) for x in fps], "fp long"), 1 << 14)
    assert found.holds(np.array(fps, np.int64).view(np.uint64)).all()
    assert found.holds(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64)).mean() < 0.05


def test_nothing_frequent_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c", "en")], "doc_id long, text string, lang string")
    assert C.collocations(docs).count() == 0 and C.collocations(docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.QUERIES["op11_phrase_collocations"](spark, folder)
    assert dict(got.dtypes) == {"lang": "string", "phrase": "string"} | dict.fromkeys(["rank", "a", "l", "r", "n", "score"], "bigint")
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("lang", "text").collect()]
    want = brute(rows, 100, 5, 2000, 100)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 50
