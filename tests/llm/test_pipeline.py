import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from tests.llm.test_mixing import deal
from tests.llm.test_simhash import closed, fingerprint
from vecloom.llm import decontaminate, rules
from vecloom.session import snapshot

DATA = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, outs = docs.columns, [docs]
    for name, stage in P.STAGES:
        outs.append(snapshot(stage(spark, outs[-1], DATA), name))
        assert name == "tokens" or outs[-1].columns == columns
    raw, good, single, clean, mixed, tokens = ([tuple(r) for r in x.collect()] for x in outs)

    model = rules.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet").where(P.crc_mod("doc_id", 4) != 2))
    kept = {r.doc_id for r in rules.scored(docs, model).where("score >= 0.7").collect()}
    assert sorted(good) == sorted(r for r in raw if r[0] in kept) and 0 < len(good) < len(raw)

    rows = sorted(good)
    group = closed([fingerprint(r[1]) for r in rows])
    assert sorted(single) == [rows[i] for i in range(len(rows)) if group[i] == i]

    items = [decontaminate.shingle_set(r.text.encode()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    holds = lambda t: any(len(decontaminate.shingle_set(t.encode()) & s) >= 0.8 * len(s) for s in items)
    assert sorted(clean) == sorted(r for r in single if not holds(r[1]))

    sizes, taken = {}, {}
    for r in clean:
        sizes[r[3]] = sizes.get(r[3], 0) + len(r[1].split())
    for r in mixed:
        taken[r[3]] = taken.get(r[3], 0) + len(r[1].split())
    for source, target in deal(sizes).items():
        repeats, reached = int(target // sizes[source]), 1
        for r in clean:
            reached |= reached << len(r[1].split()) if r[3] == source else 0
        budget = round(target - repeats * sizes[source])
        best = max(i for i in range(budget + 1) if reached >> i & 1)
        assert taken.get(source, 0) == repeats * sizes[source] + best
    assert set(mixed) <= set(clean) and max(mixed.count(r) for r in set(mixed)) <= 3

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, want = 0, []
    for r in sorted(mixed):
        ids = tokenizer.encode(r[1], add_special_tokens=False).ids + [2]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tokens) == want


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for name, stage in P.STAGES:
        docs = snapshot(stage(spark, docs, DATA), name)
        assert docs.count() == 0
