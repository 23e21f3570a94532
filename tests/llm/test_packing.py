import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from vecloom.llm import packing, queries, subwords

PATH = public_tokenizers.path("byte_bpe_50k.json")
SPEC = subwords.load(PATH)


def encoded(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


def check(docs, pieces, window=packing.SEQUENCE):
    """Every id of every document in one piece; sequences without gaps; all full but the last, at falling powers of two."""
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    tokenizer, places, parts = Tokenizer.from_file(PATH), defaultdict(list), defaultdict(list)
    own = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [packing.END_ID] for i, t in docs}
    for p in pieces:
        ids = own[p["doc_id"]]
        assert p["doc_tokens"] == len(ids) and p["length"] > 0
        assert p["ids_crc32"] == crc(ids[p["start"]:p["start"] + p["length"]])
        parts[p["doc_id"]].append((p["start"], p["length"]))
        places[p["sequence_id"]].append((p["offset"], p["length"]))
    assert parts.keys() == own.keys()
    for held, whole in [(sorted(v), len(own[i])) for i, v in parts.items()] + [(sorted(v), None) for v in places.values()]:
        ends = [a + n for a, n in held]
        assert [a for a, _ in held] == [0, *ends[:-1]] and whole in (None, ends[-1])
    sizes = [sum(n for _, n in places[i]) for i in range(len(places))]
    tail = [s for s in sizes if s != window]
    assert sizes == [window] * (len(sizes) - len(tail)) + tail and all(s & (s - 1) == 0 for s in tail) and tail == sorted(set(tail), reverse=True)


def shares(pieces, source_of):
    """Of each sequence: ids by source."""
    out = defaultdict(Counter)
    for p in pieces:
        out[p["sequence_id"]][source_of[p["doc_id"]]] += p["length"]
    return [out[i] for i in range(len(out))]


def test_query_packs_all_documents_in_proportion(spark):
    folder = "/root/testdata/sf0.01"
    pieces = queries.QUERIES["op12_mixture_packing"](spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source").collect()
    check([(r.doc_id, r.text) for r in docs], pieces)
    tokens = Counter()
    for p in pieces:
        tokens[p["source"]] += p["length"]
    whole = sum(tokens.values())
    found = shares(pieces, {r.doc_id: r.source for r in docs})
    off = [abs(c[s] - 2048 * n / whole) for c in found[:-12] for s, n in tokens.items()]
    assert max(off) < 400 and np.mean(off) < packing.LEAST


def test_buckets_go_on_where_the_one_before_ended(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["word"] * int(rng.integers(0, 120))), None if i % 9 == 0 else "ab"[i % 3 == 0], "x") for i in range(400)]
    rows += [(400, "long " * 9000, "b", "x"), (401, None, "c", "x"), (402, "", None, "x"), (403, "a<|endoftext|>b \xa0x", "c", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, queue string").repartition(5)
    for bucket, window in ((1 << 20, 2048), (3000, 256), (500, 64)):
        pieces = packing.packed(docs, SPEC, bucket=bucket, window=window, least=16, digest=True).collect()
        check([r[:2] for r in rows], pieces, window)
        whole, source = Counter(), {r[0]: r[2] for r in rows}
        for p in pieces:
            assert p["source"] == source[p["doc_id"]]
            whole[p["source"]] += p["length"]
        # What is due and what was sent never drift apart, over all buckets.
        due, gap = Counter(), 0
        for i, c in enumerate(shares(pieces, source)):
            due.update(c)
            gap = max(gap, max(abs(due[s] - whole[s] * sum(due.values()) / sum(whole.values())) for s in whole))
        # The small buckets are of random rows, so they hold more or less of a source than its share.
        assert gap < 6 * bucket**0.5 * 50**0.5, (bucket, gap)


def test_weights(spark):
    rows = [(i, "word " * 49, "abc"[i % 3]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces = packing.packed(docs, SPEC, weights={"a": 2.0}, other=1.0, window=256, bucket=2000, digest=True).collect()
    check([r[:2] for r in rows], pieces, 256)
    found = shares(pieces, {i: s for i, _, s in rows})
    # "a" has two thirds of each sequence until it is used up, after half of all ids; "b" and "c" are one queue.
    early = sum(found[:len(found) // 3], Counter())
    assert abs(early["a"] / sum(early.values()) - 2 / 3) < 0.05
    assert sum(c["a"] for c in found[len(found) * 5 // 8:]) == 0
    assert packing.phases({"x": 10, "y": 30}, {"x": 1.0, "y": 0.0})["y"] == ([0.0, 10.0, 40.0], [0.0, 0.0, 30.0])


def test_ids_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "two words", "s")] * 3, "doc_id long, text string, source string")
    rows = packing.packed(docs, SPEC).collect()
    assert sorted(r["offset"] for r in rows if r["sequence_id"] == 0) and sum(r["length"] for r in rows) == 9
    joined = [x for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])) for x in r["ids"]]
    assert joined == encoded("two words") * 3 and all(r["doc_id"] is None for r in rows)
    assert packing.packed(docs.limit(0), SPEC).count() == 0


def test_edges():
    assert [packing.edge(i, 11, 4) for i in (0, 3, 4, 8, 9, 10)] == [(0, 0, 4), (0, 0, 4), (1, 4, 8), (2, 8, 10), (2, 8, 10), (3, 10, 11)]
