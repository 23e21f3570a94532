import random

import xxhash

from vecloom.llm import simhash
from vecloom.llm.graph import components


def fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def closed(fps, bits=2):
    """Least index reachable, by brute force."""
    found = list(range(len(fps)))

    def root(i):
        while found[i] != i:
            i = found[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = root(i), root(j)
                found[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint_matches_bit_count():
    rng = random.Random(1)
    texts = ["", " \t\n", "one", "One two", "a b c", "É É\x0b b\x0cc d", "x y z " * 50000]
    texts += [" ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(rng.randint(1, 300))) for _ in range(40)]
    for t in texts[:6] + texts[7:]:
        assert simhash.fingerprint_of(t.encode()) == fingerprint(t)
    assert simhash.fingerprint_of(texts[6].encode()) == fingerprint(texts[6])


def test_components_equal_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in table.collect())
    fps = [fingerprint(t) for _, t in rows]
    want = {rows[i][0]: (f"{fps[i]:016x}", rows[c][0]) for i, c in enumerate(closed(fps))}
    found = simhash.simhash_components(table)
    got = {r.doc_id: (r.f, r.component_id) for r in found.select("doc_id", simhash.hex_fingerprint().alias("f"), "component_id").collect()}
    assert got == want


def test_large_buckets_find_every_component(spark):
    """Values around a few centres: most buckets hold more than the limit, and chains join some centres."""
    rng = random.Random(3)
    fps = []
    for centre in [0, (1 << 64) - 1, 0x0F0F0F0F12345678, 0x0F0F0F0F1234567F]:
        for _ in range(120):
            x = centre
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            fps.append(x)
    fps = sorted(set(fps))
    groups = closed(fps)
    frame = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    for hot in (64, 4):
        root = {r.node: r.root for r in components(simhash.links(frame, hot=hot)).collect()}
        got = [root.get(signed(x), signed(x)) for x in fps]
        assert len({(a, b) for a, b in zip(got, groups)}) == len(set(got)) == len(set(groups))
    three = {frozenset((r.a, r.b)) for r in simhash.links(frame, bits=3).collect()}
    assert three == {frozenset((signed(x), signed(y))) for i, x in enumerate(fps) for y in fps[:i] if (x ^ y).bit_count() <= 3}


def test_edges_of_the_input(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (7, "A  b\tc d\ne f", None), (3, None, "y"), (4, "", "y"), (None, "a b c d e f", "z"), (9, "other words are here", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("component_id", simhash.F.lit("clash"))
    got = sorted(((r.doc_id, r.component_id) for r in simhash.simhash_components(docs).collect()), key=repr)
    assert got == sorted([(1, 1), (1, 1), (7, 1), (None, 1), (3, 3), (4, 3), (9, 9)], key=repr)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 9]
    assert simhash.simhash_components(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0
    only_null = spark.createDataFrame([(None, "p q r")], "doc_id long, text string")
    assert [tuple(r)[-1] for r in simhash.simhash_components(only_null).collect()] == [None]


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    edges = spark.createDataFrame(chain + star + [(5, 5), (None, 3)], "a long, b long")
    root = {r.node: r.root for r in components(edges).collect()}
    assert len({root[i] for i in range(201)}) == 1 and len({root[1000 + i] for i in range(300)}) == 1 and len(root) == 501
    assert components(edges.limit(0)).count() == 0
