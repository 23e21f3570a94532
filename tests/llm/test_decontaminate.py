import random

from vecloom.llm import decontaminate as D


def brute(docs, items, size=5, threshold=0.8):
    out = set()
    sets = [(i, D.shingle_set((t or "").encode(), size)) for i, t in items]
    for d, t in docs:
        own = D.shingle_set((t or "").encode(), size)
        out |= {(d, i, len(own & s)) for i, s in sets if s and len(own & s) >= threshold * len(s) - 1e-9}
    return out


def tables():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(2, 5)))
    items = [(i, " ".join(word() for _ in range(rng.randint(3, 70)))) for i in range(60)]
    items += [(60, ""), (61, None), (62, "Two words"), (63, items[0][1])]
    docs = []
    for d in range(150):
        body = [word() for _ in range(rng.randint(0, 400))]
        for _ in range(rng.randint(0, 2)):
            passage = rng.choice(items[:60])[1].split()
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                passage[rng.randrange(len(passage))] = word()
            at = rng.randint(0, len(body))
            if rng.random() < 0.3:  # in two parts, far from each other
                body = passage[:len(passage) // 2] + body + passage[len(passage) // 2:]
            else:
                body[at:at] = passage
        docs.append((d, rng.choice([" ", "\n", "  "]).join(body).title() if d % 3 else " ".join(body)))
    docs += [(150, None), (151, ""), (152, "TWO\twords"), (153, "two words more"), (0, docs[0][1]), (154, (items[5][1] + " ") * 3000)]
    return docs, items


def test_no_link_is_lost(spark):
    docs, items = tables()
    left = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, item_id string")
    right = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    want = brute(docs, items)
    assert len(want) > 40
    for most in (1 << 20, 50):
        got = D.contamination(left, right, block_values=most)
        assert {(r.doc_id, r.item_id, r.shared) for r in got.collect()} == want
    kept = D.decontaminate(left, right, block_values=500)
    assert kept.columns == left.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs if d not in {w[0] for w in want})


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert D.contamination(docs, items.limit(0)).count() == 0 and D.contamination(docs.limit(0), items).count() == 0
    assert D.decontaminate(docs, items.limit(0)).count() == 1 and D.decontaminate(docs.limit(0), items).count() == 0
    assert D.decontaminate(docs, items).count() == 0
