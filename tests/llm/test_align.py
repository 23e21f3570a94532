import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from vecloom.llm import align, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "Hello,  world! It's  2024 -- don't", None, "", " ", "   ", " lead and trail  ", "line\nbreak\r\n\ttab", "a<|endoftext|> b</s> <0x41>", "mark▁inside", "caf\xe9 na\xefve 漢字かな \U0001F600\U0001F600",
    "é \xa0 x　y", "word " * 5000 + "end", "x" * 700, "-" * 333 + " " * 41 + "z", "same text", "same text", "aaaa aaa aa a aaaaa", "ＦＵＬＬ ﬁ", "nul\0 byte \x1c",
]


def brute(texts):
    """The contract, literally: whole-text ids, byte ends, groups, all pairs of occurrences."""
    t, s = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in printable)}
    back = {c: b for b, c in names.items()}
    bytes_a = lambda i: bytes(back[c] for c in t.id_to_token(i))
    bytes_b = lambda i: bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode()
    docs, holds = [], Counter()
    for text in texts:
        x, y = t.encode(" " + (text or ""), add_special_tokens=False).ids, s.encode(text or "")
        u, v = [bytes_a(i) for i in x], [bytes_b(i) for i in y]
        if not text or b"".join(u) != (" " + text).encode() or b"".join(v) != (" " + text).encode():
            x, y, u, v = [], [], [], []
        ends = set(np.cumsum([len(b) for b in u]).tolist()) & set(np.cumsum([len(b) for b in v]).tolist())
        groups, parts = [], []
        for ids, of in ((x, u), (y, v)):
            cut, at, own = [], 0, []
            for i, b in zip(ids, of):
                own.append(i)
                at += len(b)
                if at in ends:
                    cut.append(own)
                    own = []
            parts.append(cut)
        groups = list(zip(*parts))
        links = Counter((i, j) for g, h in groups for i in g for j in h)
        holds.update(set(links))
        docs.append((x, y, groups, links))
    top = defaultdict(int)
    for (i, _), n in holds.items():
        top[i] = max(top[i], n)
    out = []
    for x, y, groups, links in docs:
        text = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        best = sum(n for p, n in links.items() if holds[p] == top[p[0]])
        out.append((len(x), len(y), len(groups), sum(links.values()), best, sum(n * holds[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if text else "", text))
    return out


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def test_equals_brute_force(spark):
    want = brute(TEXTS)
    docs = spark.createDataFrame([(None if i == 3 else i, x, "n") for i, x in enumerate(TEXTS)], "doc_id long, text string, row string").repartition(3)
    assert want[8][0] == 0 and want[7][0] > 0
    # All pairs broadcast, some, none.
    for frequent in (align.FREQUENT, 60, 0):
        got = align.pair_scores(docs, align.specs(A, B), frequent=frequent)
        assert got.columns == ["doc_id", *NAMES]
        rows = {3 if r["doc_id"] is None else r["doc_id"]: tuple(r)[1:] for r in got.collect()}
        assert rows == {i: w[:7] for i, w in enumerate(want)}
    groups = {3 if r["doc_id"] is None else r["doc_id"]: r["groups"] for r in align.aligned(docs, align.specs(A, B)).collect()}
    assert groups == {i: w[7] for i, w in enumerate(want)}


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: w[:7] for r, w in zip(docs, brute([r.text for r in docs]))}
    got = queries.QUERIES["op13_token_alignment"](spark, "/root/testdata/sf0.001")
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == want
    assert dict(got.dtypes) == {n: "string" if n == "groups_sha256" else "bigint" for n in ["doc_id", *NAMES[:-1], "groups_sha256"]}


def test_repeated_rows_and_empty_table(spark):
    spec = align.specs(A, B)
    docs = spark.createDataFrame([(1, "one two")] * 3 + [(2, "two")], "doc_id long, text string")
    want = brute(["one two"] * 3 + ["two"])
    assert sorted(tuple(r) for r in align.pair_scores(docs, spec).collect()) == sorted((i, *w[:7]) for i, w in zip((1, 1, 1, 2), want))
    assert align.pair_scores(docs.limit(0), spec).count() == 0


def test_words_apart_equal_whole_texts_and_few_are_held():
    texts = [(" " + t).encode() for t in TEXTS if t] * 2
    b = align.PieceTokens(open(B, "rb").read(), most=5)
    assert b.pieces is not None
    assert [x.tolist() for i in range(0, len(texts), 3) for x in b.encode(texts[i:i + 3])] == b.model.encode([t[1:].decode() for t in texts])
    few, many = (align.Windows(align.ByteTokens(open(A, encoding="utf-8").read()), align.PieceTokens(open(B, "rb").read()), most=m) for m in (2, 10**6))
    for i in range(0, len(texts), 4):
        block = [t[1:] for t in texts[i:i + 4]]
        x, y = few.block(block), many.block(block)
        assert x[2] == y[2] and all((p == q).all() for p, q in zip(x[:2] + x[3:5], y[:2] + y[3:5]))
