import glob
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow.orc
from tokenizers import Tokenizer

from vecloom.llm import subwords, token_orc
from vecloom.session import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
ROWS = [
    (5, "Hello,  world!\n\n  It's  2024.\t\tdon't \n"), (3, None), (4, ""), (4, " \n "), (None, "no id"), (9, "caf\xe9\xa0 na\xefve 　 \U0001F600 x\x1cy !\x85!"),
    (8, "a<|endoftext|> b <|endoftext|>\nc"), (2, "word " * 30000), (7, "same"), (7, "same"), (1, "  lead and trail  "), (6, "\x0b\x0c \r\n x"),
]


def brute(rows):
    tokenizer, start, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_units_encode_like_whole_texts(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [t or "" for _, t in ROWS] + [r.text for r in table.collect()]
    tokenizer = Tokenizer.from_file(PATH)
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for most in (400_000, 10):
        encoder = subwords.Encoder(subwords.load(PATH), most)
        got = [x.tolist() for i in range(0, len(texts), 50) for x in encoder.encode(texts[i:i + 50])]
        assert got == want
        assert most > 10 or len(encoder.pieces.keys) < 20_000


def test_units_that_share_a_hash_stay_apart(monkeypatch):
    """Every unit has one hash of three: contents decide."""
    monkeypatch.setattr(subwords, "slice_hashes", lambda flat, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(3))
    tokenizer, encoder = Tokenizer.from_file(PATH), subwords.Encoder(subwords.load(PATH), 40)
    texts = [t or "" for _, t in ROWS if len(t or "") < 1000] * 3 + ["one two six ten"]
    for _ in range(3):
        assert [x.tolist() for x in encoder.encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_files_round_trip(spark):
    docs = spark.createDataFrame([(i, t, "z") for i, t in ROWS], "doc_id long, text string, ids string").repartition(4)
    for file_bytes in (token_orc.FILE_BYTES, 20):
        path = scratch_path(spark, "orc")
        token_orc.write_tokens(docs, path, subwords.load(PATH), file_bytes=file_bytes)
        rows = token_orc.read_tokens(spark, path)
        got = sorted((tuple(r) for r in token_orc.token_index(rows).collect()), key=lambda r: r[1])
        want = brute(ROWS)
        # Documents of one id may stand in either order.
        assert [r[0] for r in got] == [r[0] for r in want]
        assert sorted((r[0] or -1, r[2], r[3]) for r in got) == sorted((r[0] or -1, r[2], r[3]) for r in want)
        assert all(b[1] == a[1] + a[2] for a, b in zip(got, got[1:])) and got[0][1] == 0
        found = token_orc.read_tokens(spark, path, [2, 9, 77]).collect()
        assert sorted(r.doc_id for r in found) == [2, 9]
        files = glob.glob(f"{path.removeprefix('file://')}/*.orc")
        metas = [pyarrow.orc.ORCFile(f) for f in files]
        assert sum(m.nrows for m in metas) == len(ROWS) and all(m.row_index_stride == 2000 for m in metas)


def test_empty_table(spark):
    path = scratch_path(spark, "orc")
    token_orc.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, subwords.load(PATH))
    assert token_orc.token_index(token_orc.read_tokens(spark, path)).count() == 0


def test_filters_reach_the_metadata(spark):
    path = scratch_path(spark, "orc")
    docs = spark.range(5000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    token_orc.write_tokens(docs, path, subwords.load(PATH))
    plan = token_orc.read_tokens(spark, path, [77])
    assert "In(doc_id" in plan._jdf.queryExecution().toString() or "EqualTo(doc_id,77)" in plan._jdf.queryExecution().toString()
    raw = b"".join(open(f, "rb").read() for f in glob.glob(f"{path.removeprefix('file://')}/*.orc"))
    assert raw.startswith(b"ORC") and plan.count() == 1


def test_working_memory_of_a_block_is_bounded():
    """What is held for one block of texts, beside the units kept: a task of two shares an executor with the writer."""
    encoder = subwords.Encoder(subwords.load(PATH))
    line = " ".join(f"word{i % 5000} und" for i in range(2000)).encode()
    texts = [line] * (token_orc.BLOCK_BYTES // len(line))
    encoder.encode_bytes(texts[:1])
    tracemalloc.start()
    encoder.encode_bytes(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20
