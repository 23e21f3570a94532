import hashlib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from vecloom.llm import queries, secret_scan as S

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def entropies(text):
    """Spans by counting every window anew."""
    out = set()
    for pattern, window, least in S.CLASSES.values():
        for m in re.finditer(pattern, text):
            if any(re.search(a, m[0]) for a in S.ALLOW):
                continue
            high = [i for i in range(len(m[0]) - window + 1) if -sum(c / window * math.log2(c / window) for c in Counter(m[0][i:i + window]).values()) >= least - 1e-12]
            if high:
                out.add((m.start() + high[0], m.start() + high[-1] + window))
    return out


def expected(text):
    own = base(text)
    more = [(a, 3, b) for a, b in entropies(text) if not any(x < b and y > a for x, _, y in own)]
    name = lambda spans: ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return [sum(k == i for _, k, _ in own) for i in range(3)], hashlib.sha256(name(own).encode()).hexdigest(), name(own + more)


def texts():
    rng = random.Random(8)
    b64, hexa = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "0123456789abcdef"
    key = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    out = [
        None, "", "plain words only", "token:secret:abcdefghij", "PassWord == abc", 'api_key="' + key(b64, 30) + '"', "é\U0001F600 secret = " + key(b64, 40), "tokentoken=12345678 token=1234567",
        "AKIA" + "Z" * 11, "AKIA" + "Z" * 12, "xAKIAAKIA" + "0" * 20, key(hexa, 31), key(hexa, 32), "g" + key(hexa, 64) + "g", "see " + key(b64, 60) + " end", key(b64, 23), "abcdefghijklmnopqrstuvwxyz0123456789ABCD",
        "12345678901234567890123456789012345678901", "550e8400-e29b-41d4-a716-446655440000", "Donaudampfschifffahrtsgesellschaftskapitaen", "/usr/local/lib/python3/dist-packages/numpy",
        "===" * 20, "a" * 5000 + key(b64, 400) + "-" * 300, key(b64, 24) + " " + key(b64, 24) * 2, "token=" + key(b64, 50) + " " + key("ABCDEF0123456789", 24), "Secret\n:x token  :  'yyyyyyyy",
    ]
    for _ in range(40):
        out.append(" ".join(rng.choice([key("abcdef0123", rng.randint(1, 50)), key(b64 + "-_", rng.randint(1, 70)), "token", "=", ":", "password", "AKIA" + key("ABC123", 15), "word"]) for _ in range(rng.randint(1, 60))))
    return out + ["lorem ipsum " * 8000 + "token=abcdefgh12 " + key(b64, 40)]


def test_equals_brute_force(spark, monkeypatch):
    rows = list(enumerate(texts()))
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows + rows[:5]], "doc_id long, text string, secrets string")
    monkeypatch.setattr(queries, "table", lambda *_: frame)
    got = {}
    for r in queries.op4(spark, "").collect():
        got.setdefault(r.doc_id, ([r.n_assign, r.n_access, r.n_hex], r.base_sha256, r.spans))
    for i, t in rows:
        assert got[i] == expected(t or ""), (i, t)
    assert queries.op4(spark, "").count() == len(rows) + 5
    assert sum("entropy" in g[2] for g in got.values()) >= 5
    plan = queries.op4(spark, "")._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan.split("Physical Plan")[1])


def test_documents(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.n_assign, r.n_hex, r.base_sha256, r.spans) for r in queries.op4(spark, "/root/testdata/sf0.001").collect()}
    for r in frame.collect():
        (a, _, h), sha, spans = expected(r.text)
        assert got[r.doc_id] == (a, h, sha, spans)


def test_incremental_entropy(spark):
    frame = spark.createDataFrame([("ab" * 10 + "abcdefgh",), ("short",), ("a" * 40,)], "s string")
    got = [r.h for r in frame.select(S.high_windows(F.col("s"), 8, 2.9).alias("h")).collect()]
    assert [tuple(x) for x in got] == [(21, 21), (None, None), (None, None)]
