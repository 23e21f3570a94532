"""SimHash near-duplicates with deletion-variant signatures.

A text's fingerprint has bit i set if over half of its word shingles' XXH64 values have it. Two fingerprints link if they differ in
at most ``bits`` positions. With ``bits // 2 + 1`` segments, one segment differs by at most one bit, so the pair shares either that
segment or the segment with one position deleted. Those variants are indexed, joined by equality and verified. Only buckets of up to
``HOT`` fingerprints are joined. Fingerprints of a larger bucket meet by another exact way, at a fixed cost for each: two values
differ by at most two bits exactly if some value differs by at most one from both, so each is listed under itself and its 64
one-bit neighbours, and whatever meets under one value is linked to the least there. Such a list has 65 members at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.graph import components
from vecloom.llm.text import as_bytes
from vecloom.session import snapshot

SHINGLE, BITS, SEED, HOT = 3, 2, 42, 64


def fingerprint_of(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint, unsigned. Fewer words than ``shingle``: the whole sequence is the only shingle. No words: 0."""
    words = text.lower().split()
    n = len(words) - shingle + 1
    if not words:
        return 0
    if n < 1:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    ends = ends.tolist()[shingle - 1:]
    for at in range(0, n, 1 << 15):
        h = np.array([digest(joined[s:e], seed) for s, e in zip(starts[at:at + (1 << 15)], ends[at:at + (1 << 15)])], np.uint64)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduceat(bits, np.arange(0, len(bits), 128), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(((counts * 2 > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``(doc_id, text_hash, fp)``: a row per row of ``docs``; ``text_hash`` tells rows of one id apart."""

    def run(batches):
        for batch in batches:
            found = [fingerprint_of(t, shingle, seed) for t in batch.column("text").to_pylist()]
            fp = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), fp], names=["doc_id", "text_hash", "fp"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), as_bytes(text).alias("text"))
    return source.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _segments(bits: int) -> list[tuple[int, int]]:
    """``(shift, width)`` of each segment."""
    n = bits // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])]


def _long(x: int) -> Column:
    """A literal of the 64 bits of ``x``."""
    x &= (1 << 64) - 1
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def variants(fp: str, bits: int = BITS) -> Column:
    """Array of ``(kind, key, bit)``: each segment whole (``bit`` null), and with each position deleted (``bit``: what stood there)."""
    out = []
    for s, (shift, width) in enumerate(_segments(bits)):
        seg = F.shiftrightunsigned(F.col(fp), shift).bitwiseAND(_long((1 << width) - 1))
        out.append(F.struct(F.lit(100 * s).alias("kind"), seg.alias("key"), F.lit(None).cast("int").alias("bit")))
        for i in range(width):
            bit = F.shiftrightunsigned(F.col(fp), shift + i).bitwiseAND(_long(1)).cast("int")
            out.append(F.struct(F.lit(100 * s + 1 + i).alias("kind"), seg.bitwiseAND(_long(~(1 << i))).alias("key"), bit.alias("bit")))
    return F.array(*out)


def links(fps: DataFrame, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """Links ``(a, b)`` between the distinct, non-null values of column ``fp`` that hold all components together.

    Buckets of up to ``hot`` values give each of their pairs that differ by at most ``bits``. For ``bits`` up to 2, values of larger
    buckets are linked to the least value that shares a one-bit neighbour with them. For more bits there is no such way, and large
    buckets are joined too.
    """
    if bits < 1:
        raise ValueError("equal fingerprints are one value; bits must be 1 or more")
    listed = fps.select("fp", F.explode(variants("fp", bits)).alias("x")).select("fp", "x.*")
    shared = listed.groupBy("kind", "key").agg(F.count("*").alias("n"), F.min("bit").alias("lo"), F.max("bit").alias("hi"))
    shared = snapshot(shared.where("n > 1 AND (lo IS NULL OR lo < hi)").select("kind", "key", "n"), "buckets")
    met = snapshot(listed.join(shared, ["kind", "key"]), "met")
    cold = met.where(F.col("n") <= hot) if bits <= 2 else met
    other = cold.select("kind", "key", F.col("fp").alias("b"), F.col("bit").alias("bit_b"))
    pairs = cold.select("kind", "key", F.col("fp").alias("a"), "bit").join(other, ["kind", "key"])
    pairs = pairs.where(F.expr(f"CASE WHEN bit IS NULL THEN a < b ELSE bit < bit_b END AND bit_count(a ^ b) <= {bits}")).select("a", "b")
    if bits > 2:
        return pairs.distinct()
    far = met.where(F.col("n") > hot).select("fp").distinct()
    around = [F.col("fp")] + [F.col("fp").bitwiseXOR(_long(1 << i)) for i in range(64)]
    if bits == 1:
        around = [F.struct(F.lit(i), F.col("fp").bitwiseAND(_long(~(1 << i)))) for i in range(64)]
    near = far.select("fp", F.explode(F.array(*around)).alias("v")).groupBy("v").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    stars = near.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return pairs.union(stars).distinct()


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bits: int = BITS, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """``(doc_id, text_hash, fp, root, component_id)``: a row per row of ``docs``, with the least id that its links reach.

    ``root`` is one fingerprint of the component, the same for all its rows.

    Equal fingerprints are one node, so copies are combined before any join. Null texts and texts without words have fingerprint 0
    and link like any other. A null id takes part and gets the least id of its component, null if that has none. Repeated rows stay.
    An empty table gives an empty one. Columns of ``docs`` other than these two are not read.
    """
    marked = snapshot(fingerprints(docs, doc_id, text, shingle, seed), "fingerprints")
    nodes = snapshot(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    root = components(links(nodes.select("fp"), bits, hot)).select(F.col("node").alias("fp"), "root")
    placed = snapshot(nodes.join(root, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "placed")
    least = snapshot(placed.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    known = snapshot(placed.join(least, "root").select("fp", "root", "component_id"), "known")
    return marked.join(known, "fp", "left").select("doc_id", "text_hash", "fp", "root", "component_id")


def hex_fingerprint(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component: the one of the least id, then of the least text hash; nulls last.

    Columns stay as they are. Rows that repeat an id and its text count as one document; of these an arbitrary row stays.
    """
    found = simhash_components(docs, doc_id, text, **options)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    kept = snapshot(found.groupBy("root").agg(F.min(order).alias("k")).select("k.doc_id", "k.text_hash"), "kept")
    rows = docs.withColumn("_text_hash", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    same = rows[doc_id].cast("long").eqNullSafe(kept["doc_id"]) & (rows["_text_hash"] == kept["text_hash"])
    return rows.join(kept, same, "left_semi").dropDuplicates([doc_id, "_text_hash"]).drop("_text_hash")
