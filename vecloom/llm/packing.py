"""Packing documents into sequences of ids, every window in the sources' target proportions.

Each source is a queue of documents. All ids form one stream, cut into windows of ``window`` ids, and a document is cut wherever a
window ends, so nothing is padded but the end of the stream, and that is cut at powers of two. In the stream the queues are served by
deficit round-robin: at each window a queue is credited with its share of the window's ids, it may send ids while its credit lasts, and
what it could not use, or took beyond it, is carried to the next window.

Documents are dealt to buckets by a hash of their row's number, a bounded number of ids each, whatever their source or text. The
target of a queue up to a bucket's first id, less what the buckets before hold of the queue, is the deficit carried into the bucket:
two sums over a table of bucket sizes. So buckets are packed side by side and yet go on where the one before ended.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.llm.subwords import Encoder
from vecloom.llm.text import blocks, items, kept
from vecloom.session import discard, scratch_path

END_ID = 1
#: Ids of a sequence, of a bucket, and the least that a queue sends at once while more of its document is left.
SEQUENCE, BUCKET, LEAST = 2048, 1 << 20, 64
#: Buckets whose sizes are summed in one group.
RUN = 1024
ENCODED = "row long, doc_id long, source string, start long, n long, doc_tokens long, ids binary"
PIECES = "doc_id long, source string, start long, length long, {0}, doc_tokens long, sequence_id long, offset long"


def encoded(docs: DataFrame, spec: str, doc_id: str = "doc_id", text: str = "text", source: str = "source", end_id: int = END_ID, most: int = BUCKET // 8) -> DataFrame:
    """``(row, doc_id, source, start, n, doc_tokens, ids)``: the ids of each whole text and ``end_id``, as little-endian integers of 2 or 4
    bytes. A document of more than ``most`` ids has several rows, from ``start`` on each."""
    sent = docs.sparkSession.sparkContext.broadcast({"spec": spec})

    def run(batches):
        encoder = kept(sent.value, "encoder", lambda: Encoder(sent.value["spec"]))
        kind = width(encoder.tokenizer.get_vocab_size(), end_id)
        end, row = np.array([end_id], kind), TaskContext.get().partitionId() << 40
        for batch in batches:
            at = 0
            for block in blocks(items(batch.column("text").cast(pa.large_binary())), 4 << 20):
                found = [np.concatenate((x.astype(kind), end)) for x in encoder.encode_bytes(block)]
                parts = [(i, j, x[j:j + most]) for i, x in enumerate(found) for j in range(0, len(x), most)]
                of = pa.array([at + i for i, _, _ in parts])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(len(parts))), batch.column("doc_id").take(of), batch.column("source").take(of), pa.array([j for _, j, _ in parts], pa.int64()),
                        pa.array([len(x) for _, _, x in parts], pa.int64()), pa.array([len(found[i]) for i, _, _ in parts], pa.int64()), pa.array([x.tobytes() for _, _, x in parts], pa.binary()),
                    ],
                    names=["row", "doc_id", "source", "start", "n", "doc_tokens", "ids"],
                )
                at, row = at + len(block), row + len(parts)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.col(source).cast("string").alias("source"))
    return rows.mapInArrow(run, ENCODED)


def width(vocabulary: int, end_id: int) -> str:
    return "<u2" if max(vocabulary - 1, end_id) < 1 << 16 else "<u4"


def edge(at: int, total: int, window: int = SEQUENCE) -> tuple[int, int, int]:
    """``(sequence, its first place, its end)`` of place ``at`` of a stream of ``total`` ids: whole windows, then parts at powers of two."""
    full = total // window * window
    if at < full:
        i = at // window
        return i, i * window, (i + 1) * window
    begin, i, rest = full, full // window, total - full
    while True:
        size = 1 << (rest.bit_length() - 1)
        if at < begin + size:
            return i, begin, begin + size
        begin, i, rest = begin + size, i + 1, rest - size


def phases(sizes: Mapping, weights: Mapping) -> dict:
    """Of each queue ``(times, served)``: when queues send by weight until they are empty, and the others then share by weight, it has sent
    so many ids at so many ids of the stream; straight between. ``sizes`` and ``weights`` are by queue; a weight of 0 waits for the others.
    """
    left, now = {q: float(n) for q, n in sizes.items() if n > 0}, 0.0
    out = {q: ([0.0], [0.0]) for q in left}
    while left:
        live = [q for q in left if weights[q] > 0] or list(left)
        share = {q: weights[q] if weights[q] > 0 else 1.0 for q in live}
        whole = sum(share.values())
        step = min(left[q] * whole / share[q] for q in live)
        now += step
        for q in live:
            left[q] -= step * share[q] / whole
        left = {q: n for q, n in left.items() if n > 1e-6}
        for q, (times, served) in out.items():
            times.append(now)
            served.append(sizes[q] - left.get(q, 0.0))
    return out


def deal(queues: list[np.ndarray], carried: np.ndarray, targets: list[tuple[np.ndarray, np.ndarray]], begin: int, total: int, window: int = SEQUENCE, least: int = LEAST):
    """Pieces ``(queue, document, start, length, sequence, offset)`` of one bucket in the stream's order.

    ``queues``: ids of each document of each queue; ``carried``: their deficits at ``begin``, the bucket's first place; ``targets``: for
    each queue the ids due at places of the stream, straight between.
    """
    n = len(queues)
    left = [int(q.sum()) for q in queues]
    stop = begin + sum(left)
    ends = [begin]
    while ends[-1] < stop:
        ends.append(edge(ends[-1], total, window)[2])
    quanta = np.diff([np.interp(ends, times, due) for times, due in targets], axis=1).T.tolist() if n else []
    doc, start = [0] * n, [0] * n
    credit, at, turn, out = carried.astype(float).tolist(), begin, 0, []
    for quantum in quanta:
        sequence, first, end = edge(at, total, window)
        credit = [c + more for c, more in zip(credit, quantum)]
        end = min(end, stop)
        idle = 0
        while at < end:
            q, turn = turn, (turn + 1) % n
            if idle > n:
                # No queue can pay for a piece: the one to which most is due sends on credit.
                q = max((i for i in range(n) if left[i]), key=lambda i: (credit[i], -i))
            rest = int(queues[q][doc[q]]) - start[q] if left[q] else 0
            if not rest or idle <= n and credit[q] < min(least, rest, end - at):
                idle += 1
                continue
            budget = max(int(credit[q]), min(least, rest))
            idle = 0
            while budget > 0 and at < end and left[q]:
                rest = int(queues[q][doc[q]]) - start[q]
                take = min(rest, end - at, budget)
                out.append((q, doc[q], start[q], take, sequence, at - first))
                at, budget = at + take, budget - take
                credit[q] -= take
                left[q] -= take
                doc[q], start[q] = (doc[q] + 1, 0) if take == rest else (doc[q], start[q] + take)
    return out


def _running(df: DataFrame, value: str, *by: str) -> DataFrame:
    """``df`` (one row per bucket and ``by``) with ``before``: the sum of ``value`` over lesser buckets, inside runs and then over runs."""
    df = df.withColumn("run", F.floor(F.col("bucket") / RUN))
    over = Window.partitionBy(*by).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = df.groupBy(*by, "run").agg(F.sum(value).alias("_n")).select(*by, "run", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_base"))
    inside = F.sum(value).over(Window.partitionBy(*by, "run").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    return df.join(runs, [*by, "run"]).withColumn("before", F.col("_base") + F.coalesce(inside, F.lit(0))).drop("_base", "run")


def packed(
    docs: DataFrame, spec: str, doc_id: str = "doc_id", text: str = "text", source: str = "source", end_id: int = END_ID, window: int = SEQUENCE,
    weights: Mapping[str | None, float] | None = None, other: float = 1.0, bucket: int = BUCKET, least: int = LEAST, digest: bool = False,
) -> DataFrame:
    """``(doc_id, source, start, length, ids, doc_tokens, sequence_id, offset)``: a row per piece of a document.

    ``start``: the document's ids before the piece; ``offset``: its place in its sequence; ``ids``: its ids, or with ``digest``
    ``ids_crc32``, their crc32 as little-endian unsigned 32-bit integers. Every id of every document, its end included, is in one piece.
    All sequences are full but those that end the stream, whose sizes are falling powers of two.

    Without ``weights`` each source's share of a window is its share of all ids, so all queues last to the end. With ``weights`` (by source;
    all others are one queue of weight ``other``) queues send by weight until they are empty, and the rest then share by weight.

    Null and empty texts are their end alone; a null source is a source; null ids stay null; repeated rows are each packed; an empty
    table gives no pieces. Other columns are not read.
    """
    spark, paths = docs.sparkSession, []

    def store(df: DataFrame, name: str) -> DataFrame:
        paths.append(scratch_path(spark, name))
        df.write.option("compression", "zstd").parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    rows = store(encoded(docs, spec, doc_id, text, source, end_id, max(1, bucket // 8)), "encoded")
    kind = width(Encoder(spec).tokenizer.get_vocab_size(), end_id)
    total = rows.agg(F.sum("n")).first()[0] or 0
    n_buckets = max(1, -(-total // bucket))
    # Where in its queue a row stands, from 0 to 1, whatever its source or text.
    place = F.xxhash64("row") / F.lit(2.0**64) + 0.5
    if weights is None:
        queue, time = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source")), place * F.lit(float(total))
    else:
        names = list(weights)
        queue = F.coalesce(*[F.when(F.col("source").eqNullSafe(F.lit(s)), F.lit(str(i))) for i, s in enumerate(names)], F.lit(str(len(names)))) if names else F.lit("0")
        # One row per named source, and one for all others.
        sizes = {r["q"]: r["n"] for r in rows.groupBy(queue.alias("q")).agg(F.sum("n").alias("n")).collect()}
        curves = phases(sizes, {str(i): w for i, w in enumerate([*weights.values(), other])})
        time = F.lit(0.0)
        for q, (times, due) in curves.items():
            steps = zip(times, times[1:], due, due[1:])
            steps = [x for x in steps if x[3] > x[2]]
            sent_before = place * F.lit(float(sizes[q]))
            reach = F.lit(steps[0][0])
            for x, y, a, b in steps:
                reach = reach + F.greatest(F.lit(0.0), F.least(F.lit(1.0), (sent_before - F.lit(a)) / F.lit(b - a))) * F.lit(y - x)
            time = F.when(queue == F.lit(q), reach).otherwise(time)
    number = F.least(F.lit(n_buckets - 1), F.floor(time / F.lit(float(bucket)))).cast("long")
    placed = rows.withColumn("queue", queue).withColumn("bucket", number)

    sums = store(placed.groupBy("bucket", "queue").agg(F.sum("n").alias("n")), "sums")
    begins = _running(sums.groupBy("bucket").agg(F.sum("n").alias("n")), "n").select("bucket", F.col("before").alias("begin"))
    plan = _running(sums, "n", "queue").select("bucket", "queue", "before").join(begins, "bucket")
    if weights is None:
        whole = sums.groupBy(F.col("queue").alias("_q")).agg(F.sum("n").cast("double").alias("all"))
        plan = plan.join(whole, F.col("queue") == F.col("_q")).drop("_q")
        plan = plan.withColumn("times", F.array(F.lit(0.0), F.lit(float(max(1, total))))).withColumn("due", F.array(F.lit(0.0), "all")).drop("all")
    else:
        listed = [(q, t, d) for q, (t, d) in curves.items()]
        plan = plan.join(F.broadcast(spark.createDataFrame(listed, "queue string, times array<double>, due array<double>")), "queue")
    plan = store(plan.select("bucket", "queue", "before", "begin", "times", "due"), "plan")

    def pack(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks().sort_by("row"), right.combine_chunks()
        name, begin = right.column("queue").to_pylist(), right.column("begin")[0].as_py()
        order = sorted(range(len(name)), key=name.__getitem__)
        at = {name[i]: k for k, i in enumerate(order)}
        targets = [tuple(np.array(right.column(c)[i].as_py()) for c in ("times", "due")) for i in order]
        before = np.array([right.column("before")[i].as_py() for i in order], float)
        carried = np.array([float(np.interp(begin, *t)) for t in targets]) - before
        of = np.array([at[q] for q in left.column("queue").to_pylist()])
        docs_of = [np.flatnonzero(of == q) for q in range(len(name))]
        n = left.column("n").to_numpy()
        pieces = np.array(deal([n[d] for d in docs_of], carried, targets, begin, total, window, least), np.int64).reshape(-1, 6)
        first = np.cumsum([0, *map(len, docs_of)])
        doc = np.concatenate(docs_of)[first[pieces[:, 0]] + pieces[:, 1]] if len(pieces) else np.zeros(0, np.int64)
        raw = left.column("ids").combine_chunks()
        part = [np.frombuffer(raw[d].as_py(), kind)[s:s + m] for d, s, m in zip(doc.tolist(), pieces[:, 2].tolist(), pieces[:, 3].tolist())]
        ids = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in part], pa.int64()) if digest else pa.array([x.astype(np.int32) for x in part], pa.list_(pa.int32()))
        take = pa.array(doc)
        return pa.table(
            [left.column("doc_id").take(take), left.column("source").take(take), pa.array(left.column("start").to_numpy()[doc] + pieces[:, 2]), pa.array(pieces[:, 3]), ids, left.column("doc_tokens").take(take), pa.array(pieces[:, 4]), pa.array(pieces[:, 5])],
            names=["doc_id", "source", "start", "length", "ids_crc32" if digest else "ids", "doc_tokens", "sequence_id", "offset"],
        )

    grouped = placed.select("bucket", "queue", "row", "doc_id", "source", "start", "n", "doc_tokens", "ids").groupBy("bucket").cogroup(plan.groupBy("bucket"))
    schema = PIECES.format("ids_crc32 long" if digest else "ids array<int>")
    out = grouped.applyInArrow(pack, schema)
    discard(spark, *paths[1:-1])
    return out
