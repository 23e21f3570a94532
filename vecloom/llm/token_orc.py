"""Token ids of documents in ORC files.

The ids are an integer list column, which ORC's writer run-length encodes; rows are in ascending id order over all files, and each
file holds a row index (least and largest value per stripe and per row group) and a Bloom filter on the document ids. A reader
splits files at stripes, and a filter on ids skips files, stripes and row groups by that metadata.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecloom.llm.subwords import Encoder
from vecloom.llm.text import blocks, items, kept

END_ID = 2
#: Texts of about this many bytes go into one file.
FILE_BYTES = 64 << 20
#: Bytes of texts that are encoded at once; the working arrays take some thirty times as much.
BLOCK_BYTES = 1 << 20
#: Rows of a file whose starts are summed in one group.
RUN = 1 << 16
#: Settings of the writer.
ORC = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "2000", "orc.stripe.size": str(32 << 20), "compression": "zstd"}
FILES = "doc_id long, part int, row long, n_tokens int, ids array<int>"


def write_tokens(docs: DataFrame, path: str, spec: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> None:
    """Write ``(doc_id, part, row, n_tokens, ids)``; ``part`` and ``row`` say where a row lies: file by file, row by row.

    ``ids`` are those of the whole text and ``end_id``. Null texts are empty, so their list is ``[end_id]``. Null ids come first;
    rows of one id are in the order of their text's hash. Repeated rows are all written, an empty table gives files without rows.
    Other columns are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // file_bytes), min(spark.sparkContext.defaultParallelism, size // (1 << 20)))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    sent = spark.sparkContext.broadcast({"spec": spec})

    def run(batches):
        encoder = kept(sent.value, "encoder", lambda: Encoder(sent.value["spec"]))
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, at = batch.column("doc_id"), 0
            for block in blocks(items(batch.column("text").cast(pa.large_binary())), BLOCK_BYTES):
                found = encoder.encode_bytes(block)
                lengths = np.array([len(x) + 1 for x in found], np.int32)
                ends = np.cumsum(lengths)
                flat = np.full(int(lengths.sum()), end_id, np.int32)
                inside = np.ones(len(flat), bool)
                inside[ends - 1] = False
                flat[inside] = np.concatenate(found)
                offsets = np.concatenate(([0], ends)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, len(block)), pa.array(np.full(len(block), part, np.int32)), pa.array(np.arange(row, row + len(block))),
                        pa.array(lengths), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                    ],
                    names=["doc_id", "part", "row", "n_tokens", "ids"],
                )
                at, row = at + len(block), row + len(block)

    placed = source.repartitionByRange(int(n), *order).sortWithinPartitions(*order)
    placed.mapInArrow(run, FILES).write.mode("overwrite").options(**ORC).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: Sequence[int] | None = None) -> DataFrame:
    """The files' rows; with ``doc_ids``, only theirs, found by the metadata."""
    rows = spark.read.schema(FILES).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(list(doc_ids)))


def token_index(rows: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of what ``read_tokens`` gives: ids of all documents before, with the end, and their
    crc32 as little-endian unsigned 32-bit integers. Sums run inside runs of rows of one file and over runs, never over all rows.
    """

    def digest(batches):
        for batch in batches:
            ids = batch.column("ids")
            values, offsets = ids.values.to_numpy(), ids.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b].astype("<u4").tobytes()) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), batch.column("row"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
                names=["doc_id", "part", "row", "n_tokens", "ids_crc32"],
            )

    lean = rows.mapInArrow(digest, "doc_id long, part int, row long, n_tokens long, ids_crc32 long")
    lean = lean.withColumn("run", F.floor(F.col("row") / RUN))
    before = Window.orderBy("part", "run").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.select("part", F.floor(F.col("row") / RUN).alias("run"), "n_tokens").groupBy("part", "run").agg(F.sum("n_tokens").alias("n"))
    runs = runs.select("part", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part", "run").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    lean = lean.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return lean.join(runs, ["part", "run"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
