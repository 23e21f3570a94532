"""Merkle fixity audit of WARC replicas.

Records are laid out in archives of up to ``FANOUT ** DEPTH`` records. A leaf is a record's hash; a node is the hash of up to
``FANOUT`` ordered children, each with its range of offsets, so a root stands for every byte of its archive and their order. Two
replicas are compared by their roots; of an archive whose roots differ, only the children of differing nodes are looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.operators.catalog import global_rank
from vecloom.session import snapshot

FANOUT, DEPTH = 16, 3


def warc_record(record_id: Column, url: Column, payload: Column) -> Column:
    """The bytes of a resource record. Null columns are empty."""
    url, payload = (F.coalesce(c.cast("string"), F.lit("")) for c in (url, payload))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, payload, F.lit("\r\n\r\n"))


def record_hash(record: Column) -> Column:
    return F.sha2(record.cast("binary"), 256)


def layout(records: DataFrame, record_id: str = "record_id", tie: str = "tie", length: str = "length", fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """``records`` with ``archive``, ``ordinal`` in it, and the record's offsets ``start`` and ``stop``.

    Records lie in ascending order of id (null first) and then of ``tie``; rows that repeat both may lie in either order. Keep the
    payload out of ``records``: a hash and a length are enough. An empty table has no archives.
    """
    most = fanout**depth
    # Equal rows are told apart by where they were read, so that they need not all meet in one task.
    ranked = global_rank(records.withColumn("_row", F.monotonically_increasing_id()), [record_id, tie, "_row"], name="_rank")
    placed = ranked.withColumn("archive", F.floor((F.col("_rank") - 1) / most)).withColumn("ordinal", F.pmod(F.col("_rank") - 1, F.lit(most)))
    before = Window.partitionBy("archive").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.coalesce(F.sum(length).over(before), F.lit(0)))
    return placed.withColumn("stop", F.col("start") + F.col(length)).drop("_rank", "_row")


def merkle_tree(leaves: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> list[DataFrame]:
    """Levels ``(archive, node, start, stop, records, hash)`` from the leaves (0) to the roots of ``(archive, ordinal, start, stop, hash)``.

    A place without a record, or with a null hash, has no leaf. A place with several (repeated rows) has the least hash.
    """
    level = leaves.where("hash IS NOT NULL").groupBy("archive", F.col("ordinal").alias("node")).agg(F.min("start").alias("start"), F.min("stop").alias("stop"), F.min("hash").alias("hash"))
    levels = [snapshot(level.select("archive", "node", "start", "stop", F.lit(1).cast("long").alias("records"), "hash"), "leaves")]
    for i in range(depth):
        child = F.struct("node", F.concat_ws(":", "node", "start", "stop", "hash").alias("text"))
        ordered = F.transform(F.sort_array(F.collect_list(child)), lambda c: c["text"])
        up = levels[-1].groupBy("archive", F.floor(F.col("node") / fanout).alias("parent")).agg(
            F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("records").alias("records"), F.sha2(F.array_join(ordered, "|"), 256).alias("hash")
        )
        levels.append(snapshot(up.withColumnRenamed("parent", "node"), f"level-{i + 1}"))
    return levels


def audit(first: list[DataFrame], second: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """``(archive, ordinal, start, stop, status, first_hash, second_hash)`` of every record in which two replicas' trees differ.

    ``status``: ``changed``, ``missing`` (the second has no such record) or ``extra`` (the first has none). Offsets are the first's
    where it has the record. Equal replicas give no rows.
    """
    wrong = None
    for level in reversed(range(len(first))):
        a, b = first[level], second[level]
        if wrong is not None:
            up = wrong.select(F.col("archive").alias("_a"), F.col("node").alias("_n"))
            a, b = (x.join(up, (x["archive"] == F.col("_a")) & (F.floor(x["node"] / fanout) == F.col("_n")), "left_semi") for x in (a, b))
        a = a.select("archive", "node", F.col("start").alias("start_a"), F.col("stop").alias("stop_a"), F.col("hash").alias("first_hash"))
        b = b.select("archive", "node", F.col("start").alias("start_b"), F.col("stop").alias("stop_b"), F.col("hash").alias("second_hash"))
        wrong = snapshot(a.join(b, ["archive", "node"], "full").where("NOT (first_hash <=> second_hash AND start_a <=> start_b AND stop_a <=> stop_b)"), f"wrong-{level}")
    status = F.when(F.col("second_hash").isNull(), "missing").when(F.col("first_hash").isNull(), "extra").otherwise("changed")
    return wrong.select(
        "archive", F.col("node").alias("ordinal"), F.coalesce("start_a", "start_b").alias("start"), F.coalesce("stop_a", "stop_b").alias("stop"),
        status.alias("status"), "first_hash", "second_hash",
    )
