"""Tables kept in buckets of their key, so that a change rewrites only the buckets it touches.

A table is a Parquet folder partitioned by ``bucket``, a hash of the key. A change reads the buckets of its own keys alone (partition
pruning), works out their new rows, stores these, and then overwrites just those partitions. The files of all other buckets stay. ``by``,
an expression over the key, numbers the buckets (null: -1): enough of them that one is a modest file, few enough to list.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.session import discard, scratch_path
from vecloom.sources import sinks

BUCKET = "bucket"
BUCKETS = 256


def bucket_of(keys: Sequence[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).cast("int")


def _number(by: Column) -> Column:
    return F.coalesce(by.cast("int"), F.lit(-1))


def create(df: DataFrame, path: str, by: Column) -> DataFrame:
    """Store ``df``, which has one row per key, and give it back without its ``bucket`` column."""
    _write(df.withColumn(BUCKET, _number(by)), path, "errorifexists")
    return read(df.sparkSession, path, df)


def read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return _stored(spark, path, like).select(*like.columns)


def _stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.withColumn(BUCKET, F.lit(0)).schema).parquet(path)


def _write(df: DataFrame, path: str, mode: str) -> None:
    # One writer for each bucket, whose size the caller bounds by their number.
    df.repartition(BUCKET).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def change(stored: DataFrame, path: str, incoming: DataFrame, by: Column, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
    """Replace the touched buckets of the table at ``path`` by ``merge(their rows, incoming)``; returns them.

    ``stored`` only gives the table's columns. ``merge`` must keep every row of the buckets it gets, under the same keys or keys of
    ``incoming``. New rows are stored before a bucket is overwritten, so a lost executor repeats its tasks and loses nothing. No incoming
    rows: nothing is written.
    """
    spark, like = incoming.sparkSession, stored.drop(BUCKET)
    held = [scratch_path(spark, name) for name in ("incoming", "buckets")]
    incoming.withColumn(BUCKET, _number(by)).write.parquet(held[0])
    new = spark.read.schema(incoming.withColumn(BUCKET, F.lit(0)).schema).parquet(held[0])
    # As many numbers as there are buckets, at most.
    touched = sorted(r[0] for r in new.select(BUCKET).distinct().collect())
    if touched:
        old = _stored(spark, path, like).where(F.col(BUCKET).isin(touched)).select(*like.columns)
        merged = merge(old, new.drop(BUCKET)).select(*like.columns).withColumn(BUCKET, _number(by))
        merged.write.parquet(held[1])
        _write(spark.read.schema(merged.schema).parquet(held[1]), path, "overwrite")
    discard(spark, *held)
    return touched


def upsert(stored: DataFrame, path: str, incoming: DataFrame, by: Column, keys: Sequence[str], replace: Sequence[str], **more) -> list[int]:
    """``sinks.upsert`` over the touched buckets."""
    return change(stored, path, incoming, by, lambda old, new: sinks.upsert(old, new, keys, replace, **more))


def update_by_key(stored: DataFrame, path: str, updates: DataFrame, by: Column, key: str, column: str, **more) -> list[int]:
    """``sinks.update_by_key`` over the touched buckets; keys that the table lacks add nothing."""
    return change(stored, path, updates, by, lambda old, new: sinks.update_by_key(old, new, key, column, **more))
