"""Drive the incremental insert from a stream of arriving files.

There is no state of its own: each micro-batch is inserted by key against the
stored table, so a batch that is replayed after a failure adds nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from vecloom.sources import sinks


def stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at ``path``, empty before the first write."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def insert_new_files(spark: SparkSession, source: str, target: str, checkpoint: str, schema, keys: Sequence[str], order: Sequence[str], file_format: str = "parquet") -> None:
    """Insert rows of all files that arrived since the last run, then stop."""

    def insert(batch: DataFrame, _epoch: int) -> None:
        session = batch.sparkSession
        fresh = sinks.insert_ignore(stored(session, target, schema), batch, keys, order)
        sinks.append(fresh, target)

    query = (
        spark.readStream.schema(schema).format(file_format).load(source)
        .writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
