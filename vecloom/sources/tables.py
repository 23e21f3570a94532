"""Table scans: whole, projected, paged, counted, and JSON lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.operators.catalog import global_rank


def scan(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def scan_cols(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Projection scan; only the named columns are read from the files."""
    return spark.read.parquet(path).select(*columns)


def scan_page(df: DataFrame, order_by: str | list[str], page: int, size: int) -> DataFrame:
    """One page of ``size`` rows in key order. Bulk work should use a plain scan."""
    return df.orderBy(order_by).offset(page * size).limit(size)


def scan_pages(df: DataFrame, order_by: str | list[str], size: int) -> DataFrame:
    """All rows with the ``page`` they are on, from 0, in pages of ``size`` rows in key order.

    Rows are numbered inside range slices, so no page costs more than another
    and no task sees all rows. The keys must tell rows apart.
    """
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    return global_rank(df, keys, name="_rank").withColumn("page", F.floor((F.col("_rank") - 1) / size)).drop("_rank")


def row_count(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count("*").alias(name))


def lookup_json_list(df: DataFrame, id_col: str, wanted, json_col: str) -> DataFrame:
    """Items of the JSON list held in one row: ``(pos, item)``.

    Text that is valid JSON but not a list yields nothing.
    """
    text = F.trim(F.col(json_col))
    return (
        df.filter(F.col(id_col) == F.lit(wanted))
        .filter(text.startswith("["))
        .select(F.posexplode(F.from_json(text, "array<string>")).alias("pos", "item"))
    )
