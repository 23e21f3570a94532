"""Registry of the repository's queries and helpers they share.

Every query reads the given tables in full. ``sql`` is the same result in
DuckDB's dialect; it is left out where SQL cannot express the operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vec_id, label, v)`` with the vector as doubles."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def r6(c, places: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, places) + 0.0


def long(df: DataFrame, vector: str, *keys: str, places: int = 6) -> DataFrame:
    """One row per vector item: ``(keys..., pos, x)``."""
    return df.select(*keys, F.posexplode(vector).alias("pos", "_x")).select(*keys, "pos", r6("_x", places).alias("x"))


# SQL pieces.
E = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


def sql_long(source: str, vector: str, *keys: str, places: int = 6) -> str:
    ks = "".join(f"{k}, " for k in keys)
    return (
        f"SELECT {ks}pos, round(_x, {places}) + 0.0 AS x FROM (SELECT {ks}unnest(range(len({vector})))::INTEGER AS pos, "
        f"unnest({vector}) AS _x FROM {source})"
    )
