"""Row predicates and validators. A validator returns ``(kept, rejects)``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom import schemas
from vecloom.functions.vectors import is_finite

# The metadata columns whose absence marks a row for filling.
SONG_METADATA = ("song_name", "artist_name", "explicit", "popularity", "duration_ms", "album")


def missing_any(df: DataFrame, columns: Sequence[str] = SONG_METADATA) -> DataFrame:
    return df.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))


def missing_blank(df: DataFrame, column: str = "artist_name") -> DataFrame:
    """Rows with an empty string; null does not count as empty."""
    return df.filter(F.col(column) == "")


def min_count(df: DataFrame, column: str = "song_count", least: int = 5) -> DataFrame:
    return df.filter(F.col(column) >= least)


def has_vector(df: DataFrame, vector: str = "feature_vector", owner: str | None = None, value=None) -> DataFrame:
    kept = df.filter(F.col(vector).isNotNull())
    return kept if owner is None else kept.filter(F.col(owner) == F.lit(value))


def noise_mask(df: DataFrame, label: str = "cluster_id") -> DataFrame:
    return df.filter(F.col(label) != -1)


def _split(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    tagged = df.withColumn("reason", reason)
    return tagged.filter(F.col("reason").isNull()).drop("reason"), tagged.filter(F.col("reason").isNotNull())


def verify_vectors(df: DataFrame, vector: str = "feature_vector", dim: int = schemas.VECTOR_SIZE) -> tuple[DataFrame, DataFrame]:
    v = F.col(vector)
    return _split(
        df,
        F.when(v.isNull(), "missing vector")
        .when(F.size(v) != dim, "wrong length")
        .when(~is_finite(v), "non-finite value"),
    )


def max_duration(df: DataFrame, duration: str, limit: float = 900.0) -> tuple[DataFrame, DataFrame]:
    """Reject rows strictly longer than ``limit`` seconds."""
    return _split(df, F.when(F.col(duration) > limit, "too long"))


def segment_gate(segments: DataFrame, samples: str = "n_samples", rate: float = 1.0, rms: str = "rms", min_rms: float = 0.01) -> DataFrame:
    """Segments of at least one second with enough energy."""
    return segments.filter((F.col(samples) >= rate) & (F.col(rms) >= min_rms))


def duplicate_keys(df: DataFrame, keys: Sequence[str], constraint: str) -> DataFrame:
    dup = df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")
    return dup.select(F.lit(constraint).alias("constraint"), F.to_json(F.struct(*keys)).alias("key"), "n_rows")


def null_columns(df: DataFrame, keys: Sequence[str], columns: Sequence[str], constraint: str) -> DataFrame:
    bad = df.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))
    return (
        bad.groupBy(*keys).agg(F.count("*").alias("n_rows"))
        .select(F.lit(constraint).alias("constraint"), F.to_json(F.struct(*keys)).alias("key"), "n_rows")
    )


def outside_domain(df: DataFrame, keys: Sequence[str], column: str, domain: Sequence, constraint: str) -> DataFrame:
    """CHECK (column IN domain): a null passes, as in SQL."""
    bad = df.filter(~F.col(column).isin(*domain))
    return (
        bad.groupBy(*keys).agg(F.count("*").alias("n_rows"))
        .select(F.lit(constraint).alias("constraint"), F.to_json(F.struct(*keys)).alias("key"), "n_rows")
    )


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str, constraint: str) -> DataFrame:
    keys = parent.select(F.col(pk).alias("_pk"))
    # Children are counted per key before the join, so a key with very many is one row.
    per_key = child.filter(F.col(fk).isNotNull()).groupBy(fk).agg(F.count("*").alias("n_rows"))
    return (
        per_key.join(keys, F.col(fk) == F.col("_pk"), "left_anti")
        .select(F.lit(constraint).alias("constraint"), F.to_json(F.struct(fk)).alias("key"), "n_rows")
    )


def cascade_delete(child: DataFrame, surviving: DataFrame, fk: str, pk: str) -> DataFrame:
    keys = surviving.select(F.col(pk).alias("_pk"))
    return child.join(keys, F.col(fk) == F.col("_pk"), "left_semi")


def cascade_update(child: DataFrame, renames: DataFrame, fk: str, old: str = "old", new: str = "new") -> DataFrame:
    """Follow changed parent keys. Of several renames of a key the greatest new key counts; children are never multiplied."""
    r = renames.groupBy(F.col(old).alias("_old")).agg(F.max(new).alias("_new"))
    joined = child.join(r, F.col(fk) == F.col("_old"), "left")
    return joined.select(*[F.coalesce("_new", fk).alias(fk) if c == fk else F.col(c) for c in child.columns])
