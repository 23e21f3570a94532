"""Means of owners' vectors that new songs move, without the old songs being read again.

The state has one row per owner: songs, songs with a valid vector, and the element-wise sum of the valid vectors. States of disjoint sets
of songs add up. It is kept in buckets of the owner, so an update reads the new songs and the buckets of their owners.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.operators.aggregates import sum_vector
from vecloom.sources import buckets as B


def mean_state(songs: DataFrame, owner: str = "artist_id", vector: str = "feature_vector") -> DataFrame:
    """``(owner, song_count, n_valid, total)``; ``total`` is null for an owner without a valid vector. Vectors have one length."""
    counts = songs.groupBy(owner).agg(F.count("*").alias("song_count"), F.count(vector).alias("n_valid"))
    totals = songs.where(F.col(vector).isNotNull()).groupBy(F.col(owner).alias("_owner")).agg(sum_vector(vector).alias("total"))
    return counts.join(totals, F.col(owner).eqNullSafe(F.col("_owner")), "left").drop("_owner")


def add_states(a: DataFrame, b: DataFrame, owner: str = "artist_id") -> DataFrame:
    """The state of both sets of songs; each has one row per owner at most, so no group has more than two rows."""
    both = a.unionByName(b.select(*a.columns))
    plus = F.aggregate(
        F.filter(F.collect_list("total"), lambda x: x.isNotNull()), F.lit(None).cast("array<double>"),
        lambda s, x: F.when(s.isNull(), x).otherwise(F.zip_with(s, x, lambda p, q: p + q)),
    )
    return both.groupBy(owner).agg(F.sum("song_count").alias("song_count"), F.sum("n_valid").alias("n_valid"), plus.alias("total")).select(*a.columns)


def start(songs: DataFrame, path: str, owner: str = "artist_id", vector: str = "feature_vector", buckets: int = B.BUCKETS) -> DataFrame:
    """Store the state of ``songs`` at ``path``."""
    return B.create(mean_state(songs, owner, vector), path, B.bucket_of([owner], buckets))


def advance(state: DataFrame, path: str, songs: DataFrame, owner: str = "artist_id", vector: str = "feature_vector", buckets: int = B.BUCKETS) -> DataFrame:
    """Add new ``songs`` to the state at ``path`` and return it. Songs must be new: one that is given twice counts twice."""
    B.change(state, path, mean_state(songs, owner, vector), B.bucket_of([owner], buckets), lambda old, new: add_states(old, new, owner))
    return B.read(state.sparkSession, path, state)


def running_mean(state: DataFrame, owner: str = "artist_id", min_songs: int = 5, min_valid: int = 5) -> DataFrame:
    """``(owner, song_count, n_valid, mean_vector)`` of the owners with enough songs, as ``artist_mean_vector`` has them."""
    enough = state.where((F.col("song_count") >= min_songs) & (F.col("n_valid") >= max(min_valid, 1)))
    return enough.select(owner, "song_count", "n_valid", F.transform("total", lambda x: x / F.col("n_valid")).alias("mean_vector"))
