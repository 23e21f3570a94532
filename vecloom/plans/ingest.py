"""Incremental ingest: from segment rows to stored song and owner vectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom import schemas
from vecloom.functions import vectors as V
from vecloom.operators import aggregates, catalog, filters, segments
from vecloom.sources import sinks


@dataclass
class Ingested:
    rows: DataFrame      # new songs to append
    rejects: DataFrame   # (song_id, reason)
    summary: DataFrame


def ingest(source: DataFrame, done: DataFrame, items: DataFrame, segment_rows: DataFrame, key: str = "song_id", min_rms: float = 0.01, max_seconds: float = 900.0) -> Ingested:
    """Features of the source songs not stored yet.

    ``items`` holds ``(key, duration_sec, segments, global_bpm)`` and
    ``segment_rows`` one row per measured segment.
    """
    todo, _ = catalog.skip_processed(source, done, key)
    ids = todo.select(key)
    short, too_long = filters.max_duration(items.join(ids, key, "left_semi"), "duration_sec", max_seconds)
    wanted = segment_rows.join(short.select(key), key, "left_semi")
    records, silent = segments.song_features(wanted, short, key, min_rms)
    flat = records.select(key, V.flatten_features("audio_features").alias("feature_vector"))
    good, bad = filters.verify_vectors(flat, "feature_vector", schemas.VECTOR_SIZE)
    rejects = catalog.union_results(too_long.select(key, "reason"), silent.select(key, "reason"), bad.select(key, "reason"))
    return Ingested(todo.join(good, key), rejects, catalog.run_summary(source, done, key))


def refresh_owner_vectors(artists: DataFrame, songs: DataFrame, owner: str = "artist_id", min_songs: int = 5, min_valid: int = 5) -> DataFrame:
    """Owner table with mean vectors set for owners with enough valid songs."""
    means = aggregates.artist_mean_vector(songs, owner, "feature_vector", min_songs, min_valid)
    rounded = F.transform("mean_vector", lambda x: F.bround(x, 8))
    return sinks.update_by_key(artists, means.select(owner, rounded.alias("feature_vector")), owner, "feature_vector")
