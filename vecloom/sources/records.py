"""Readers of stored JSON: nested feature files and playlist pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom import schemas
from vecloom.functions.metadata import track_fields


def read_features_json(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Feature files: an array of records per file, or one record per line.

    Line-separated files split across tasks; array files are one task per file.
    """
    return spark.read.schema(schemas.FEATURE_FILE).json(path, multiLine=multiline)


def read_playlist_pages(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    return spark.read.schema(schemas.PLAYLIST_PAGE).json(path, multiLine=multiline)


def valid_tracks(tracks: DataFrame, track: str = "track") -> DataFrame:
    """Keep tracks whose record, name and id are all present and non-empty."""
    t = F.col(track)
    return tracks.filter(t.isNotNull() & (F.length(t["name"]) > 0) & (F.length(t["id"]) > 0))


def playlist_items(pages: DataFrame) -> DataFrame:
    """Stored pages to one row per kept track, in page and item order."""
    items = pages.select("playlist_id", "offset", F.posexplode("items").alias("pos", "item"))
    tracks = items.select("playlist_id", (F.col("offset") + F.col("pos")).alias("position"), F.col("item.track").alias("track"))
    return valid_tracks(tracks).select("playlist_id", "position", *track_fields("track"))
