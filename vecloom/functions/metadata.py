"""Expressions that read stored track and artist records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vecloom.functions.vectors import _col

# Fixed values.
UNKNOWN_ID = "unknown"
UNKNOWN_NAME = "Unknown Artist"

ARTIST_REF = "struct<id:string,name:string>"
SONG_RECORD = (
    f"struct<name:string,artists:array<{ARTIST_REF}>,explicit:boolean,"
    "popularity:int,duration_ms:int,album:string>"
)
ARTIST_RECORD = (
    "struct<name:string,followers:struct<total:int>,genres:array<string>,"
    "images:array<struct<url:string,height:int,width:int>>,popularity:int>"
)


def playlist_id(url, pattern: str) -> Column:
    """First capture of ``pattern`` in the URL, null when it does not match."""
    url = _col(url)
    return F.when(F.regexp_like(url, F.lit(pattern)), F.regexp_extract(url, pattern, 1))


def track_fields(track) -> list[Column]:
    t = _col(track)
    has_artist = F.size(F.coalesce(t["artists"], F.array())) > 0
    first = F.get(t["artists"], F.lit(0))
    return [
        t["id"].alias("song_id"),
        F.when(has_artist, first["id"]).otherwise(UNKNOWN_ID).alias("artist_id"),
        t["name"].alias("song_name"),
        F.when(has_artist, first["name"]).otherwise(UNKNOWN_NAME).alias("artist_name"),
    ]


def song_metadata(text) -> list[Column]:
    r = F.from_json(_col(text), SONG_RECORD)
    others = F.slice(r["artists"], 2, F.greatest(F.size(r["artists"]) - 1, F.lit(0)))
    return [
        r["name"].alias("song_name"),
        F.get(r["artists"], F.lit(0))["name"].alias("artist_name"),
        F.when(F.size(r["artists"]) > 1, F.to_json(others)).alias("sub_artists"),
        r["explicit"].alias("explicit"),
        r["popularity"].alias("popularity"),
        r["duration_ms"].alias("duration_ms"),
        r["album"].alias("album"),
    ]


def artist_metadata(text) -> list[Column]:
    r = F.from_json(_col(text), ARTIST_RECORD)
    return [
        r["name"].alias("artist_name"),
        r["followers"]["total"].alias("followers"),
        F.when(F.size(r["genres"]) > 0, F.to_json(r["genres"])).alias("genres"),
        F.when(F.size(r["images"]) > 0, F.to_json(r["images"])).alias("images"),
        r["popularity"].alias("popularity"),
    ]


def coalesce_fill(old, new) -> Column:
    return F.coalesce(_col(old), _col(new))


def blank_fill(old, new, blanks: tuple = ()) -> Column:
    """``new`` where ``old`` is null or one of ``blanks``; never loses a value."""
    old, new = _col(old), _col(new)
    empty = old.isNull()
    for b in blanks:
        empty = empty | (old == F.lit(b))
    return F.coalesce(F.when(empty, new).otherwise(old), new)
