"""Table and record schemas of the catalogue."""

from __future__ import annotations

from pyspark.sql import types as T

VECTOR = T.ArrayType(T.DoubleType())

STAT = T.StructType([T.StructField(n, T.DoubleType()) for n in ("mean", "std", "min", "max")])
MOMENT = T.StructType([T.StructField(n, T.DoubleType()) for n in ("mean", "std")])

# Record field names, in the order in which they are flattened.
SCALAR_FIELDS = ("duration_sec", "segments", "global_bpm")
STAT_FIELDS_HEAD = (
    "bpm_segments", "chroma_stft", "spectral_centroid", "spectral_bandwidth",
    "rolloff", "zero_crossing_rate", "rms",
)
COEFFICIENT_FIELDS = ("mfcc_mean", "mfcc_std")
STAT_FIELDS_TAIL = ("onset_env_mean", "onset_count", "loudness")
EMBEDDING_FIELD = "vggish_emb"
N_COEFFICIENTS = 13
EMBEDDING_SIZE = 128
VECTOR_SIZE = 223

FEATURE_RECORD = T.StructType(
    [
        T.StructField("duration_sec", T.DoubleType()),
        T.StructField("segments", T.IntegerType()),
        T.StructField("global_bpm", T.DoubleType()),
        *[T.StructField(n, STAT) for n in STAT_FIELDS_HEAD],
        *[T.StructField(n, T.ArrayType(MOMENT)) for n in COEFFICIENT_FIELDS],
        *[T.StructField(n, STAT) for n in STAT_FIELDS_TAIL],
        T.StructField(EMBEDDING_FIELD, VECTOR),
    ]
)

FEATURE_FILE = T.StructType(
    [
        T.StructField("song", T.StringType()),
        T.StructField("artist", T.StringType()),
        T.StructField("audio_features", FEATURE_RECORD),
    ]
)

SEGMENT_SCALARS = (
    "bpm", "chroma_stft", "spectral_centroid", "spectral_bandwidth", "rolloff",
    "zero_crossing_rate", "rms", "onset_env_mean", "onset_count",
    "loudness_mean", "loudness_std", "loudness_max", "loudness_min",
)
SEGMENT_FEATURES = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in SEGMENT_SCALARS]
    + [
        T.StructField("mfcc_mean", VECTOR),
        T.StructField("mfcc_std", VECTOR),
        T.StructField("vggish_emb", VECTOR),
    ]
)

SITE_DATA = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("data", T.StringType(), False),
        T.StructField("created_at", T.TimestampType()),
    ]
)

PLAYLIST_SONGS = T.StructType(
    [T.StructField(n, T.StringType(), False) for n in ("song_id", "artist_id", "song_name", "artist_name")]
)

ARTISTS = T.StructType(
    [
        T.StructField("artist_id", T.StringType(), False),
        T.StructField("feature_vector", VECTOR),
        T.StructField("song_count", T.IntegerType()),
        T.StructField("artist_name", T.StringType()),
        T.StructField("followers", T.IntegerType()),
        T.StructField("genres", T.StringType()),
        T.StructField("images", T.StringType()),
        T.StructField("popularity", T.IntegerType()),
    ]
)

SONGS = T.StructType(
    [
        T.StructField("song_id", T.StringType(), False),
        T.StructField("artist_id", T.StringType(), False),
        T.StructField("feature_vector", VECTOR),
        T.StructField("song_name", T.StringType()),
        T.StructField("artist_name", T.StringType()),
        T.StructField("explicit", T.BooleanType()),
        T.StructField("popularity", T.IntegerType()),
        T.StructField("duration_ms", T.IntegerType()),
        T.StructField("sub_artists", T.StringType()),
        T.StructField("album", T.StringType()),
    ]
)

ALGORITHMS = ("kmeans", "gmm", "hierarchical", "dbscan")

# Columns that an upsert takes from the incoming row, in table order.
CLUSTER_RESULT_COLUMNS = {
    "kmeans_cluster_id": "int",
    "kmeans_distance": "double",
    "gmm_cluster_id": "int",
    "gmm_probabilities": "string",
    "hier_level1_id": "int",
    "hier_level2_id": "int",
    "hier_distance": "double",
    "dbscan_cluster_id": "int",
    "dbscan_is_core": "boolean",
    "is_noise_point": "boolean",
    "eps": "double",
    "min_samples": "int",
    "dbscan_cluster_size": "bigint",
    "dbscan_silhouette_score": "double",
    "dbscan_n_clusters": "bigint",
    "dbscan_n_noise": "bigint",
    "confidence": "double",
}
# Columns that only the evaluation step writes; an upsert keeps them.
CLUSTER_METRIC_COLUMNS = {
    "kmeans_cluster_size": "bigint",
    "kmeans_silhouette_score": "double",
    "gmm_cluster_size": "bigint",
    "gmm_silhouette_score": "double",
    "hier_silhouette_score": "double",
    "hier_balance_score": "double",
    "created_at": "timestamp",
}

TRACK = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField(
            "artists",
            T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType())])),
        ),
    ]
)
PLAYLIST_PAGE = T.StructType(
    [
        T.StructField("playlist_id", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("items", T.ArrayType(T.StructType([T.StructField("track", TRACK)]))),
    ]
)
