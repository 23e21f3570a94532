"""From signal samples to segments, and from segments to item features."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vecloom import schemas
from vecloom.operators.aggregates import mean_vector
from vecloom.session import snapshot

# Scalar segment column -> record field.
STAT_SOURCES = {
    "bpm_segments": "bpm",
    "chroma_stft": "chroma_stft",
    "spectral_centroid": "spectral_centroid",
    "spectral_bandwidth": "spectral_bandwidth",
    "rolloff": "rolloff",
    "zero_crossing_rate": "zero_crossing_rate",
    "rms": "rms",
    "onset_env_mean": "onset_env_mean",
    "onset_count": "onset_count",
}

def assign_segments(samples: DataFrame, signal: str, t: str, length: float = 10.0, duration: str | None = None) -> DataFrame:
    """Number samples by fixed-length segment and drop the tail.

    ``t`` is seconds from the start of the signal. A signal shorter than one
    segment forms a single one. Adds ``segment`` and ``n_segments``.
    """
    if duration is None:
        # One row per signal after a map-side combine; joined, not windowed,
        # so a very long signal is not gathered into one task.
        length_of = samples.groupBy(signal).agg(F.max(t).alias("_dur"))
        samples = samples.join(length_of, signal)
    else:
        samples = samples.withColumn("_dur", F.col(duration))
    n_seg = F.greatest(F.lit(1), F.floor(F.col("_dur") / length).cast("int"))
    return (
        samples.withColumn("n_segments", n_seg)
        .withColumn("segment", F.floor(F.col(t) / length).cast("int"))
        .filter(F.col("segment") < F.col("n_segments"))
        .drop("_dur")
    )


def segment_energy(samples: DataFrame, signal: str, segment: str, order: Sequence[str], value: str) -> DataFrame:
    """Samples, RMS and zero-crossing rate (sign changes per sample) per segment.

    Rows are cut into range slices in signal order; sign changes are counted
    inside each slice and then between the ends of neighbouring slices, so a
    segment with very many samples spreads over tasks.
    """
    keys = [signal, segment]
    sliced = (
        samples.select(*keys, *order, F.col(value).alias("_v"), (F.col(value) < 0).cast("int").alias("_neg"))
        .repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id())
    )
    w = Window.partitionBy(*keys, "_slice").orderBy(*order)
    flips = sliced.withColumn("_flip", F.coalesce(F.abs(F.col("_neg") - F.lag("_neg").over(w)), F.lit(0)))
    part = flips.groupBy(*keys, "_slice").agg(
        F.count("*").alias("n"), F.sum(F.col("_v") * F.col("_v")).alias("sq"), F.sum("_flip").alias("flips"),
        F.min_by("_neg", F.struct(*order)).alias("first"), F.max_by("_neg", F.struct(*order)).alias("last"),
    )
    seam = F.coalesce(F.abs(F.col("first") - F.lag("last").over(Window.partitionBy(*keys).orderBy("_slice"))), F.lit(0))
    return part.withColumn("_seam", seam).groupBy(*keys).agg(
        F.sum("n").alias("n_samples"),
        F.sqrt(F.sum("sq") / F.sum("n")).alias("rms"),
        (F.sum(F.col("flips") + F.col("_seam")) / F.sum("n")).alias("zero_crossing_rate"),
    )


def segment_featurize(samples: DataFrame, signal: str, segment: str, value: str, order: str, featurize: Callable, schema: T.StructType = schemas.SEGMENT_FEATURES) -> tuple[DataFrame, DataFrame]:
    """Run a user function on the ordered values of every segment.

    ``featurize(values)`` takes a numpy array and returns a dict of ``schema``
    fields. A segment whose call fails becomes a reject with the message. A
    segment is bounded by its length, so each call sees a bounded group.
    """
    keys = samples.select(signal, segment).schema.fields
    out = T.StructType(keys + schema.fields + [T.StructField("error", T.StringType())])
    names = [f.name for f in schema.fields]

    def measure(key, parts) -> dict:
        row = dict(zip((signal, segment), key), error=None)
        try:
            got = featurize(np.concatenate(parts))
            row.update({n: got.get(n) for n in names})
        except Exception as exc:  # any user failure is data, not a job failure
            row.update(dict.fromkeys(names), error=f"{type(exc).__name__}: {exc}")
        return row

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(out)
        key, parts = None, []
        for b in batches:
            if not b.num_rows:
                continue
            pair = list(zip(b.column(signal).to_pylist(), b.column(segment).to_pylist()))
            values = b.column(value).to_numpy(zero_copy_only=False)
            cuts = [0] + [i for i in range(1, len(pair)) if pair[i] != pair[i - 1]] + [len(pair)]
            done = []
            for start, stop in zip(cuts, cuts[1:]):
                if pair[start] != key:
                    if parts:
                        done.append(measure(key, parts))
                    key, parts = pair[start], []
                parts.append(values[start:stop])
            if done:
                yield pa.RecordBatch.from_pylist(done, wanted)
        if parts:
            yield pa.RecordBatch.from_pylist([measure(key, parts)], wanted)

    # Rows of a segment meet in one task in order; the task reads them as runs,
    # so there is no call overhead per group beyond the user's function.
    rows = samples.select(signal, segment, value, order)
    done = rows.repartition(signal, segment).sortWithinPartitions(signal, segment, order).mapInArrow(run, out)
    # Both results read one stored step: the function runs once for a segment.
    done = snapshot(done, "segments")
    return done.filter(F.col("error").isNull()).drop("error"), done.filter(F.col("error").isNotNull()).select(signal, segment, F.col("error").alias("reason"))


def _stat(column: str):
    """Mean, population std, min, max; a null struct when nothing was kept."""
    stat = F.struct(
        F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max")
    )
    return F.when(F.count(column) > 0, stat)


def segment_stats(segments: DataFrame, item: str, column: str) -> DataFrame:
    return segments.groupBy(item).agg(_stat(column).alias("stat"))


def _moments(column: str):
    """Per-coefficient (mean, population std) from one pass over the arrays."""
    v = array_to_vector(F.col(column))
    summary = Summarizer.metrics("mean", "variance", "count").summary(v)
    n = summary["count"].cast("double")
    pairs = F.arrays_zip(
        vector_to_array(summary["mean"]).alias("mean"),
        F.transform(vector_to_array(summary["variance"]), lambda x: F.sqrt(x * (n - 1) / n)).alias("std"),
    )
    return F.transform(pairs, lambda p: F.struct(p["mean"].alias("mean"), p["std"].alias("std")))


def _dealt(segments: DataFrame, item: str) -> DataFrame:
    """Segments dealt anew by the size of their own rows, not by that of the rows they were made from.

    They are wide, and a task that groups many items sorts them in memory. Those of an item meet, unless they are so many that Spark cuts
    their slice.
    """
    return segments.withColumn("_deal", F.xxhash64(item)).hint("rebalance", "_deal")


def segment_stats_vec(segments: DataFrame, item: str, column: str) -> DataFrame:
    return _dealt(segments.filter(F.col(column).isNotNull()), item).groupBy(item).agg(_moments(column).alias("moments"))


def mean_pool(segments: DataFrame, item: str, column: str, size: int = schemas.EMBEDDING_SIZE, items: DataFrame | None = None) -> DataFrame:
    """Mean embedding per item; zeros for items (of ``items``) with no segment."""
    pooled = _dealt(segments.filter(F.col(column).isNotNull()), item).groupBy(item).agg(mean_vector(column).alias("pooled"))
    every = (items if items is not None else segments).select(item).distinct()
    zeros = F.array_repeat(F.lit(0.0), size)
    return every.join(pooled, item, "left").select(item, F.coalesce("pooled", zeros).alias("pooled"))


def _loudness():
    zero = F.lit(0.0)
    return F.struct(
        F.coalesce(F.avg("loudness_mean"), zero).alias("mean"),
        F.coalesce(F.avg("loudness_std"), zero).alias("std"),
        F.coalesce(F.min("loudness_min"), zero).alias("min"),
        F.coalesce(F.max("loudness_max"), zero).alias("max"),
    )


def loudness_rollup(segments: DataFrame, item: str) -> DataFrame:
    return segments.groupBy(item).agg(_loudness().alias("loudness"))


def song_features(segments: DataFrame, items: DataFrame, item: str, min_rms: float = 0.01, samples: str | None = None, rate: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Nested feature record per item in a single grouped pass.

    ``items`` holds ``(item, duration_sec, segments, global_bpm)``. Items with
    no segment passing the gate come back as rejects.
    """
    keep = F.col("rms") >= min_rms
    if samples:
        keep = keep & (F.col(samples) >= rate)
    grouped = _dealt(segments.filter(keep), item).groupBy(item).agg(
        *[_stat(src).alias(f"f_{name}") for name, src in STAT_SOURCES.items()],
        *[_moments(c).alias(f"f_{c}") for c in schemas.COEFFICIENT_FIELDS],
        _loudness().alias("f_loudness"),
        mean_vector("vggish_emb").alias("f_vggish_emb"),
    )
    joined = items.join(grouped, item, "left")
    fields = []
    for f in schemas.FEATURE_RECORD.fields:
        source = f.name if f.name in schemas.SCALAR_FIELDS else f"f_{f.name}"
        fields.append(F.col(source).cast(f.dataType).alias(f.name))
    kept = joined.filter(F.col("f_rms").isNotNull()).select(item, F.struct(*fields).alias("audio_features"))
    rejects = joined.filter(F.col("f_rms").isNull()).select(item, F.lit("no segment kept").alias("reason"))
    return kept, rejects
