"""From stored songs to the reduced matrix that the algorithms share."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.functions import vectors as V
from vecloom.operators import aggregates, filters, matrix
from vecloom.session import snapshot


@dataclass
class Prepared:
    df: DataFrame          # verified rows with the column ``reduced``
    rejects: DataFrame     # rows dropped, with ``reason``
    quality: DataFrame
    groups: DataFrame
    low_variance: DataFrame
    components: np.ndarray
    explained: list


def prepare(songs: DataFrame, vector: str = "feature_vector", groups: dict = V.GROUPS_223, dim: int = 223, method: str = "robust", k: int | None = None) -> Prepared:
    """Verify, report, preprocess and project; text vectors are parsed first."""
    if songs.schema[vector].dataType.simpleString() == "string":
        songs = songs.withColumn(vector, V.parse_vector(vector, "verified", dim))
    else:
        songs = songs.withColumn(vector, V.as_vector(vector))
    good, rejects = filters.verify_vectors(songs, vector, dim)
    good = snapshot(good, "verified")
    scaled = snapshot(matrix.preprocess(good.withColumn("scaled", F.col(vector)), "scaled", groups, dim, method), "scaled")
    reduced, load, explained = matrix.pca(scaled, "scaled", k)
    return Prepared(
        df=reduced, rejects=rejects, quality=aggregates.data_quality(good, vector),
        groups=aggregates.group_stats(good, vector, groups), low_variance=aggregates.low_variance(good, vector),
        components=load, explained=explained,
    )
