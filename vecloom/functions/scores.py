"""Labels, confidences and information criteria as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from vecloom.functions.vectors import _col


def density_quality(n_clusters, noise_ratio) -> Column:
    k, noise = _col(n_clusters), _col(noise_ratio)
    return (
        F.when((k >= 2) & (noise <= 0.05) & (k <= 10), "EXCELLENT")
        .when((k >= 2) & (noise <= 0.05), "GOOD")
        .when((k >= 2) & (noise <= 0.20), "FAIR")
        .otherwise("POOR")
    )


def balance_quality(silhouette, balance) -> Column:
    s, b = _col(silhouette), _col(balance)
    return (
        F.when((s >= 0.5) & (b >= 0.5), "EXCELLENT")
        .when((s >= 0.3) & (b >= 0.3), "GOOD")
        .when((s >= 0.1) & (b >= 0.1), "FAIR")
        .otherwise("POOR")
    )


def silhouette_quality(silhouette) -> Column:
    s = _col(silhouette)
    return F.when(s > 0.7, "Excellent").when(s > 0.5, "Good").when(s > 0.25, "Fair").otherwise("Poor")


def dbscan_confidence(is_noise, is_core, cluster_size, silhouette) -> Column:
    noise, core = _col(is_noise), _col(is_core)
    size, s = _col(cluster_size), _col(silhouette)
    base = F.when(noise, 0.1).when(core, 0.9).otherwise(0.6)
    by_size = F.when(~noise & (size > 0), 0.7 + 0.3 * F.least(F.lit(1.0), size / 100.0)).otherwise(1.0)
    by_quality = F.when(s > 0, 0.8 + 0.2 * F.least(F.lit(1.0), s * 2)).otherwise(1.0)
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), base * by_size * by_quality))


def dbscan_confidence_fallback(is_noise, is_core) -> Column:
    return F.when(_col(is_noise), 0.1).when(_col(is_core), 0.8).otherwise(0.5)


def hier_confidence(silhouette) -> Column:
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), (_col(silhouette) + 1.0) / 2.0))


def hier_distance(mean_intra) -> Column:
    d = _col(mean_intra)
    return F.when(d > 0, d).otherwise(0.1)


def composite_score(silhouette, balance) -> Column:
    return 0.4 * _col(silhouette) + 0.6 * _col(balance)


def parameter_count(k, dim) -> Column:
    k, d = _col(k).cast("double"), _col(dim).cast("double") if not isinstance(dim, int) else F.lit(float(dim))
    return k * d + F.floor(k * d * (d + 1) / 2) + (k - 1)


def aic(log_likelihood, k, dim) -> Column:
    return 2 * parameter_count(k, dim) - 2 * _col(log_likelihood)


def bic(log_likelihood, k, dim, rows) -> Column:
    log_n = F.lit(math.log(rows)) if isinstance(rows, int) else F.log(_col(rows))
    return log_n * parameter_count(k, dim) - 2 * _col(log_likelihood)


def eps_suggestions(candidates, keep: int = 3, gap: float = 0.1) -> Column:
    """Ascending positive candidates, thinned to gaps over ``gap`` of each value."""
    positive = F.array_sort(F.filter(_col(candidates), lambda x: x > 0))
    thinned = F.aggregate(
        positive,
        F.array().cast("array<double>"),
        lambda acc, x: F.when(
            (F.size(acc) == 0) | (F.abs(x - F.get(acc, F.size(acc) - 1)) > gap * x),
            F.concat(acc, F.array(x)),
        ).otherwise(acc),
    )
    return F.slice(thinned, 1, keep)
