"""Column expressions on ``array<double>`` vectors. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from vecloom import schemas

# Half-open slices and weights of the feature groups.
GROUPS_223 = {
    "vggish": (95, 223, 1.2),
    "mfcc": (31, 83, 1.05),
    "spectral": (11, 31, 0.85),
    "rhythmic": (3, 11, 1.1),
}
GROUPS_64 = {
    "vggish": (32, 64, 1.2),
    "mfcc": (16, 32, 1.05),
    "spectral": (8, 16, 0.85),
    "rhythmic": (2, 8, 1.1),
}
DAMPING = 0.1
CLIP = 10.0


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_vector(c) -> Column:
    return _col(c).cast("array<double>")


def literal_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def is_finite(v: Column) -> Column:
    """True when no element is null, NaN or infinite."""
    return ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def parse_vector(c, mode: str = "strict", dim: int = schemas.VECTOR_SIZE) -> Column:
    """Text to ``array<double>``, null when the contract of ``mode`` rejects it.

    strict    JSON list of exactly ``dim`` items; NaN and infinities pass, a null item is NaN
    verified  comma list with or without brackets, or space list; exactly
              ``dim`` finite items
    loose     comma list, blank items ignored, any length
    """
    c = _col(c)
    if mode == "strict":
        v = F.from_json(c, "array<double>")
        return F.when(F.size(v) == dim, F.transform(v, lambda x: F.coalesce(x, F.lit(float("nan")))))
    body = F.regexp_replace(F.trim(c), r"(?s)^\[(.*)\]$", "$1")
    by_comma = F.filter(F.split(body, ","), lambda s: F.length(F.trim(s)) > 0)
    if mode == "verified":
        by_space = F.filter(F.split(F.trim(body), r"\s+"), lambda s: F.length(s) > 0)
        items = F.when(F.contains(body, F.lit(",")), by_comma).otherwise(by_space)
    elif mode == "loose":
        items = by_comma
    else:
        raise ValueError(f"unknown mode {mode!r}")
    v = F.transform(items, lambda s: F.trim(s).try_cast("double"))
    parsed = F.when(~F.exists(v, lambda x: x.isNull()), v)
    if mode == "verified":
        return F.when((F.size(parsed) == dim) & is_finite(parsed), parsed)
    return parsed


def vector_to_json(c, places: int | None = 8) -> Column:
    c = _col(c)
    return F.to_json(c if places is None else F.transform(c, lambda x: F.bround(x, places)))


def clean_vector(c, dim: int = schemas.VECTOR_SIZE) -> Column:
    """Non-finite items become 0; then zero-pad or truncate to ``dim``."""
    safe = F.transform(
        _col(c),
        lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x),
    )
    return F.slice(F.concat(safe, F.array_repeat(F.lit(0.0), dim)), 1, dim)


def group_weights(groups: dict, dim: int) -> list[float]:
    """Effective multiplier per position: ``1 + 0.1 * (weight - 1)``."""
    out = [1.0] * dim
    for start, stop, weight in groups.values():
        for i in range(start, stop):
            out[i] = 1.0 + DAMPING * (weight - 1.0)
    return out


def apply_group_weights(c, groups: dict, dim: int) -> Column:
    return F.zip_with(_col(c), literal_vector(group_weights(groups, dim)), lambda x, w: x * w)


def clip(c, bound: float = CLIP) -> Column:
    return F.transform(_col(c), lambda x: F.greatest(F.lit(-bound), F.least(F.lit(bound), x)))


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    return _total(F.zip_with(_col(a), _col(b), lambda x, y: x * y))


def distance(a, b, metric: str = "euclidean") -> Column:
    a, b = _col(a), _col(b)
    if metric == "euclidean":
        return F.sqrt(_total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))
    if metric == "manhattan":
        return _total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    if metric == "cosine":
        # A vector without length has distance 1 to every other.
        norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
        return F.when(norms == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.try_divide(dot(a, b), norms))
    raise ValueError(f"unknown metric {metric!r}")


def _stat(c: Column) -> list[Column]:
    return [c[n] for n in ("mean", "std", "min", "max")]


def flatten_features(record) -> Column:
    """Nested feature record to one flat vector in the fixed field order.

    Null when any part is missing, so that an incomplete record is rejected
    instead of yielding a shorter vector.
    """
    r = _col(record)
    head = [r[n].cast("double") for n in schemas.SCALAR_FIELDS]
    for name in schemas.STAT_FIELDS_HEAD:
        head += _stat(r[name])
    tail = []
    for name in schemas.STAT_FIELDS_TAIL:
        tail += _stat(r[name])
    pairs = [F.flatten(F.transform(r[n], lambda m: F.array(m["mean"], m["std"]))) for n in schemas.COEFFICIENT_FIELDS]
    flat = F.concat(F.array(*head), *pairs, F.array(*tail), r[schemas.EMBEDDING_FIELD])
    return F.when(~F.exists(flat, lambda x: x.isNull()), flat)
