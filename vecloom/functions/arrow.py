"""Arrow batches to numpy matrices and back, used inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

#: Numbers of a working matrix that fit a processor's cache.
CACHED = 1 << 15
#: Pairs formed one by one at a time; where more than one pair of ``FEW`` is wanted, the product of all is cheaper.
LISTED, FEW = 1 << 16, 64


def matrix(column) -> np.ndarray:
    """List column of equal-length vectors as an ``(rows, dim)`` matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(rows, -1) if rows else flat.reshape(0, 0)


def vectors(mat: np.ndarray) -> pa.ListArray:
    rows, dim = mat.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * dim)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(mat, dtype=np.float64).ravel()))


def packed(mat: np.ndarray) -> bytes:
    """A matrix row by row, after eight bytes that tell the width of a number: single precision where that loses nothing."""
    with np.errstate(over="ignore", invalid="ignore"):
        single = np.ascontiguousarray(mat, "<f4")
    if np.array_equal(single, mat):
        return np.int64(4).tobytes() + single.tobytes()
    return np.int64(8).tobytes() + np.ascontiguousarray(mat, "<f8").tobytes()


def unpacked(mat: bytes, rows: int) -> np.ndarray:
    width = int(np.frombuffer(mat, "<i8", 1)[0])
    return np.frombuffer(mat, f"<f{width}", offset=8).reshape(rows, -1).astype(np.float64, copy=False)


def distances(a: np.ndarray, b: np.ndarray, metric: str = "euclidean", radii: Sequence[float] = ()) -> np.ndarray:
    """Distance of every row of ``a`` to every row of ``b``.

    Pairs next to one of ``radii`` are formed from the differences, so that
    being within a radius doesn't depend on the rounding of a product.
    """
    if metric == "manhattan":
        out, columns = np.zeros((len(a), len(b))), np.ascontiguousarray(b.T)
        # A few rows at a time, so that sums and differences stay in the processor's cache.
        step = max(1, CACHED // max(1, len(b)))
        for at in range(0, len(a), step):
            part = out[at:at + step]
            gap = np.empty_like(part)
            for d in range(a.shape[1]):
                np.subtract(a[at:at + step, d, None], columns[d], out=gap)
                part += np.abs(gap, out=gap)
        return out
    if metric == "cosine":
        ua, ub = unit(a), unit(b)
        out = 1.0 - ua @ ub.T
        redo = np.zeros(out.shape, bool)
        for r in radii:
            redo |= np.abs(out - r) <= 1e-12
        i, j = np.nonzero(redo)
        for at in range(0, len(i), 65536):
            k, m = i[at:at + 65536], j[at:at + 65536]
            out[k, m] = 1.0 - (ua[k] * ub[m]).sum(axis=1)
        return out
    if metric != "euclidean":
        raise ValueError(f"unknown metric {metric!r}")
    na, nb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    out = a @ b.T
    step = max(1, 2 * CACHED // max(1, len(b)))
    least = 1e-7 * (na.max(initial=0.0) + nb.max(initial=0.0))
    for first in range(0, len(a), step):
        part = out[first:first + step]
        part *= -2.0
        part += na[first:first + step, None]
        part += nb[None, :]
        np.maximum(part, 0.0, out=part)
        if not radii and part.min(initial=np.inf) > least:
            np.sqrt(part, out=part)
            continue
        scale = na[first:first + step, None] + nb[None, :]
        # The product form loses digits for near-equal rows: redo those directly.
        redo = part <= 1e-7 * scale
        for r in radii:
            redo |= np.abs(part - r * r) <= 1e-9 * (scale + r * r)
        close_i, close_j = np.nonzero(redo)
        for at in range(0, len(close_i), 65536):
            i, j = close_i[at:at + 65536], close_j[at:at + 65536]
            gap = a[first + i] - b[j]
            part[i, j] = np.einsum("ij,ij->i", gap, gap)
        np.sqrt(part, out=part)
    return out


def rough(a: np.ndarray, b: np.ndarray, metric: str = "euclidean") -> tuple[np.ndarray, float]:
    """All distances in single precision, and how far they may be off; euclidean ones are squared.

    Single precision halves the time of the product and of what follows. Rows are taken from their middle, which the distance doesn't
    see. Numbers that single precision doesn't hold keep double precision.
    """
    if metric == "manhattan":
        return distances(a, b, metric), 0.0
    if metric == "cosine":
        a, b = unit(a), unit(b)
    else:
        middle = a.mean(axis=0)
        if np.isfinite(middle).all():
            a, b = a - middle, b - middle
    na, nb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    most = sum(float(np.max(n, where=np.isfinite(n), initial=0.0)) for n in (na, nb))
    kind, digits = ("f4", 23) if most < 1e30 else ("f8", 52)
    off = (a.shape[1] + 16) * 2.0 ** -digits * most + 1e-37
    if metric == "cosine":
        out = a.astype(kind) @ b.astype(kind).T
        return np.subtract(1.0, out, out=out), off
    one = np.ones
    left, right = np.hstack([-2.0 * a, na[:, None], one((len(a), 1))]), np.hstack([b, one((len(b), 1)), nb[:, None]])
    return left.astype(kind) @ right.astype(kind).T, off


def listed(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """Distances of the rows ``i`` of ``a`` to the rows ``j`` of ``b``, each from the differences."""
    if metric == "cosine":
        a, b = unit(a), unit(b)
    out = np.empty(len(i))
    for at in range(0, len(i), LISTED):
        x, y = a[i[at:at + LISTED]], b[j[at:at + LISTED]]
        if metric == "cosine":
            out[at:at + LISTED] = 1.0 - (x * y).sum(axis=1)
        elif metric == "manhattan":
            out[at:at + LISTED] = np.abs(x - y).sum(axis=1)
        else:
            x -= y
            out[at:at + LISTED] = np.sqrt(np.einsum("ij,ij->i", x, x))
    return out


def within(a: np.ndarray, b: np.ndarray, metric: str, radii: Sequence[float]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(i, j, distance)`` of all pairs within the largest of ``radii``, in parts; next to a radius as ``distances`` tells them.

    Single precision finds what may be near, and only that is formed exactly; where much is near, some rows at a time meet all.
    """
    radius = max(radii)
    far, off = rough(a, b, metric)
    hit = np.flatnonzero(far <= (radius * radius if metric == "euclidean" else radius) + off)
    if metric != "manhattan" and len(hit) <= far.size // FEW:
        i, j = np.divmod(hit, len(b))
        d = listed(a, b, i, j, metric)
        keep = d <= radius
        yield i[keep], j[keep], d[keep]
        return
    del hit
    step = max(1, (LISTED << 3) // max(1, len(b)))
    for at in range(0, len(a), step):
        d = far[at:at + step] if metric == "manhattan" else distances(a[at:at + step], b, metric, radii)
        i, j = np.nonzero(d <= radius)
        yield i + at, j, d[i, j]


def unit(a: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.einsum("ij,ij->i", a, a))
    return a / np.where(norm > 0, norm, 1.0)[:, None]
