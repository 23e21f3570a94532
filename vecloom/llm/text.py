"""Words and blocks of texts as the operators of this folder see them.

A word is a run of bytes other than the six ASCII white-space characters (0x20, 0x09-0x0D); ``bytes.split()`` cuts at exactly
these, and ``bytes.lower()`` changes A-Z alone. A null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

WORD = r"[^\x20\x09-\x0D]+"


def as_bytes(text: str) -> Column:
    """The text as UTF-8 bytes, null as empty: kernels need no decoding."""
    return F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def blocks(items: Iterable[bytes], most: int = 8 << 20) -> Iterator[list[bytes]]:
    """Consecutive items, each block of about ``most`` bytes, so that a batch of long texts doesn't fill a worker."""
    block, held = [], 0
    for item in items:
        block.append(item)
        held += len(item)
        if held >= most:
            yield block
            block, held = [], 0
    if block:
        yield block


def items(column: pa.Array) -> Iterator[bytes]:
    """The texts of a binary column of an Arrow batch; few of them are Python objects at a time."""
    for at in range(0, len(column), 256):
        for x in column.slice(at, 256).to_pylist():
            yield x or b""


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_PIECE = 1 << 20


def _run_of(base: int, n: int) -> np.ndarray:
    """1, base, base ** 2 ... modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _run_of(_BASE, n), _run_of(_INVERSE, n)


def _mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits, one to one."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def slice_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each slice of bytes, the slices in order and apart: equal for equal ones; unequal ones meet with a chance of about 2 ** -64."""
    out = np.empty(len(starts), np.uint64)
    # Bytes that one piece spans at most: the piece's size, the buffer's, or that of a longer slice.
    widest = max(int((ends - starts).max(initial=0)), min(_PIECE, len(flat))) + 1
    powers, inverse = _powers(_PIECE + 2) if widest <= _PIECE + 2 else (_run_of(_BASE, widest), _run_of(_INVERSE, widest))
    i = 0
    while i < len(starts):
        start = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, start + _PIECE, "right")))
        lo, hi, n = starts[i:j] - start, ends[i:j] - start, int(ends[j - 1]) - start
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((flat[start:start + n].astype(np.uint64) + np.uint64(1)) * powers[:n], out=total[1:])
        out[i:j] = (total[hi] - total[lo]) * inverse[lo] + (hi - lo).astype(np.uint64)
        i = j
    return _mix(out)


class Words:
    """The words of a block of texts, A-Z lowered: their places in one buffer, and a 64-bit hash of each."""

    def __init__(self, texts: list[bytes]):
        self.buffer = b"\n".join(texts).lower()
        self.bytes = np.frombuffer(self.buffer, np.uint8)
        space = np.concatenate(([True], _SPACE[self.bytes], [True]))
        edge = np.flatnonzero(space[1:] != space[:-1])
        self.starts, self.ends = edge[0::2], edge[1::2]
        at = np.cumsum([0] + [len(t) + 1 for t in texts])
        #: Words of text i: first[i] to first[i + 1].
        self.first = np.searchsorted(self.starts, at)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        return slice_hashes(self.bytes, self.starts, self.ends)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """``(owner, hash)`` of every run of ``size`` words in a text; a shorter text's whole sequence is its only one, no words: none."""
        words, owner, counts = self.hashes(), self.owner(), self.counts()
        total = np.zeros(len(words), np.uint64)
        for j in range(size):
            term = np.zeros(len(words), np.uint64)
            term[:max(0, len(words) - j)] = words[j:]
            if j:
                inside = np.zeros(len(words), bool)
                inside[:max(0, len(words) - j)] = owner[j:] == owner[:max(0, len(words) - j)]
                term[~inside] = np.uint64(j)
            total = _mix(total + term)
        rank = np.arange(len(words)) - self.first[owner]
        whole = rank + size <= counts[owner]
        keep = whole | ((rank == 0) & (counts[owner] < size))
        return owner[keep], total[keep]


def kept(box: dict, name: str, make: Callable[[], object]):
    """``box[name]``, made where it is missing. With a broadcast dictionary that is once for a worker process and not for a task:
    what is made stays beside the value while the worker lives, so it must be bounded and the same for every task."""
    if name not in box:
        box[name] = make()
    return box[name]


def binary(column: pa.Array) -> list[bytes]:
    """A text column of an Arrow batch as UTF-8 bytes, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def extended(schema: StructType, **more: str) -> StructType:
    """A new schema with further columns, each by its type's name."""
    return StructType([*schema.fields, *StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in more.items())).fields])
