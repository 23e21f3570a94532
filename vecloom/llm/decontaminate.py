"""Benchmark decontamination: MinHash containment search, partitioned by size, and an exact check.

An item of q distinct word shingles is found in a document that holds at least ``need = ceil(threshold * q)`` of them. Items are
partitioned by q (powers of two). An item's sketch is its ``q - need + 1`` least hash values: a document that holds enough of the
item misses at most ``q - need``, so it holds one of these, and no link is lost. A partition's documents need to show only hash
values up to the partition's largest sketch value (about a fifth of them), and only documents with enough shingles for its
smallest item take part. Pairs that share a sketch value are verified on the shingles' text.

Items are dealt into blocks with a fixed bound on their hash values. Each block is broadcast and searched by one pass over the
documents: documents are never shuffled, and neither a block nor a task's memory grows with either table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.text import Words, binary, blocks

SHINGLE, THRESHOLD, BLOCK_VALUES = 5, 0.8, 1 << 20


def shingle_set(text: bytes, size: int = SHINGLE) -> set[bytes]:
    """Distinct shingles as text; fewer words than ``size``: the whole sequence; no words: none."""
    words = text.lower().split()
    if not words:
        return set()
    return {b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))}


class Index:
    """One block of items, ready to be searched."""

    def __init__(self, items: list[tuple[int | None, bytes]], size: int, threshold: float):
        self.items, self.size, self.threshold = [], size, threshold
        partitions: dict[int, list] = {}
        for item_id, text in items:
            shingles = shingle_set(text, size)
            if not shingles:
                continue
            at, q = len(self.items), len(shingles)
            need = max(1, math.ceil(threshold * q - 1e-9))
            self.items.append((item_id, shingles, need))
            values = np.unique(Words([text]).shingles(size)[1])
            # Two shingles of one item with the same hash: one more value is published for each, so nothing is lost.
            sketch = values[:q - need + 1]
            partitions.setdefault(q.bit_length(), []).append((at, need, sketch))
        #: (least shingles of a document, largest value, values, their items)
        self.partitions = []
        for _, found in sorted(partitions.items()):
            values = np.concatenate([s for _, _, s in found])
            owner = np.repeat([at for at, _, _ in found], [len(s) for _, _, s in found])
            order = np.argsort(values, kind="stable")
            self.partitions.append((min(n for _, n, _ in found), values.max(), values[order], owner[order]))

    @classmethod
    def of(cls, state: dict) -> Index:
        """An index from ``vars`` of one, which is what is broadcast: workers need no copy of this module."""
        index = cls.__new__(cls)
        vars(index).update(state)
        return index

    def candidates(self, texts: list[bytes]) -> list[tuple[int, int]]:
        """Pairs of a text and an item that share a sketch value."""
        owner, values = Words(texts).shingles(self.size)
        per_text = np.bincount(owner, minlength=len(texts))
        out = set()
        for least, top, sketch, items in self.partitions:
            take = np.flatnonzero((values <= top) & (per_text[owner] >= least))
            v = values[take]
            lo, hi = np.searchsorted(sketch, v, "left"), np.searchsorted(sketch, v, "right")
            for i in np.flatnonzero(hi > lo):
                out.update((int(owner[take[i]]), int(j)) for j in items[lo[i]:hi[i]])
        return sorted(out)

    def search(self, texts: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """``(text, item, shared)`` of every text that holds enough of an item."""
        last, own = None, set()
        for text, item in self.candidates(texts):
            if text != last:
                last, own = text, shingle_set(texts[text], self.size)
            shared = len(own & self.items[item][1])
            if shared >= self.items[item][2]:
                yield text, item, shared


def indexes(items: DataFrame, item_id: str, text: str, size: int, threshold: float, block_values: int) -> Iterator[Index]:
    """Blocks of items with at most ``block_values`` words each, or a single longer item; the driver holds one block at a time."""
    block, held = [], 0
    for row in items.select(F.col(item_id).cast("long").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")).toLocalIterator():
        raw = row["t"].encode()
        words = len(raw.split())
        if block and held + words > block_values:
            yield Index(block, size, threshold)
            block, held = [], 0
        block.append((row["i"], raw))
        held += words
    if block:
        yield Index(block, size, threshold)


def _matches(index: Index, texts: list[bytes]) -> Iterator[tuple[int, int, int]]:
    at = 0
    for block in blocks(texts, 2 << 20):
        for text, item, shared in index.search(block):
            yield at + text, item, shared
        at += len(block)


LINKS = "doc_id long, item_id long, shared long, item_shingles long, containment double"


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD, block_values: int = BLOCK_VALUES) -> DataFrame:
    """A row per document row and item row it holds: ids, shingles shared, the item's distinct shingles, their ratio.

    Null texts are empty; a text without words holds nothing and, as an item, is in nothing. A text of fewer than ``size`` words is
    one shingle, so a short item is found only in a document that equals it. Repeated rows each give their links, null ids are
    carried on, an empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = spark.createDataFrame([], LINKS)
    for index in indexes(items, item_id, item_text, size, threshold, block_values):
        sent = spark.sparkContext.broadcast(vars(index))

        def run(batches, sent=sent):
            index = Index.of(sent.value)
            for batch in batches:
                ids, rows = batch.column(0), []
                for at, item, shared in _matches(index, binary(batch.column(1))):
                    name, shingles, _ = index.items[item]
                    rows.append((ids[at].as_py(), name, shared, len(shingles), shared / len(shingles)))
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, r)) for r in rows], schema=SCHEMA)

        out = out.union(source.mapInArrow(run, LINKS))
    return out


SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("shared", pa.int64()), ("item_shingles", pa.int64()), ("containment", pa.float64())])


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD, block_values: int = BLOCK_VALUES) -> DataFrame:
    """``docs`` without the rows that hold an item; rows and columns that stay are unchanged. Same rules as ``contamination``."""
    for index in indexes(items, item_id, item_text, size, threshold, block_values):
        sent, at = docs.sparkSession.sparkContext.broadcast(vars(index)), docs.columns.index(text)

        def run(batches, sent=sent, at=at):
            index = Index.of(sent.value)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for row, _, _ in _matches(index, binary(batch.column(at))):
                    clean[row] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
