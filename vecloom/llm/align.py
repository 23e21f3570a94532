"""Alignment of two tokenizers' ids over the same texts.

Both tokenizers encode the whole text. A place where tokens of both end, and the next token begins with a space, is an anchor; anchors
split a document into windows of token ids, most of them one word. Windows that repeat have the same alignment, so it is worked out
once for each pair of id tuples that is held. Inside a window the places where tokens of both end cut it into groups, and the tokens of
a group are linked.

How many documents hold a linked pair of ids is counted over the whole corpus. The documents then look their pairs up in two ways: the
pairs that most documents hold, a fixed number of them, are broadcast; the others go through a join on the pair, in which no pair is
frequent.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vecloom.llm.subwords import BYTES, Encoder, Held, distinct, gather
from vecloom.llm.text import as_bytes, blocks, items, kept
from vecloom.session import discard, scratch_path

#: Linked pairs that are broadcast; windows that are held at once; bytes of text handled at once.
FREQUENT, HELD, BLOCK = 1 << 18, 100_000, 1 << 20
#: What marks a space in a sentencepiece model.
MARK = "▁"
ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, a array<int>, b array<int>, times array<long>"


def specs(byte_level: str, pieces: str) -> dict:
    """What the operator takes: a byte-level tokenizer's file as text and a sentencepiece model as bytes, so that executors need no copy."""
    with open(byte_level, encoding="utf-8") as a, open(pieces, "rb") as b:
        return {"a": a.read(), "b": b.read()}


class Tokens:
    """``tokens``: the bytes of each id."""

    tokens: list[bytes]

    def bytes_of(self, ids: list[np.ndarray]) -> list[bytes]:
        """What the ids of each text stand for."""
        if not hasattr(self, "flat"):
            self.flat, self.sizes = np.frombuffer(b"".join(self.tokens), np.uint8), np.array([len(t) for t in self.tokens], np.int64)
            self.starts = np.cumsum(self.sizes) - self.sizes
        joined = np.concatenate(ids).astype(np.int64)
        raw = gather(self.flat, self.starts[joined], self.sizes[joined]).tobytes()
        ends = np.concatenate(([0], np.cumsum(self.sizes[joined])))[np.cumsum([0] + [len(x) for x in ids])].tolist()
        return [raw[x:y] for x, y in zip(ends, ends[1:])]


class ByteTokens(Tokens):
    """Ids of texts by a byte-level tokenizer, special strings being ordinary text, and each id's bytes."""

    def __init__(self, spec: str, most: int = 250_000):
        self.encoder = Encoder(spec, most, plain_specials=True)
        back = {c: b for b, c in BYTES.items()}
        name = self.encoder.tokenizer.id_to_token
        read = lambda t: bytes(back.get(c, ord(c) & 255) for c in t)
        self.tokens = [read(name(i) or "") for i in range(self.encoder.tokenizer.get_vocab_size())]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        return self.encoder.encode_bytes(texts)


class PieceTokens(Tokens):
    """Ids of texts by a sentencepiece model, and each id's bytes: the mark is a space, a byte piece its byte.

    Where the model keeps spaces and has the mark only in front of its pieces, no piece reaches over the start of a word, so words are
    encoded apart, each once while it is held. Another model encodes whole texts.
    """

    def __init__(self, model: bytes, most: int = 250_000):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.tokens = [bytes([int(n[1:-1], 16)]) if self.model.is_byte(i) else n.replace(MARK, " ").encode() for i, n in enumerate(names)]
        kept_spaces = "".join(self.model.encode("  x  x ", out_type=str)) == MARK * 3 + "x" + MARK * 2 + "x" + MARK
        self.pieces = Held(self._encode, most) if kept_spaces and not any(MARK in n.lstrip(MARK) for n in names) else None

    def _encode(self, flat: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every unit starts with a space, which the model puts there by itself."""
        buffer = flat.tobytes()
        found = self.model.encode([buffer[a + 1:b].decode(errors="replace") for a, b in zip(edges.tolist(), edges[1:].tolist())], num_threads=1)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), np.int32, int(lengths.sum())), lengths

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """``texts`` with a space in front, as ``ByteTokens`` gets them."""
        if self.pieces is None:
            return [np.array(x, np.int32) for x in self.model.encode([t[1:].decode(errors="replace") for t in texts], num_threads=1)]
        buffer, ends = b"".join(texts), np.cumsum([0] + [len(t) for t in texts])
        flat = np.frombuffer(buffer, np.uint8)
        space, cut = flat == 0x20, np.zeros(len(flat) + 1, bool)
        cut[1:-1] = space[1:] & ~space[:-1]
        for i, t in enumerate(texts):
            # Spaces that end a text belong to the word before them.
            if t.endswith(b" "):
                cut[ends[i] + len(t.rstrip(b" "))] = False
        cut[ends] = True
        at = np.flatnonzero(cut)
        where = self.pieces.places(flat, at)
        at = np.concatenate(([0], np.cumsum(self.pieces.lengths[where])))[np.searchsorted(at[:-1], ends)]
        ids = self.pieces.ids(where)
        return [ids[x:y] for x, y in zip(at.tolist(), at[1:].tolist())]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers ``starts[i]`` to ``starts[i] + sizes[i]`` of each i, one range after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class Windows:
    """Alignments of windows, each worked out once while it is held: its groups as text, its linked pairs and how often each is linked.

    Beyond ``most`` windows all go: those that are frequent are soon back.
    """

    def __init__(self, a: ByteTokens, b: PieceTokens, most: int = HELD):
        self.a, self.b, self.most = a, b, most
        self.len_a, self.len_b = (np.array([len(t) for t in x.tokens], np.int64) for x in (a, b))
        self.space = np.array([t[:1] == b" " for t in a.tokens])
        # An id as it stands inside a side of a group, at the first side's end, at the second's.
        self.written = [f"{i}{mark}" for i in range(max(len(a.tokens), len(b.tokens))) for mark in ",|;"]
        self._clear()

    def _clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.texts: list[str] = []
        self.pair: dict[int, int] = {}
        self.flat, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.starts, self.lengths, self.groups, self.links = (np.zeros(0, np.int64) for _ in range(4))

    def _add(self, flat_a: np.ndarray, flat_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> None:
        """Align windows that stand behind one another: ids of both, and how many each window has."""
        n, ends_a, ends_b = len(size_a), np.cumsum(self.len_a[flat_a]), np.cumsum(self.len_b[flat_b])
        place = np.searchsorted(ends_b, ends_a)
        meet = np.flatnonzero(ends_b[np.minimum(place, len(ends_b) - 1)] == ends_a)
        stop_a, stop_b = meet + 1, place[meet] + 1
        in_a, in_b = np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0)
        window = np.searchsorted(np.cumsum(size_a), stop_a)
        # Text: of each group the first side, then the second; the last token of a side has another mark behind it.
        mark_a, mark_b = np.zeros(len(flat_a), np.int64), np.zeros(len(flat_b), np.int64)
        mark_a[stop_a - 1], mark_b[stop_b - 1] = 1, 2
        begin = np.cumsum(in_a + in_b) - in_a - in_b
        codes = np.empty(len(flat_a) + len(flat_b), np.int64)
        codes[spread(begin, in_a)], codes[spread(begin + in_a, in_b)] = flat_a * 3 + mark_a, flat_b * 3 + mark_b
        parts, stops = [self.written[c] for c in codes.tolist()], np.cumsum(size_a + size_b).tolist()
        self.texts += ["".join(parts[i:j])[:-1] for i, j in zip([0, *stops], stops)]
        # Pairs: each token of one side beside all of the other. Of large groups each kind of token once, with how often it occurs.
        large = np.flatnonzero(in_a * in_b > 64)
        few = in_b.copy()
        few[large] = 0
        per = np.repeat(few, in_a)
        name = np.repeat(flat_a, per) << 32 | flat_b[spread(np.repeat(stop_b - in_b, in_a), per)]
        owner, times = np.repeat(np.repeat(window, in_a), per), np.ones(len(name), np.int64)
        for g in large.tolist():
            (a, times_a), (b, times_b) = (np.unique(x[e - m:e], return_counts=True) for x, e, m in ((flat_a, stop_a[g], in_a[g]), (flat_b, stop_b[g], in_b[g])))
            more = (a[:, None] << 32 | b[None, :]).ravel()
            name, times, owner = np.concatenate((name, more)), np.concatenate((times, np.outer(times_a, times_b).ravel())), np.concatenate((owner, np.full(len(more), window[g])))
        if len(large):
            order = np.argsort(owner, kind="stable")
            name, times, owner = name[order], times[order], owner[order]
        kinds, which = np.unique(name, return_inverse=True)
        number = np.fromiter((self.pair.setdefault(k, len(self.pair)) for k in kinds.tolist()), np.int64, len(kinds))
        count = lambda at, weight=None: np.bincount(at, weight, n).astype(np.int64)
        lengths = count(owner)
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(lengths) - lengths))
        self.flat, self.times, self.lengths = np.concatenate((self.flat, number[which])), np.concatenate((self.times, times)), np.concatenate((self.lengths, lengths))
        self.groups, self.links = np.concatenate((self.groups, count(window))), np.concatenate((self.links, count(window, in_a * in_b)))

    def places(self, keys: list[bytes], flat_a: np.ndarray, flat_b: np.ndarray, stop_a: np.ndarray, stop_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
        """Where each window is held; valid until the next call."""
        if len(self.texts) > self.most:
            self._clear()
        at, new = self.at, [i for i, key in enumerate(keys) if key not in self.at]
        at.update(zip([keys[i] for i in new], range(len(self.texts), len(self.texts) + len(new))))
        if new:
            a, b = size_a[new], size_b[new]
            self._add(flat_a[spread(stop_a[new] - a, a)], flat_b[spread(stop_b[new] - b, b)], a, b)
        return np.fromiter(map(at.__getitem__, keys), np.int64, len(keys))

    def block(self, texts: list[bytes]):
        """Of each text: ids of both, groups as text, groups, links; and the linked pairs: ``(text, a, b, times)`` in the texts' order."""
        n = len(texts)
        whole = [b" " + t if t else b"" for t in texts]
        ids_a, ids_b = self.a.encode(whole), self.b.encode(whole)
        for x, ids in ((self.a, ids_a), (self.b, ids_b)):
            lost = [i for i, back in enumerate(x.bytes_of(ids)) if back != whole[i]]
            for i in lost:
                ids_a[i] = ids_b[i] = np.zeros(0, np.int32)
                whole[i] = b""
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        flat_a, flat_b = np.concatenate(ids_a).astype(np.int64), np.concatenate(ids_b).astype(np.int64)
        # Texts stand behind one another, so a text's end is an end of both: windows never reach over it.
        ends_a, ends_b = np.cumsum(self.len_a[flat_a]), np.cumsum(self.len_b[flat_b])
        behind = np.concatenate((self.space[flat_a[1:]], [True])) if len(flat_a) else np.zeros(0, bool)
        place = np.searchsorted(ends_b, ends_a)
        anchors = np.flatnonzero(behind & (ends_b[np.minimum(place, len(ends_b) - 1)] == ends_a)) if len(flat_a) else np.zeros(0, np.int64)
        stop_a, stop_b = anchors + 1, place[anchors] + 1
        size_a, size_b = np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0)
        # A window's key: the number of its first ids, and the ids of both.
        size = 1 + size_a + size_b
        begin = np.cumsum(size) - size
        packed = np.empty(int(size.sum()), "<u4")
        packed[begin] = size_a
        packed[spread(begin + 1, size_a)] = flat_a
        packed[spread(begin + 1 + size_a, size_b)] = flat_b
        kinds, which = distinct(packed, begin, begin + size)
        keys = [packed[x:y].tobytes() for x, y in zip(begin[kinds].tolist(), (begin + size)[kinds].tolist())]
        where = self.places(keys, flat_a, flat_b, *(x[kinds] for x in (stop_a, stop_b, size_a, size_b)))[which]
        owner = np.repeat(np.arange(n), n_a)[anchors] if len(anchors) else np.zeros(0, np.int64)
        first = np.searchsorted(owner, np.arange(n + 1)).tolist()
        held = where.tolist()
        groups = [";".join([self.texts[k] for k in held[x:y]]) for x, y in zip(first, first[1:])]
        total = lambda x: np.bincount(owner, x[where], n).astype(np.int64)
        kinds = max(1, len(self.pair))
        pair = np.repeat(owner, self.lengths[where]) * kinds + gather(self.flat, self.starts[where], self.lengths[where])
        times = gather(self.times, self.starts[where], self.lengths[where])
        order = np.argsort(pair)
        pair, times = pair[order], times[order]
        head = np.flatnonzero(np.diff(pair, prepend=-1))
        times = np.add.reduceat(times, head) if len(head) else times
        names = np.fromiter(self.pair, np.int64, len(self.pair)) if self.pair else np.zeros(1, np.int64)
        of, which = np.divmod(pair[head], kinds)
        name = names[which]
        return n_a, n_b, groups, total(self.groups), total(self.links), (of, name >> 32, name & 0xFFFFFFFF, times)


def _lists(of: np.ndarray, n: int, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=n)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def aligned(docs: DataFrame, spec: dict, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """``(row, doc_id, n_a, n_b, n_groups, n_links, groups, a, b, times)``: a row per row of ``docs``, numbered by ``row``.

    ``groups``: the aligned groups in order, ``a1,a2|b1;a3|b2,b3`` in ids, or with ``digest`` the text's sha256. ``a``, ``b``, ``times``:
    each linked pair of ids and its links. A text that is null or empty, or that either tokenizer does not give back byte by byte with
    a space in front, has no tokens: no groups, zeros, and ``''`` for a digest. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(dict(spec))

    def run(batches) -> Iterator[pa.RecordBatch]:
        windows = kept(sent.value, "windows", lambda: Windows(ByteTokens(sent.value["a"]), PieceTokens(sent.value["b"])))
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, at = batch.column("doc_id"), 0
            for block in blocks(items(batch.column("text")), BLOCK):
                n = len(block)
                n_a, n_b, groups, n_groups, n_links, (of, a, b, times) = windows.block(block)
                if digest:
                    groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(n)), ids.slice(at, n), pa.array(n_a), pa.array(n_b), pa.array(n_groups), pa.array(n_links), pa.array(groups, pa.string()),
                        _lists(of, n, a, pa.int32()), _lists(of, n, b, pa.int32()), _lists(of, n, times, pa.int64()),
                    ],
                    names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "a", "b", "times"],
                )
                at, row = at + n, row + n

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), as_bytes(text).alias("text")).mapInArrow(run, ALIGNED)


def pair_counts(found: DataFrame) -> DataFrame:
    """``(a, b, n)``: how many rows of ``aligned`` hold each linked pair; combined in the tasks before the shuffle."""
    return found.select(F.explode(F.arrays_zip("a", "b")).alias("x")).groupBy(F.col("x.a").alias("a"), F.col("x.b").alias("b")).agg(F.count("*").alias("n"))


def pair_scores(docs: DataFrame, spec: dict, doc_id: str = "doc_id", text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups)``: a row per row of ``docs``; ``groups`` as a digest.

    ``count_sum`` adds up, over the links, how many rows of ``docs`` hold the link's pair; ``n_best`` counts the links whose pair has the
    highest such count of all pairs of its first id, ties included. Repeated rows each count and have a row; a null id stays null; an
    empty table gives an empty one.
    """
    spark, paths = docs.sparkSession, []

    def store(df: DataFrame, name: str) -> DataFrame:
        paths.append(scratch_path(spark, name))
        df.write.option("compression", "zstd").parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    found = store(aligned(docs, spec, doc_id, text, digest=True), "aligned")
    counts = store(pair_counts(found), "pairs")
    # One row per id of the first vocabulary at most.
    top = F.broadcast(counts.groupBy("a").agg(F.max("n").alias("most")))
    counts = counts.join(top, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))

    # At most ``frequent`` pairs: all those from a count on, which a short histogram of the counts gives.
    band, least, held = F.floor(F.log2("n") * 8), None, 0
    for r in counts.groupBy(band.alias("band")).count().orderBy(F.desc("band")).collect():
        held += r["count"]
        if held > frequent:
            break
        least = r["band"]
    common = (counts.where(band >= least) if least is not None else counts.limit(0)).toArrow()
    column = lambda name: common.column(name).combine_chunks().to_numpy(zero_copy_only=False)
    key = column("a").astype(np.int64) << 32 | column("b").astype(np.int64)
    order = np.argsort(key)
    sent = spark.sparkContext.broadcast((key[order], column("n")[order].astype(np.int64), column("best")[order].astype(bool)))

    def look_up(batches):
        keys, n, best = sent.value
        for batch in batches:
            a, b, times = (batch.column(c) for c in ("a", "b", "times"))
            sizes = np.diff(a.offsets.to_numpy())
            of = np.repeat(np.arange(len(batch)), sizes)
            a, b, times = (x.flatten().to_numpy() for x in (a, b, times))
            own = a.astype(np.int64) << 32 | b.astype(np.int64)
            at = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
            hit = keys[at] == own if len(keys) else np.zeros(len(own), bool)
            # Sums of integers, one after another: exact beyond 2 ** 53.
            total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[np.concatenate(([0], np.cumsum(sizes)))])
            weight, favoured = (np.zeros(len(own), np.int64) for _ in range(2))
            weight[hit], favoured[hit] = times[hit] * n[at[hit]], times[hit] * best[at[hit]]
            rest = np.flatnonzero(~hit)
            lists = [_lists(of[rest], len(batch), x[rest], kind) for x, kind in ((a, pa.int32()), (b, pa.int32()), (times, pa.int64()))]
            names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(total(favoured)), pa.array(total(weight)), *lists], names=[*names, "best", "weight", "a", "b", "times"],
            )

    schema = ALIGNED.replace("groups string,", "groups string, best long, weight long,")
    known = store(found.mapInArrow(look_up, schema), "known")
    rare = known.select("row", F.explode(F.arrays_zip("a", "b", "times")).alias("x")).select("row", "x.*")
    rest = counts.where(band < least) if least is not None else counts
    met = rare.join(rest, ["a", "b"]).groupBy("row").agg(
        F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best")
    )
    met = store(met, "met")
    discard(spark, *paths[:2])
    zero = lambda c: F.coalesce(c, F.lit(0))
    return known.join(met, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("best") + zero("more_best")).alias("n_best"), (F.col("weight") + zero("more")).alias("count_sum"), "groups",
    )
