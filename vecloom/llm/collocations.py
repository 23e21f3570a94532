"""Phrase collocations by Rabin-Karp fingerprints.

A text is cut into pieces at punctuation and line ends, and pieces into words. Every run of words in a piece has a fingerprint, a
difference of two prefix sums of a polynomial over the words' hashes. Fingerprints are counted level by level, one word longer each
time: a task counts those of its blocks, a shuffle adds the counts up and keeps a pointer to a document that holds one. A run is only
counted if both runs of one word less are frequent; a fixed-size filter of the frequent fingerprints says so. It may err on one side and
then lets a run be counted that need not be.

Only then is text looked at: every occurrence of a frequent fingerprint is compared with its block's first one, word by word, and blocks
are compared by the phrases themselves, so runs that share a fingerprint by chance are told apart. No other phrase becomes a string.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.llm.subwords import gather
from vecloom.llm.text import Words, _mix, _run_of, as_bytes, blocks, items, kept
from vecloom.session import discard, scratch_path

#: Least occurrences and most words of a phrase; phrases of a language that are returned.
LEAST, LONGEST, TOP = 100, 5, 2000
#: A phrase goes if a longer one has so many hundredths of its occurrences.
PERCENT = 100
#: What separates pieces, and words.
PIECE, SPACE = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Bits of the filter, and bytes of text handled at once.
BITS, BLOCK = 1 << 26, 1 << 20
NO_LANG = "und"
#: Parts into which a language's phrases are dealt, so that no task holds all of a large language.
SALTS = 64

_KIND = np.zeros(256, np.uint8)
_KIND[list(SPACE)], _KIND[list(PIECE)] = 1, 2
_BASE, _INVERSE = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)


class Runs(Words):
    """The words of a block of texts, A-Z lowered, the piece of each, and fingerprints of runs of words. ``salt``: a number per text."""

    def __init__(self, texts: list[bytes], salt: np.ndarray):
        self.buffer = b"\n".join(texts).lower()
        self.bytes = np.frombuffer(self.buffer, np.uint8)
        kind = _KIND[self.bytes]
        space = np.concatenate(([True], kind > 0, [True]))
        edge = np.flatnonzero(space[1:] != space[:-1])
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.starts, np.cumsum([0] + [len(t) + 1 for t in texts]))
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[self.starts] if len(edge) else np.zeros(0, np.int32)
        self.text = self.owner()
        self.salt = salt[self.text]
        self.word = self.hashes()
        self.inverse = _run_of(_INVERSE, len(self) + 1)
        self.prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.word * _run_of(_BASE, len(self)), dtype=np.uint64))) if len(self) else np.zeros(1, np.uint64)

    def whole(self, n: int) -> np.ndarray:
        """Whether a run of ``n`` words begins at each word and ends in its piece."""
        out = np.zeros(len(self), bool)
        if len(self) >= n:
            out[:len(self) - n + 1] = self.piece[n - 1:] == self.piece[:len(self) - n + 1]
        return out

    def fingerprints(self, at: np.ndarray, n: int) -> np.ndarray:
        """Of the runs of ``n`` words that begin at words ``at``."""
        return _mix((self.prefix[at + n] - self.prefix[at]) * self.inverse[at] + self.salt[at] * np.uint64(2 * n + 1))

    def ids(self) -> np.ndarray:
        """A number for each word, equal for equal words alone: the hash's, checked against the bytes."""
        _, first, ids = np.unique(self.word, return_index=True, return_inverse=True)
        size, rep = self.ends - self.starts, first[ids]
        same = bool((size == size[rep]).all())
        for a in range(0, len(self) if same else 0, 1 << 17):
            cut = slice(a, a + (1 << 17))
            same = same and bool((gather(self.bytes, self.starts[cut], size[cut]) == gather(self.bytes, self.starts[rep[cut]], size[cut])).all())
        if same:
            return ids
        held: dict[bytes, int] = {}
        return np.array([held.setdefault(self.buffer[s:e], len(held)) for s, e in zip(self.starts.tolist(), self.ends.tolist())])

    def phrase(self, at: int, n: int) -> bytes:
        return b" ".join(self.buffer[self.starts[at]:self.ends[at + n - 1]].split())


class Sieve:
    """A filter of 64-bit numbers: two bits each, in a field of fixed size. It finds all that were put in, and few others."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    @classmethod
    def read(cls, packed: bytes) -> Sieve:
        return cls(np.frombuffer(zlib.decompress(packed), np.uint64))

    def packed(self) -> bytes:
        """For the way to the tasks: mostly zeros while few numbers are in it."""
        return zlib.compress(self.words.tobytes(), 1)

    def holds(self, h: np.ndarray) -> np.ndarray:
        one = np.uint64(1)
        out = np.ones(len(h), bool)
        for x in (h & self.mask, (h >> np.uint64(32)) & self.mask):
            out &= (self.words[x >> np.uint64(6)] >> (x & np.uint64(63)) & one).astype(bool)
        return out


def sieve(fps: DataFrame, bits: int = BITS) -> Sieve:
    """A ``Sieve`` of column ``fp``, however many rows: tasks and a shuffle join the bits, the driver gets ``bits / 64`` numbers at most."""
    bit = F.explode(F.array(F.col("fp").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("fp", 32).bitwiseAND(F.lit(bits - 1)))).alias("bit")
    parts = fps.select(bit).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, CAST(bit & 63 AS INT)))").alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    column = lambda name: parts.column(name).combine_chunks().to_numpy(zero_copy_only=False)
    words[column("at").astype(np.int64)] = column("bits").astype(np.int64).view(np.uint64)
    return Sieve(words)


def _blocks(batches) -> Iterator[tuple[Runs, list[str], np.ndarray, np.ndarray]]:
    """``(runs, languages, language of each text, row of each text)`` of blocks of the documents."""
    for batch in batches:
        at, lang, row = 0, batch.column("lang"), batch.column("doc_id").to_numpy(zero_copy_only=False)
        for block in blocks(items(batch.column("text")), BLOCK):
            coded = lang.slice(at, len(block)).dictionary_encode()
            names, of = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            salts = np.array([xxhash.xxh64_intdigest(x) for x in names], np.uint64)
            yield Runs(block, salts[of]), names, of, row[at:at + len(block)]
            at += len(block)


def _alive(runs: Runs, n: int, before: np.ndarray | None) -> np.ndarray:
    """Words at which a run of ``n`` words begins whose two runs of a word less are both in ``before``."""
    whole = runs.whole(n)
    if before is not None and len(whole):
        whole[:-1] &= before[:-1] & before[1:]
        whole[-1:] &= n == 1
    return np.flatnonzero(whole)


def _marked(runs: Runs, n: int, at: np.ndarray, known: Sieve) -> np.ndarray:
    out = np.zeros(len(runs), bool)
    out[at[known.holds(runs.fingerprints(at, n))]] = True
    return out


def _exact(runs: Runs, n: int, at: np.ndarray, words: np.ndarray, lang: np.ndarray) -> Iterator[tuple[int, bytes, int]]:
    """``(language, phrase, occurrences)`` of the runs of ``n`` words that begin at words ``at``: every run is compared with the first one of
    its fingerprint, word by word."""
    _, first, inverse, count = np.unique(runs.fingerprints(at, n), return_index=True, return_inverse=True, return_counts=True)
    rep = at[first]
    if any((words[at + j] != words[rep[inverse] + j]).any() for j in range(n)) or (lang[at] != lang[rep[inverse]]).any():
        # Two runs of this block share a fingerprint: tell them apart by their words.
        rows = np.stack([lang[at], *(words[at + j] for j in range(n))], axis=1)
        _, first, count = np.unique(rows, axis=0, return_index=True, return_counts=True)
        rep = at[first]
    yield from zip(lang[rep].tolist(), (runs.phrase(i, n) for i in rep.tolist()), count.tolist())


def fingerprint_counts(docs: DataFrame, n: int, before: Sieve | None) -> DataFrame:
    """``(fp, n, doc_id)`` of runs of ``n`` words: occurrences, and the least id of a document with one; ``before``: the frequent ones of a
    word less. Documents: ``(doc_id, lang, text)``, the text in bytes."""
    sent = docs.sparkSession.sparkContext.broadcast({"before": before and before.packed()})

    def run(batches):
        known = kept(sent.value, "sieve", lambda: Sieve.read(sent.value["before"])) if sent.value["before"] else None
        for runs, _, _, rows in _blocks(batches):
            marked = _marked(runs, n - 1, np.flatnonzero(runs.whole(n - 1)), known) if known else None
            at = _alive(runs, n, marked)
            fp, first, count = np.unique(runs.fingerprints(at, n), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(count.astype(np.int64)), pa.array(rows[runs.text[at[first]]], pa.int64(), from_pandas=True)], names=["fp", "n", "doc_id"])

    counted = docs.mapInArrow(run, "fp long, n long, doc_id long")
    return counted.groupBy("fp").agg(F.sum("n").alias("n"), F.min("doc_id").alias("doc_id"))


def phrases(docs: DataFrame, known: list[Sieve]) -> DataFrame:
    """``(lang, words, phrase, f)``: exact occurrences of every phrase whose fingerprint passes ``known`` (by words), and with 0 words and an
    empty phrase all words of a language."""
    sent = docs.sparkSession.sparkContext.broadcast({"known": [s.packed() for s in known]})

    def run(batches):
        sieves = kept(sent.value, "sieves", lambda: [Sieve.read(x) for x in sent.value["known"]])
        for runs, names, of, _ in _blocks(batches):
            lang, words = of[runs.text], runs.ids()
            total = np.bincount(of, runs.counts(), len(names)).astype(np.int64)
            out_lang, out_words, out_phrase, out_n = list(range(len(names))), [0] * len(names), [b""] * len(names), total.tolist()
            marked = None
            for n, one in enumerate(sieves, 1):
                at = _alive(runs, n, marked)
                marked = _marked(runs, n, at, one)
                at = np.flatnonzero(marked)
                for one_lang, phrase, count in _exact(runs, n, at, words, lang):
                    out_lang.append(one_lang)
                    out_words.append(n)
                    out_phrase.append(phrase)
                    out_n.append(count)
            lang_column = pa.DictionaryArray.from_arrays(pa.array(out_lang, pa.int32()), pa.array(names, pa.string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([lang_column, pa.array(out_words, pa.int32()), pa.array(out_phrase, pa.binary()), pa.array(out_n, pa.int64())], names=["lang", "words", "phrase", "f"])

    found = docs.mapInArrow(run, "lang string, words int, phrase binary, f long")
    return found.groupBy("lang", "words", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("f").alias("f"))


def cut_score(a: str, n: str, left: str, right: str) -> Column:
    """``floor(1000 * a * n / (left * right))``, exact for counts below 10 ** 15."""
    big = lambda c: f"CAST({c} AS DECIMAL(15, 0))"
    return F.expr(f"(CAST(1000 AS DECIMAL(4, 0)) * {big(a)} * {big(n)}) div ({big(left)} * {big(right)})")


def collocations(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, percent: int = PERCENT, bits: int = BITS) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of each language.

    Phrases have 2 to ``longest`` words and ``a >= least`` occurrences. ``n``: all words of the language; ``l`` and ``r``: occurrences of
    the parts at the cut that scores lowest (of equal ones, the first). A phrase inside a longer one that has ``percent`` hundredths of its
    occurrences goes. Order: score, occurrences (both falling), phrase by its UTF-8 bytes.

    A null language counts as ``und``; null texts are empty; repeated rows and null ids count like any other; a text may be of any length;
    an empty table, or one without frequent words, gives no rows. Other columns are not read.
    """
    spark, paths = docs.sparkSession, []

    def store(df: DataFrame, name: str) -> DataFrame:
        paths.append(scratch_path(spark, name))
        df.write.parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"), as_bytes(text).alias("text"))
    known: list[Sieve] = []
    for n in range(1, longest + 1):
        frequent = store(fingerprint_counts(rows, n, known[-1] if known else None).where(F.col("n") >= least), f"fingerprints-{n}")
        if frequent.isEmpty():
            break
        known.append(sieve(frequent, bits))
    found = store(phrases(rows, known).where((F.col("f") >= least) | (F.col("words") == 0)), "phrases")
    total = found.where("words = 0").select("lang", F.col("f").alias("n"))
    count = found.where("words > 0").select("lang", "phrase", "f")
    candidates = found.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"))

    # A part one word shorter has at least as many occurrences as any shorter part inside it, so looking one word up is enough.
    part = lambda i, m: F.array_join(F.slice(F.split("phrase", " "), i, m), " ")
    less = F.col("words") - 1
    inside = candidates.where("words > 2").select("lang", F.explode(F.array(part(F.lit(1), less), part(F.lit(2), less))).alias("phrase"), F.col("a").alias("longer"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = candidates.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * percent)).drop("longer")
    kept = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int"))
    kept = kept.join(total.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["lang", "salt"])

    k = F.explode(F.sequence(F.lit(1), less)).alias("k")
    cuts = kept.select("*", k).withColumn("left", part(F.lit(1), F.col("k"))).withColumn("right", part(F.col("k") + 1, F.col("words") - F.col("k")))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(count.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    cuts = cuts.withColumn("score", cut_score("a", "n", "l", "r"))
    best = cuts.groupBy("lang", "salt", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    # The first ones of each part, then of these the first ones of the language.
    order = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy(F.desc("score"), F.desc("a"), "phrase"))
    leaders = best.select("lang", "salt", "phrase", "a", "x.l", "x.r", "n", "x.score").withColumn("rank", order("salt")).where(F.col("rank") <= top)
    scored = store(leaders.drop("rank", "salt"), "scored")
    discard(spark, *paths[:-1])
    ranked = scored.withColumn("rank", order()).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
