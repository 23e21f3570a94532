"""Subword ids of whole texts with a public byte-level tokenizer."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable

import numpy as np
from tokenizers import Tokenizer

from vecloom.llm.text import slice_hashes

SIMPLE = re.compile(rb" ?[^ \t-\r]+")
#: White space beyond ASCII, of which not every library has the same list: such texts are encoded in one piece.
ODD = re.compile("|".join(map(chr, [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])).encode())
#: Marks that stand behind a word.
MARKS = ".,;:!?"
#: Kinds of bytes: white space, marks, ASCII letters and digits, and bytes with which odd white space begins.
_SPACE, _MARK, _ALNUM, _ODD = (np.zeros(256, bool) for _ in range(4))
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MARK[list(MARKS.encode())] = True
_ALNUM[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True
_ODD[[*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = True
_ALPHA = _ALNUM.copy()
_ALPHA[[*b"0123456789"]] = False
#: Byte-level alphabet: a printable byte of Latin-1 is itself, the others are numbered from 256 on.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTES = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
_NAMES = np.array([ord(BYTES.get(b, chr(b))) for b in range(256)], "<u2")


def load(path: str) -> str:
    """The tokenizer's file as text, so that it travels with the job and executors need no copy."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices ``flat[starts[i]:starts[i] + lengths[i]]`` one after another."""
    before = np.cumsum(lengths) - lengths
    return flat[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))]


def distinct(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A first slice of each kind among the slices of ``flat``, and which kind each slice is. Found by hash, checked by content."""
    _, first, inverse = np.unique(slice_hashes(flat, starts, ends) if hashes is None else hashes, return_index=True, return_inverse=True)
    size, rep = ends - starts, first[inverse]
    same = bool((size == size[rep]).all())
    for a in range(0, len(starts) if same else 0, 1 << 17):
        cut = slice(a, a + (1 << 17))
        same = same and bool((gather(flat, starts[cut], size[cut]) == gather(flat, starts[rep[cut]], size[cut])).all())
    if same:
        return first, inverse
    held: dict[bytes, int] = {}
    inverse = np.array([held.setdefault(flat[s:e].tobytes(), len(held)) for s, e in zip(starts.tolist(), ends.tolist())], np.int64)
    return np.unique(inverse, return_index=True)[1], inverse


def letters(flat: np.ndarray) -> np.ndarray:
    """Bytes that belong to letters of A-Z or of two bytes, U+00C0 to U+023F but the two signs among them."""
    out = _ALPHA[flat]
    lead = np.flatnonzero((flat[:-1] >= 0xC3) & (flat[:-1] <= 0xC8)) if len(flat) else np.zeros(0, np.int64)
    second = flat[lead + 1]
    lead = lead[(second >= 0x80) & (second < 0xC0) & ((flat[lead] != 0xC3) | (second != 0x97) & (second != 0xB7))]
    out[lead] = out[lead + 1] = True
    return out


class Pieces:
    """Ids of text pieces, each encoded once while it is held.

    ``encode`` turns a list of pieces into lists of ids; ``value``, if given, gives a number for each. Beyond ``most`` pieces those
    met again are kept, at most half of the bound, and the others go: most pieces of a corpus occur once.
    """

    def __init__(self, encode: Callable[[list], list[np.ndarray]], most: int, value: Callable[[list], list[float]] | None = None):
        self.encode, self.most, self.value = encode, most, value
        self.at: dict = {}
        self.keys: list = []
        self.flat = np.zeros(0, np.int32)
        self.starts, self.lengths, self.hits, self.values = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def _shrink(self) -> None:
        kept = np.flatnonzero(self.hits > 1)
        kept = np.sort(kept[np.argsort(-self.hits[kept], kind="stable")[:self.most // 2]])
        self.flat, self.lengths, self.hits = gather(self.flat, self.starts[kept], self.lengths[kept]), self.lengths[kept], self.hits[kept] // 2
        self.starts, self.values = np.cumsum(self.lengths) - self.lengths, self.values[kept] if self.value else self.values
        self.keys = [self.keys[i] for i in kept.tolist()]
        self.at = dict(zip(self.keys, range(len(self.keys))))

    def places(self, pieces: list, times: np.ndarray | None = None) -> np.ndarray:
        """Where each piece is held, valid until the next call; ``times``: how often each is met."""
        if len(self.keys) > self.most:
            self._shrink()
        new = list(set(pieces).difference(self.at))
        if new:
            found = self.encode(new)
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            self.at.update(zip(new, range(len(self.keys), len(self.keys) + len(new))))
            self.keys += new
            self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(lengths) - lengths))
            self.lengths, self.hits = np.concatenate((self.lengths, lengths)), np.concatenate((self.hits, np.zeros(len(new), np.int64)))
            more = np.fromiter(itertools.chain.from_iterable(found), np.int32, int(lengths.sum()))
            self.flat = np.concatenate((self.flat, more))
            if self.value:
                self.values = np.concatenate((self.values, np.array(self.value(new), np.float64)))
        where = np.fromiter(map(self.at.__getitem__, pieces), np.int64, len(pieces))
        self.hits += np.bincount(where, times, minlength=len(self.hits)).astype(np.int64)
        return where

    def ids(self, places: np.ndarray) -> np.ndarray:
        return gather(self.flat, self.starts[places], self.lengths[places])


class Held:
    """Ids of slices of bytes, each encoded once while it is held; found by a 64-bit hash in a table, checked by content.

    ``encode`` turns joined slices and their edges into ``(ids, ids of each)``. All is arrays, some forty bytes a slice. Beyond ``most``
    slices those met again are kept, at most half of the bound, and the others go: most units of a corpus occur once.
    """

    def __init__(self, encode: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], most: int):
        self.encode, self.most = encode, most
        self.keys, self.bytes, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.int32)
        self.begins, self.sizes, self.starts, self.lengths, self.hits = (np.zeros(0, np.int64) for _ in range(5))
        self.slots = np.full(1 << 10, -1, np.int32)

    def _shrink(self) -> None:
        kept = np.flatnonzero(self.hits > 1)
        kept = np.sort(kept[np.argsort(-self.hits[kept], kind="stable")[:self.most // 2]])
        self.bytes, self.flat = gather(self.bytes, self.begins[kept], self.sizes[kept]), gather(self.flat, self.starts[kept], self.lengths[kept])
        self.keys, self.sizes, self.lengths, self.hits = self.keys[kept], self.sizes[kept], self.lengths[kept], self.hits[kept] // 2
        self.begins, self.starts = np.cumsum(self.sizes) - self.sizes, np.cumsum(self.lengths) - self.lengths
        self.slots.fill(-1)
        self._put(np.arange(len(kept)))

    def _put(self, rows: np.ndarray) -> None:
        """Enter held slices into the table: each at the first free slot from its hash on."""
        if len(self.keys) * 2 > len(self.slots):
            self.slots = np.full(1 << int(len(self.keys) * 4 - 1).bit_length(), -1, np.int32)
            rows = np.arange(len(self.keys))
        mask = len(self.slots) - 1
        at = (self.keys[rows] & np.uint64(mask)).astype(np.int64)
        while len(rows):
            free = self.slots[at] < 0
            self.slots[at[free]] = rows[free]
            left = self.slots[at] != rows
            rows, at = rows[left], (at[left] + 1) & mask

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The held slice of each hash, or -1."""
        mask, out = len(self.slots) - 1, np.full(len(keys), -1, np.int64)
        left, at = np.arange(len(keys)), (keys & np.uint64(mask)).astype(np.int64)
        while len(left):
            row = self.slots[at]
            there = row >= 0
            left, at, row = left[there], at[there], row[there]
            same = self.keys[row] == keys[left]
            out[left[same]] = row[same]
            left, at = left[~same], (at[~same] + 1) & mask
        return out

    def places(self, flat: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Where each slice ``flat[edges[i]:edges[i + 1]]`` is held, valid until the next call."""
        if len(self.keys) > self.most:
            self._shrink()
        starts, ends, size = edges[:-1], edges[1:], np.diff(edges)
        keys = slice_hashes(flat, starts, ends)
        where = self._find(keys)
        wrong = where >= 0
        wrong[wrong] = self.sizes[where[wrong]] != size[wrong]
        for a in range(0, len(where), 1 << 16):
            cut = np.flatnonzero((where[a:a + (1 << 16)] >= 0) & ~wrong[a:a + (1 << 16)]) + a
            if len(cut):
                differ = gather(self.bytes, self.begins[where[cut]], size[cut]) != gather(flat, starts[cut], size[cut])
                if differ.any():
                    wrong[np.repeat(cut, size[cut])[differ]] = True
        # A slice that only shares the hash of a held one is held beside it, but not found again.
        new = np.flatnonzero((where < 0) | wrong)
        if len(new):
            first, which = distinct(flat, starts[new], ends[new], keys[new])
            first, base = new[first], len(self.keys)
            more, text = size[first], gather(flat, starts[first], size[first])
            ids, lengths = self.encode(text, np.concatenate(([0], np.cumsum(more))))
            where[new] = base + which
            self.begins, self.starts = (np.concatenate((x, len(y) + np.cumsum(n) - n)) for x, y, n in ((self.begins, self.bytes, more), (self.starts, self.flat, lengths)))
            self.bytes, self.flat = np.concatenate((self.bytes, text)), np.concatenate((self.flat, ids.astype(np.int32)))
            self.keys, self.sizes, self.lengths = (np.concatenate(x) for x in ((self.keys, keys[first]), (self.sizes, more), (self.lengths, lengths)))
            self.hits = np.concatenate((self.hits, np.zeros(len(first), np.int64)))
            self._put(base + np.flatnonzero(~wrong[first]))
        self.hits += np.bincount(where, minlength=len(self.hits))
        return where

    def ids(self, places: np.ndarray) -> np.ndarray:
        return gather(self.flat, self.starts[places], self.lengths[places])


def apart(joined: np.ndarray, line: int, n: int) -> list[np.ndarray] | None:
    """Ids of ``n`` pieces, each after a line break; None if a line break went into another id."""
    cut = np.flatnonzero(joined == line)
    if len(cut) != n:
        return None
    return [joined[a + 1:b] for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(joined)])]


class Encoder:
    """Encodes whole texts; a unit that is held is looked up. ``most`` bounds the units held."""

    def __init__(self, spec: str, most: int = 600_000, plain_specials: bool = False):
        """``plain_specials``: strings of special tokens in a text are ordinary text."""
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = plain_specials
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.pieces = Held(self._encode, most)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def _encode(self, flat: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of Latin letters, with a space before or not, are one piece for the tokenizer's rule, so they go straight to its model.
        Other units without a line break are joined by line breaks, encoded at once and cut there."""
        starts, size = edges[:-1], np.diff(edges)
        spaced = flat[starts] == 0x20
        other = ~letters(flat)
        other[starts[spaced]] = False
        word = (np.diff(np.concatenate(([0], np.cumsum(other)))[edges]) == 0) & (size > spaced)
        out: list = [None] * len(size)
        tokenize, joined, single = self.tokenizer.model.tokenize, [], []
        at = np.flatnonzero(word)
        # The words as the model reads them, a character a byte, parted by line breaks.
        names = np.full(int(size[at].sum()) + len(at), 10, "<u2")
        names[np.arange(len(names) - len(at)) + np.repeat(np.arange(len(at)), size[at])] = _NAMES[gather(flat, starts[at], size[at])]
        for i, name in zip(at.tolist(), names.tobytes().decode("utf-16-le").split("\n")):
            out[i] = [t.id for t in tokenize(name)]
        buffer = flat.tobytes()
        units = {i: buffer[a:b] for i, a, b in zip(*(x[~word].tolist() for x in (np.arange(len(size)), starts, edges[1:])))}
        for i, unit in units.items():
            (joined if SIMPLE.fullmatch(unit) else single).append(i)
        for at in range(0, len(joined), 2000):
            part = joined[at:at + 2000]
            text = "\n" + "\n".join(units[i].decode(errors="replace") for i in part)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
            found = apart(ids, self.line[0], len(part)) if len(self.line) == 1 else None
            if found is None:
                single += part
            else:
                for i, x in zip(part, found):
                    out[i] = x.tolist()
        for i in single:
            out[i] = self.whole(units[i].decode(errors="replace")).tolist()
        lengths = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter(itertools.chain.from_iterable(out), np.int32, int(lengths.sum())), lengths

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.encode_bytes([t.encode() for t in texts])

    def encode_bytes(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text. A unit is white space with the word behind it, a mark that ends a word, or a line break: such a tokenizer cuts
        before the white space, between a letter and a mark, and behind a line break alone, so units are encoded apart."""
        out: list = [None] * len(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(texts), np.uint8)
        odd = np.unique(np.searchsorted(begin + sizes, np.flatnonzero(_ODD[flat]), "right")).tolist()
        odd = [i for i in odd if ODD.search(texts[i])]
        for i in odd:
            out[i] = self.whole(texts[i].decode(errors="replace"))
        plain = [i for i in range(len(texts)) if out[i] is None]
        where, first = self._units(texts if not odd else [texts[i] for i in plain])
        ids = self.pieces.ids(where)
        ends = np.concatenate(([0], np.cumsum(self.pieces.lengths[where])))[first]
        for i, a, b in zip(plain, ends.tolist(), ends[1:].tolist()):
            out[i] = ids[a:b]
        return out

    def _units(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where the units of all texts are held, and the number of each text's first one."""
        buffer, ends = b"".join(texts), np.cumsum([0] + [len(t) for t in texts])
        flat = np.frombuffer(buffer, np.uint8)
        n = len(flat)
        space, border = _SPACE[flat], np.zeros(n + 1, bool)
        border[ends] = True
        cut = border.copy()
        cut[1:n] |= space[1:] & ~space[:-1]
        # A mark between a letter and white space, or the text's end. Letters with two bytes: U+00C0 to U+00FF but the two signs.
        after = border[1:].copy()
        after[:-1] |= space[1:]
        mark = np.flatnonzero(_MARK[flat] & after)
        mark = mark[~border[mark]]
        last, lead = flat[mark - 1], flat[np.maximum(mark, 2) - 2]
        letter = _ALNUM[last] | (lead == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7) & (mark >= 2)
        cut[mark[letter]] = True
        # A line break or tab alone before a word is cut off too.
        alone = np.flatnonzero(cut[:-2] & space[:-1] & (flat[:-1] != 0x20) & ~space[1:]) + 1 if n else mark
        cut[alone] = True
        at = np.flatnonzero(cut)
        return self.pieces.places(flat, at), np.searchsorted(at[:-1], ends)
