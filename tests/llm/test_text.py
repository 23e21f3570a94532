import random
import re

import numpy as np

from vecloom.llm import text
from vecloom.llm.text import Words

TEXTS = [b"", b" \t", b"one", b"One  two\nTHREE two", "\xc9t\xe9 \xa0x　y Ä".encode(), b"a\x0bb\x0cc\x1fd", b"x" * 5000, b"p q " * 400]


def test_words_are_those_of_the_pattern():
    words = Words(TEXTS)
    for i, t in enumerate(TEXTS):
        a, b = words.first[i], words.first[i + 1]
        got = [words.buffer[s:e] for s, e in zip(words.starts[a:b], words.ends[a:b])]
        assert got == re.findall(rb"[^\x20\x09-\x0D]+", t.lower())
    assert len(Words([])) == 0 and list(Words([]).counts()) == []


def test_hashes_follow_words(monkeypatch):
    rng = random.Random(5)
    texts = TEXTS + [" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(300)).encode() for _ in range(9)]
    words = Words(texts)
    plain = [words.buffer[s:e] for s, e in zip(words.starts, words.ends)]
    h = words.hashes()
    assert len(set(plain)) == len(set(h.tolist())) == len(set(zip(plain, h.tolist())))
    monkeypatch.setattr(text, "_PIECE", 64)
    assert (Words(texts).hashes() == h).all()


def test_shingles_stay_inside_their_text():
    texts = [b"a b c d e f", b"", b"a b", b"x a b c d e", b"a  B\nc d E", b"b c d e f"]
    owner, h = Words(texts).shingles(5)
    by = {i: h[owner == i].tolist() for i in range(len(texts))}
    assert [len(by[i]) for i in range(6)] == [2, 0, 1, 2, 1, 1]
    assert by[0][0] == by[3][1] == by[4][0] and by[0][1] == by[5][0] and len(set(np.concatenate([h]).tolist())) == 4
