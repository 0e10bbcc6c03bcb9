"""Words, n-grams and hashes against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa

from tilewright.llm import words as W


def texts():
    rng = random.Random(2)
    return ["", " ", "a", "a b", "\x0b\x1c x\xa0y", "é è", None, "w " * 50] + ["".join(rng.choice("ab \t\né") for _ in range(rng.randrange(30))) for _ in range(300)]


def test_words_and_ngrams():
    rows = texts()
    for size in (1, 20, W.CHUNK):
        seen = 0
        for i, j, data, offsets in W.slices(pa.array(rows), size):
            assert i == seen
            seen = j
            starts, ends, counts = W.words(data, offsets)
            got = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
            want = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in rows[i:j]]
            assert got == [w for row in want for w in row] and counts.tolist() == [len(w) for w in want]
            hashes = W.span_hashes(data, starts, ends)
            for n in (1, 2, 3, 5):
                grams, each = W.ngrams(hashes, counts, n)
                plain = [[tuple(w[k : k + n]) for k in range(len(w) - n + 1)] for w in want]
                assert each.tolist() == [len(p) for p in plain]
                names: dict = {}
                for g, p in zip(grams.tolist(), [x for row in plain for x in row], strict=True):
                    assert names.setdefault(p, g) == g
                assert len(set(names.values())) == len(names)
        assert seen == len(rows)


def test_window_hashes_and_sums():
    names = W.mix(np.arange(40, dtype=np.uint64) % np.uint64(7))
    h = W.window_hashes(names, 5)
    assert len(h) == 36 and len(set(h.tolist())) == 7 and (h[:29] == h[7:]).all()
    assert W.window_hashes(names[:3], 5).tolist() == []
    assert W.row_sums(np.array([1.0, 2.0, 4.0]), np.array([0, 2, 0, 1])).tolist() == [0.0, 3.0, 0.0, 4.0]


def test_span_hashes_tell_balanced_words_apart():
    for n in (7, 8, 9, 16, 64, 65, 1024, 4096):
        bits = [bin(i).count("1") % 2 for i in range(n)]
        both = [bytes(b"ab"[b] for b in bits), bytes(b"ba"[b] for b in bits)]
        data = np.frombuffer(both[0] + both[1] + both[0] + b"\0", np.uint8)
        for seed in (0, 1):
            h = W.span_hashes(data, np.array([0, n, 2 * n, 2 * n]), np.array([n, 2 * n, 3 * n, 3 * n + 1]), seed)
            assert h[0] == h[2] and len(set(h.tolist())) == 3


def test_span_hashes_depend_on_bytes_alone():
    rng = random.Random(4)
    words = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 100))) for _ in range(500)] * 2
    rng.shuffle(words)
    ends = np.cumsum([len(w) for w in words])
    h = W.span_hashes(np.frombuffer(b"".join(words), np.uint8), ends - np.array([len(w) for w in words]), ends)
    names: dict = {}
    assert all(names.setdefault(w, x) == x for w, x in zip(words, h.tolist(), strict=True)) and len(set(names.values())) == len(names)
