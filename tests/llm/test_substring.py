"""FM-index and substring dedup against brute force."""

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from pulse.llm import substring
from pulse.llm.fmindex import BitVector, FMIndex, WaveletMatrix


def brute(rows, window):
    """Result per different row; equal rows are one document."""
    count, words = Counter(), {}
    for key in set(rows):
        words[key] = (key[1] or "").encode().split()
        count.update(tuple(words[key][i:i + window]) for i in range(len(words[key]) - window + 1))
    out = {}
    for key, ws in words.items():
        keep = [True] * len(ws)
        for i in range(len(ws) - window + 1):
            if count[tuple(ws[i:i + window])] > 1:
                keep[i:i + window] = [False] * window
        kept = [w for w, k in zip(ws, keep, strict=True) if k]
        out[key] = (key[0], len(ws), len(ws) - len(kept), sha256(b" ".join(kept)).hexdigest())
    return sorted((out[key] for key in rows), key=str)


def test_bit_vector_and_wavelet_matrix():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, 1000).astype(np.uint8)
    at = np.arange(1001)
    assert (BitVector(bits).ones(at) == np.concatenate([[0], np.cumsum(bits)])).all()
    symbols = rng.integers(0, 30, 500)
    matrix = WaveletMatrix(symbols, 5)
    for s in range(30):
        zero, end = matrix.narrow(np.array([s, s]), np.array([0, 0]), np.array([500, 123]))
        assert (end - zero).tolist() == [(symbols == s).sum(), (symbols[:123] == s).sum()]


@pytest.mark.parametrize("seed", range(20))
def test_matching_statistics(seed):
    rng = np.random.default_rng(seed)
    window, base = int(rng.integers(2, 9)), [rng.integers(0, 12, 40) for _ in range(4)]
    sequences = []
    for _ in range(15):
        s = base[rng.integers(4)][rng.integers(0, 20):].copy()
        s[rng.integers(len(s))] = rng.integers(0, 12)
        sequences.append(s.astype(np.uint64))
    weights = rng.integers(1, 3, len(sequences))
    index = FMIndex(sequences, weights, window)
    found = index.repeated_windows(window)
    count = Counter()
    for s, w in zip(sequences, weights, strict=True):
        for i in range(len(s) - window + 1):
            count[tuple(s[i:i + window])] += int(w)
    for s, start in zip(sequences, index.starts, strict=True):
        wanted = [count[tuple(s[i:i + window])] > 1 for i in range(len(s) - window + 1)]
        assert found[start:start + len(wanted)].tolist() == wanted


@pytest.mark.parametrize("sizes", [{}, {"hot_entries": 0}, {"shard_words": 100}])
def test_query_matches_brute_force(make_docs, awkward, sizes):
    rng = random.Random(8)
    passages = [[f"p{k}w{rng.randrange(300)}" for _ in range(80)] for k in range(5)]
    rows = []
    for i in range(60):
        words = [f"own{rng.randrange(5000)}" for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            p = list(rng.choice(passages))[rng.randrange(30):]
            if rng.random() < 0.5:
                p[rng.randrange(len(p))] = "edited"
            words[rng.randrange(len(words) + 1):0] = p
        rows.append((100 + i, " ".join(words)))
    rows += [(90, "again " * 80), *[r for r in awkward if r[0] != 7]]
    got = substring.substring_query(make_docs(rows), **sizes).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, substring.WINDOW)


def test_empty_table(make_docs):
    assert substring.substring_query(make_docs([])).count() == 0
