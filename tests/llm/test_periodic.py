"""Periodic runs against brute force."""

import random
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from pulse.llm import periodic


def brute_runs(words, least=6, power=4):
    """(start, length, period) of every longest stretch, by trying each period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, power * q):
                found.setdefault((i, j + q), q)
            i = max(i + 1, j)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_row(doc_id, text, tails=True):
    words = (text or "").encode().split()
    check, n = crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if tails and check % 10 == 0 and n:
        g = check // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(((-length, s, q) for s, length, q in runs), default=None)
    longest = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    return (doc_id, len(runs), *longest, sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


@pytest.mark.parametrize(("least", "power"), [(6, 4), (2, 2), (3, 3)])
def test_runs_of_many_small_texts(least, power):
    rng = random.Random(power)
    for _ in range(300):
        texts = []
        for _ in range(rng.randrange(1, 6)):
            n, letters = rng.randrange(60), rng.choice([1, 2, 2, 3, 8])
            words = [rng.randrange(letters) for _ in range(n)]
            if n and rng.random() < 0.6:
                a = rng.randrange(n)
                p = 1 + rng.randrange(max(1, (n - a) // 3))
                words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
                if rng.random() < 0.3:
                    words[rng.randrange(n)] = 99
            texts.append(words)
        got = periodic.runs_of([np.array(w, np.int64) for w in texts], least, power)
        assert got == [brute_runs(w, least, power) for w in texts]


def test_very_long_repetitions():
    one = np.zeros(200_000, np.int64)
    pair = np.tile(np.arange(1000), 150)
    assert periodic.runs_of([one, pair]) == [[(0, 200_000, 1)], [(0, 150_000, 1000)]]


def test_query_equals_brute_force(spark, make_docs, awkward, rows):
    rng = random.Random(3)
    docs = [(i, t) for i, t in awkward if i != 6]  # brute force takes too long for the longest one
    docs += [(i, " ".join(rng.choice("ab" if i % 3 else "abcdefgh") for _ in range(rng.randrange(120))))
                      for i in range(100, 220)]
    docs += [(7, "x " * 30), (8, "a b\tc\n" * 9 + "end"), (20, "wide space " * 8), (30, "A a A a A a A a")]
    got = rows(periodic.periodic_query(make_docs(docs)))
    assert got == sorted((brute_row(i, t) for i, t in docs), key=str)
    assert periodic.periodic_query(make_docs([])).count() == 0


def test_given_documents(spark, rows):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    short = [(r["doc_id"], r["text"]) for r in docs.collect() if len(r["text"] or "") < 6000]
    want = {i: brute_row(i, t) for i, t in short}
    got = {r["doc_id"]: tuple(r) for r in periodic.periodic_query(docs).collect()}
    assert len(want) > 150 and all(got[i] == row for i, row in want.items())
    assert sum(row[1] for row in want.values()) > 10


def test_operator_gives_texts_without_repetitions(make_docs):
    got = periodic.with_runs(make_docs([(1, "so " + "la li " * 5 + "end"), (2, None)])).orderBy("doc_id").collect()
    assert [tuple(r) for r in got[0]["runs"]] == [(1, 10, 2)]
    assert got[0]["collapsed"] == "so la li end" and got[0]["n_words"] == 12
    assert got[1]["collapsed"] == "" and got[1]["runs"] == [] and got[1]["n_words"] == 0
