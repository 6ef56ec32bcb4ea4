"""Word encoding against the library; packings are complete, gapless and near the bound."""

import random
import tracemalloc
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from pulse.llm import packing
from pulse.llm.wordtokens import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_word_encoder_matches_the_library():
    encoder, library, rng = WordEncoder(PATH, memory=50), Tokenizer.from_file(PATH), random.Random(1)
    letters = "abcde'sStT<|>endoftext .,!?09éÈßüñ́ΣςÀİ中文🙂‍\x1c\x85 \t\n'lld_-"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        if rng.random() < 0.1:
            text += "<|endoftext|>" + text
        assert encoder.encode(text) == ids_of(library, text)


def test_every_plain_character_is_encoded_as_by_the_library():
    encoder, library = WordEncoder(PATH), Tokenizer.from_file(PATH)
    for c in map(chr, range(0x21, 0x250)):
        for word in (c, f"a{c}", f"{c}a", f"Aa{c}", f"a{c}a", c + c, f"É{c}", f"'{c}", f"{c}9"):
            assert encoder.encode(word) == ids_of(library, word), word


def test_word_memory_is_bounded_and_keeps_common_words():
    encoder, asked = WordEncoder(PATH, memory=100), []
    word = encoder._word
    encoder._word = lambda w: asked.append(w) or word(w)
    for i in range(1000):
        encoder.encode(f"common new{i} other{i}")
    assert asked.count("common") == 1
    assert len(asked) == 2001

    encoder, letters = WordEncoder(PATH), str.maketrans("0123456789", "ghijklmnop")
    tracemalloc.start()
    for i in range(300):
        encoder.encode(" ".join(f"{k:x}".translate(letters) for k in range(1000 * i, 1000 * i + 1000)))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 50e6


def check(rows, capacity):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_query(make_docs, awkward):
    library = Tokenizer.from_file(PATH)
    got = packing.packed(make_docs(awkward), PATH).collect()
    n = check(got, packing.CAPACITY)
    wanted = []
    for key, text in awkward:
        ids = ids_of(library, text) + (1).to_bytes(4, "little")
        for piece, start in enumerate(range(0, len(ids) // 4, packing.CAPACITY)):
            part = ids[4 * start:4 * (start + packing.CAPACITY)]
            wanted.append((key, piece, start, len(part) // 4, crc32(part)))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(wanted, key=str)
    assert n == -(-sum(w[3] for w in wanted) // packing.CAPACITY)
    assert packing.packed(make_docs([]), PATH).count() == 0


def test_plan_uses_every_piece_once_and_few_sequences():
    rng = random.Random(3)
    for capacity, sizes in ((100, [rng.randrange(1, 101) for _ in range(3000)]),
                            (4096, [int(rng.paretovariate(1.1) * 200) % 4096 + 1 for _ in range(4000)]),
                            (10, [6] * 50 + [4] * 50), (10, [3] * 7), (12, [5, 5, 5, 7, 7])):
        histogram = Counter(sizes)
        plan = packing.packing_plan(dict(histogram), capacity)
        used = Counter()
        for pattern, times in plan:
            assert sum(pattern) <= capacity and times > 0
            for x in pattern:
                used[x] += times
        assert used == histogram
        bound = max(-(-sum(sizes) // capacity), sum(x > capacity / 2 for x in sizes))
        assert sum(t for _, t in plan) <= bound * 1.02 + 1


def test_plan_size_does_not_grow_with_the_corpus():
    histogram = {x: 5 + x % 7 for x in range(1, 400)}
    small = packing.packing_plan(histogram, 400)
    large = packing.packing_plan({x: n * 100_000 for x, n in histogram.items()}, 400)
    assert len(large) < 20 * len(small)
    assert sum(t for _, t in large) <= 1.01 * sum(x * n for x, n in histogram.items()) * 100_000 / 400


def test_ranks_are_complete_within_each_length(spark):
    frame = spark.createDataFrame([(i % 7, 0, 0, 5 if i % 3 else i, i % 4) for i in range(500)],
                                  "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = defaultdict(list)
    for r in packing.ranked(frame, 500).collect():
        got[r["length"]].append(r["rank"])
    assert all(sorted(ranks) == list(range(len(ranks))) for ranks in got.values())
