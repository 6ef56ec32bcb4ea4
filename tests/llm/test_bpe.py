"""Encoding against the tokenizers library, and exact round trips."""

import random
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pulse.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def wanted(library, key, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return key, len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(back.encode()).hexdigest()


def test_tree_concatenation_is_exact(library):
    encoder, rng = bpe.ByteEncoder(PATH), random.Random(1)
    kinds = ["ab", "a", "abc", "etaoin shrdlu", "abcdefghijklmnopqrstuvwxyz", " \n\ta", "é中字🙂a", "!'s.,-=a "]
    for _ in range(1500):
        kind = rng.choice(kinds)
        text = "".join(rng.choice(kind) for _ in range(rng.randrange(400)))
        if rng.random() < 0.1:
            text += "<|endoftext|>" + text
        ids = library.encode(text, add_special_tokens=False).ids
        for long, leaf in ((bpe.LONG, bpe.LEAF), (50, 16), (20, 5)):
            units = [(j, encoder.encode_unit(j, u)) for j, u in encoder.units(text, long, leaf)]
            assert encoder.together(units) == ids
        assert encoder.decode(ids) == text


def test_query_matches_the_library(make_docs, awkward, library):
    rng = random.Random(2)
    rows = [*awkward, (30, "".join(rng.choice("abcdefghij") for _ in range(200_000))), (31, "one <|endoftext|> two"),
            (32, "word, and  more\n" * 9_000), (32, "word, and  more\n" * 9_000)]
    got = bpe.encoded(make_docs(rows), PATH).collect()
    assert sorted(map(tuple, got), key=str) == sorted((wanted(library, k, t) for k, t in rows), key=str)
    assert bpe.encoded(make_docs([]), PATH).count() == 0
