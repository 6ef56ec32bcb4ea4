"""Secret patterns against their definition, and the token-efficiency test."""

import random
import re
from hashlib import sha256

import public_tokenizers

from pulse.llm import secrets

ASSIGN = re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def brute(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
    return sorted(found)


def test_base_spans(make_docs, awkward):
    rng = random.Random(7)
    parts = ["password", "Secret", "tokEn", "api_key", "apikey", " = ", ": ", '"', "=", "abcdef0123456789", "AKIA",
             "AKIAABCDEFGHIJKLMN", "ſecret", "Key", "abc", "é🙂", " ", "0123456789abcdefG", "xyzxyzxyzxyz", "\n"]
    rows = [(i + 100, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 12)))) for i in range(500)] + awkward
    got = secrets.secrets(make_docs(rows), PATH).collect()
    wanted = []
    for key, text in rows:
        spans = brute(text)
        named = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        wanted.append((key, *[sum(s[1] == k for s in spans) for k in range(3)], sha256(named.encode()).hexdigest()))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(wanted, key=str)
    assert secrets.secrets(make_docs([]), PATH).count() == 0


def test_random_strings_are_told_from_words_and_identifiers():
    count = secrets.token_counter(PATH)

    def random_spans(text):
        return [text[a:b] for a, k, b in secrets.secret_spans(text, count) if secrets.KINDS[k] == "random"]

    key = "Zq8Xv2Lr9TfWb4KpNs7YhJ3c"
    assert random_spans(f"use {key} here") == [key]
    assert random_spans("an internationalisation-framework 2ndConfigurationManagerFactory") == []
    assert random_spans("D41D8CD98F00B204E9800998ECF8427E 123e4567-e89b-12d3-a456-426614174000") == []
    assert random_spans("2024-01-01-2024-12-31-2025 " + "a" * 40) == []
