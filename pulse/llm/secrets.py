"""Secrets: patterns, and random strings told by their token efficiency.

Base spans are assignments to a credential's name, access keys and long hex
strings, each kind leftmost and non-overlapping, offsets in code points.

A BPE vocabulary packs several characters of ordinary words or numbers into a
token; random strings fall apart. Candidates are runs of at least ``LEAST``
characters of a key alphabet that mix character classes; those with fewer than
``RATIO`` characters to a token become spans of kind ``random``. Left out before
the test are strings that are random by nature and no secrets: digests of the
usual lengths in hex (a digest that the base patterns match stays a span), UUIDs,
numbers and dates, and runs that a path or a mail address continues.

Null and empty texts have no spans; repeated rows have the same spans.
"""

from __future__ import annotations

import base64
import re
import sys
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

RATIO, LEAST = 2.0, 20
KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(
    r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_=.@-])[A-Za-z0-9+/_=-]{{{LEAST},}}(?![A-Za-z0-9+/_=@-]|\.[A-Za-z0-9])")
#: Hex digests by length: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512 (fixed values).
_DIGESTS = frozenset((32, 40, 56, 64, 96, 128))
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_HEXADECIMAL = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_CLASSES = (re.compile("[a-z]"), re.compile("[A-Z]"), re.compile("[0-9]"))


def token_counter(path: str):
    """Number of tokens of a string under a tiktoken vocabulary file; kept by the worker process."""
    kept = vars(sys).setdefault("_token_counters", {})
    if path not in kept:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        pieces = tiktoken.Encoding("count", pat_str=r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+|\s+", mergeable_ranks=ranks,
                                   special_tokens={})
        kept[path] = lambda text: len(pieces.encode_ordinary(text))
    return kept[path]


def known_identifier(text: str) -> bool:
    """Strings that look random but are digests, UUIDs or mere numbers."""
    if _HEXADECIMAL.fullmatch(text) and len(text) in _DIGESTS or _UUID.fullmatch(text):
        return True
    return sum(c.search(text) is not None for c in _CLASSES) < 2


def secret_spans(text: str, count) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    for m in _CANDIDATE.finditer(text):
        if not known_identifier(m.group()) and len(m.group()) < RATIO * count(m.group()):
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{stop}" for start, kind, stop in spans)


def secrets(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Counts and hash of the base spans, and all spans, per row."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(vocabulary)
        for batch in batches:
            found = [secret_spans(text.as_py() or "", count) for text in batch["text"]]
            base = [[s for s in spans if s[1] < 3] for spans in found]
            counts = [pa.array([sum(s[1] == k for s in spans) for spans in base], pa.int64()) for k in range(3)]
            hashes = pa.array([sha256(_joined(spans).encode()).hexdigest() for spans in base], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *counts, hashes, pa.array(map(_joined, found), pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
