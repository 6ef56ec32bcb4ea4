"""Byte-level BPE encoding and decoding, with tree concatenation for long unsplit text.

A text of up to ``LONG`` characters is encoded where it is read. A longer one is
cut into units that are encoded in parallel and put together again:

* Cuts go before a space between two other characters, or else between two
  pieces of the vocabulary's own splitting rule; such units are independent.
* A single piece of more than ``LEAF`` bytes, a text that no rule splits, is
  halved until its parts are short. Parts are encoded alone and joined pairwise
  up the tree. At a join the last k tokens on the left and the first k on the right
  are encoded anew as one string, k doubling until the result keeps the
  outermost token on both sides. Every two neighbours are then tokens that stay
  apart when encoded together, which holds for the encoding of the whole string
  and for no other sequence, so the join is exact.

Ids equal those of the tokenizers library: ranks come from its vocabulary file,
special tokens inside a text have their own ids. Decoding concatenates the bytes
of the ids.

Null and empty texts have no ids. Rows with equal doc_id and text are encoded
once when long and returned as often as they occur.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.llm.wordtokens import byte_letters

LONG = 65_536
LEAF = 4_096
#: The splitting rule of the vocabulary (fixed value).
RULE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

Merge = Callable[[bytes], list[int]]


def join_tokens(left: list[int], right: list[int], merge: Merge, of: Callable[[list[int]], bytes]) -> list[int]:
    """Tokens of two neighbouring strings put together, from the tokens of each."""
    if not left or not right:
        return left + right
    k = 2
    while True:
        window = merge(of(left[-k:] + right[:k]))
        if (k >= len(left) or window[0] == left[-k]) and (k >= len(right) or window[-1] == right[k - 1]):
            return left[:-k] + window + right[k:]
        k *= 2


def tree(parts: list[list[int]], merge: Merge, of: Callable[[list[int]], bytes]) -> list[int]:
    """Join neighbouring parts pairwise until one is left."""
    while len(parts) > 1:
        parts = [join_tokens(parts[i], parts[i + 1], merge, of) if i + 1 < len(parts) else parts[i]
                 for i in range(0, len(parts), 2)]
    return parts[0] if parts else []


class ByteEncoder:
    """A byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): rank
                 for token, rank in spec["model"]["vocab"].items() if token not in self.special}
        self._encoding = tiktoken.Encoding("bytes", pat_str=RULE, mergeable_ranks=ranks, special_tokens=self.special)
        self.merge: Merge = self._encoding._core_bpe.encode_single_piece
        self.bytes_of = self._encoding.decode_bytes
        self._rule = regex.compile(RULE)
        self._apart = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")

    def encode(self, text: str) -> list[int]:
        return self._encoding.encode(text, allowed_special="all")

    def decode(self, ids: list[int]) -> str:
        return self.bytes_of(ids).decode("utf-8", "replace")

    def units(self, text: str, long: int = LONG, leaf: int = LEAF) -> Iterator[tuple[bool, bytes]]:
        """(joined, UTF-8 bytes): units of a text; a joined one continues the piece before it."""
        start = 0
        for mark in self._apart.finditer(text):
            yield from self._plain_units(text[start:mark.start()], long, leaf)
            yield False, mark.group().encode()
            start = mark.end()
        yield from self._plain_units(text[start:], long, leaf)

    def _plain_units(self, text: str, long: int, leaf: int) -> Iterator[tuple[bool, bytes]]:
        start = 0
        while len(text) - start > long:
            cut = text.rfind(" ", start + 1, start + long - 1)
            while cut > start and (text[cut - 1].isspace() or text[cut + 1].isspace()):
                cut = text.rfind(" ", start + 1, cut)
            if cut <= start:
                start = yield from self._pieces(text, start, long, leaf)
                continue
            yield False, text[start:cut].encode()
            start = cut
        if start < len(text):
            yield from self._short(text[start:], leaf)

    def _pieces(self, text: str, start: int, long: int, leaf: int) -> Iterator[tuple[bool, bytes]]:
        """Units of a stretch without a usable space, piece by piece; returns where it ends."""
        begin, blanks = start, []
        for piece in self._rule.finditer(text, start):
            if piece.end() - piece.start() > leaf:
                yield from self._before(text, begin, piece.start(), blanks)
                yield from self._leaves(piece.group().encode(), leaf)
                return piece.end()
            solid = not text[piece.end() - 1].isspace()
            blanks = [] if solid else [*blanks, piece.group()]
            if solid and piece.end() - begin >= long // 2 and not text[piece.end():piece.end() + 1].isspace():
                yield False, text[begin:piece.end()].encode()
                return piece.end()
        yield False, text[begin:].encode()
        return len(text)

    def _short(self, text: str, leaf: int) -> Iterator[tuple[bool, bytes]]:
        """The last unit, with overlong pieces taken out."""
        begin, blanks = 0, []
        for piece in self._rule.finditer(text) if len(text) > leaf else ():
            if piece.end() - piece.start() > leaf:
                yield from self._before(text, begin, piece.start(), blanks)
                yield from self._leaves(piece.group().encode(), leaf)
                begin, blanks = piece.end(), []
            else:
                blanks = [] if not text[piece.end() - 1].isspace() else [*blanks, piece.group()]
        if begin < len(text):
            yield False, text[begin:].encode()

    @staticmethod
    def _before(text: str, begin: int, end: int, blanks: list[str]) -> Iterator[tuple[bool, bytes]]:
        """What stands before an overlong piece; blank pieces at its end depend on what follows, so each goes alone."""
        solid = end - sum(map(len, blanks))
        if solid > begin:
            yield False, text[begin:solid].encode()
        for blank in blanks:
            yield True, blank.encode()
            yield False, b""

    @staticmethod
    def _leaves(piece: bytes, leaf: int) -> Iterator[tuple[bool, bytes]]:
        """A piece halved until its parts are at most ``leaf`` bytes; cuts may fall inside a character."""
        parts = 1 << max(0, (len(piece) - 1) // leaf).bit_length()
        edges = [len(piece) * i // parts for i in range(parts + 1)]
        for i in range(parts):
            # The first part carries the mark as well: a lone leaf is raw bytes, not text.
            yield True, piece[edges[i]:edges[i + 1]]
        yield False, b""

    def encode_unit(self, joined: bool, unit: bytes) -> list[int]:
        return self.merge(unit) if joined and unit else self.encode(unit.decode())

    def together(self, units: list[tuple[bool, list[int]]]) -> list[int]:
        """The ids of a text from those of its units; an empty unit ends a run of leaves."""
        ids: list[int] = []
        run: list[list[int]] = []
        for joined, part in units:
            if joined:
                run.append(part)
                continue
            if run:
                ids += tree(run, self.merge, self.bytes_of)
                run = []
            ids += part
        return ids + tree(run, self.merge, self.bytes_of)


def worker_encoder(path: str) -> ByteEncoder:
    """The encoder of this worker process, kept for the tasks to come."""
    kept = vars(sys).setdefault("_byte_encoders", {})
    if path not in kept:
        kept[path] = ByteEncoder(path)
    return kept[path]


def _digests(encoder: ByteEncoder, ids: list[int]) -> tuple[int, str, str]:
    return (len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            sha256(encoder.decode(ids).encode()).hexdigest())


_RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _result(doc_ids: pa.Array, found: list[tuple[int, str, str]]) -> pa.RecordBatch:
    n, ids, decoded = zip(*found, strict=True) if found else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [doc_ids, pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encoded(docs: DataFrame, vocabulary: str, long: int = LONG, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded text, for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary)
        for batch in batches:
            yield _result(batch["doc_id"], [
                _digests(encoder, encoder.together([(j, encoder.encode_unit(j, u)) for j, u in encoder.units(
                    text.as_py(), long, leaf)])) for text in batch["text"]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary)
        for batch in batches:
            for row, text in enumerate(batch["text"]):
                text = text.as_py()
                units = list(encoder.units(text, long, leaf))
                yield pa.RecordBatch.from_arrays([
                    batch["doc_id"].take(pa.array([row] * len(units), pa.int64())),
                    pa.array([sha256(text.encode()).digest()] * len(units), pa.binary()),
                    pa.array(range(len(units)), pa.int32()), pa.array([j for j, _ in units], pa.bool_()),
                    pa.array([u for _, u in units], pa.binary())], ["doc_id", "key", "seq", "joined", "unit"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary)
        for batch in batches:
            ids = [np.array(encoder.encode_unit(j.as_py(), u.as_py()), "<u4").tobytes()
                   for j, u in zip(batch["joined"], batch["unit"], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch[c] for c in ("doc_id", "key", "seq", "joined")] + [pa.array(ids, pa.binary())],
                ["doc_id", "key", "seq", "joined", "ids"])

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary)
        for batch in batches:
            yield _result(batch["doc_id"], [
                _digests(encoder, encoder.together([(u["joined"], np.frombuffer(u["ids"], "<u4").tolist()) for u in units.as_py()]))
                for units in batch["units"]])

    short = texts.where(F.char_length("text") <= long).mapInArrow(in_place, f"doc_id {kind}, {_RESULT}")
    units = texts.where(F.char_length("text") > long).mapInArrow(
        cut, f"doc_id {kind}, key binary, seq int, joined boolean, unit binary")
    spread = units.repartition("key", "seq").mapInArrow(
        encode, f"doc_id {kind}, key binary, seq int, joined boolean, ids binary")
    # The ids of one text, no more than the text itself; repeated rows are counted and return at the end.
    whole = spread.groupBy("doc_id", "key").agg(
        F.array_sort(F.collect_set(F.struct("seq", "joined", "ids"))).alias("units"),
        F.count_if(F.col("seq") == 0).alias("times"))
    long_ones = whole.select("doc_id", "units", F.explode(F.sequence(F.lit(1), "times"))).drop("col").mapInArrow(
        put_together, f"doc_id {kind}, {_RESULT}")
    return short.union(long_ones)
