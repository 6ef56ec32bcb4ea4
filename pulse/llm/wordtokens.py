"""Token ids of texts under a word-level byte-pair vocabulary file of the tokenizers library.

White space never enters a token and no rule of the vocabulary looks across it,
so a text is encoded word by word and words met lately are taken from a memory
of bounded size: once half of it is full, the other half goes, but for words that
are met again. A new word of plain Latin characters is normalised and split
here by the vocabulary's own rules and merged by tiktoken: its rank table
holds each token's bytes, with one byte that never occurs in UTF-8 as the
end-of-word mark. Lowest rank first, leftmost first, is the order of the
library as well, and inside a token's span there is one such order only, so both
give the same ids. Words with other scripts or special tokens, and texts with the
four separator controls that only Python counts as white space, go through the
library itself.
"""

from __future__ import annotations

import json
import re
import sys
from array import array

import regex
import tiktoken
from tokenizers import Tokenizer

#: Words remembered by a task's process; each takes some 250 bytes.
MEMORY = 120_000

_END = b"\xff"
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_ODD_SPACE = re.compile(r"[\x1c-\x1f]")
#: ASCII and Latin letters up to U+024F, with none of the characters of the special tokens.
_PLAIN = re.compile(r"[!-;=?-{}~¡-ɏ]*")


def byte_letters() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for the 256 bytes."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class WordEncoder:
    """Encodes texts to the bytes of their ids, little-endian unsigned 32-bit."""

    def __init__(self, path: str, memory: int = MEMORY):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = {t["content"] for t in spec["added_tokens"]}
        letters, ranks = byte_letters(), {}
        for token, rank in spec["model"]["vocab"].items():
            if token not in special:
                ended = token.endswith("</w>")
                core = bytes(letters[c] for c in (token[:-4] if ended else token))
                ranks[core + _END if ended else core] = rank
        merges = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})
        self._merge = merges._core_bpe.encode_single_piece
        # Two halves: words met lately, and words met before these.
        self._memory, self._older, self._pieces, self._most = {}, {}, {}, max(1, memory // 2)

    def _merged(self, piece: str) -> bytes:
        return array("I", self._merge(piece.encode() + _END)).tobytes()

    def _piece(self, piece: str) -> bytes:
        known = self._pieces.get(piece)
        if known is None:
            known = self._merged(piece)
            if len(self._pieces) >= self._most:
                self._pieces.clear()
            self._pieces[piece] = known
        return known

    def _word(self, word: str) -> bytes:
        if not _PLAIN.fullmatch(word):
            return self._whole(word)
        low = word.lower()  # of these characters none composes with another or is lowered by its place
        if low.isalpha():
            return self._merged(low)
        if low[:-1].isalpha():  # one mark or digit behind a word
            return self._merged(low[:-1]) + self._piece(low[-1])
        return b"".join(map(self._piece, _SPLIT.findall(low)))

    def _whole(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _ODD_SPACE.search(text):
            return self._whole(text)
        words, memory = text.split(), self._memory
        try:
            return b"".join([memory[w] for w in words])
        except KeyError:
            new = {w for w in words if w not in memory}
            if len(memory) + len(new) > self._most:
                self._older, self._memory = memory, {}
                memory, new = self._memory, set(words)
            older = self._older
            for word in new:
                known = older.get(word)
                memory[word] = self._word(word) if known is None else known
            return b"".join([memory[w] for w in words])


def worker_encoder(path: str) -> WordEncoder:
    """The encoder of this worker process, kept for the tasks to come."""
    kept = vars(sys).setdefault("_word_encoders", {})
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]
