"""Keyword and topic flags."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word lists of the published keyword and topic tables.
KEYWORD_STEMS = {
    "labor": ("wage", "salary", "employ", "unemploy", "job", "labor", "labour"),
    "yolo": ("yolo", "all in", "life saving", "leverage"),
    "btd": ("btd", "btfd"),
}
CHARACTER_PATTERNS = {"dollar": r"\$", "ellipsis": r"\.{3}"}
TOPIC_WORDS = (
    "covid", "coronavirus", "vaccine", "pandemic", "mask", "quarantine", "restriction",
)


def stem_pattern(stems: Sequence[str]) -> str:
    """Any of the stems at the start of a word, ignoring case.

    A stem matches longer words ("employ" hits "employment"). Word boundaries
    next to letters outside ASCII differ between regex engines, so such stems
    are refused.
    """
    for stem in stems:
        if not re.match(r"[A-Za-z]", stem):
            raise ValueError(f"a keyword stem must begin with an ASCII letter: {stem!r}")
    return r"(?i)\b(?:" + "|".join(re.escape(s) for s in stems) + ")"


def word_pattern(words: Sequence[str]) -> str:
    """Any of the words anywhere in the text, ignoring case."""
    return "(?i)" + "|".join(re.escape(w) for w in words)


def keyword_flag(text: Column, stems: Sequence[str]) -> Column:
    return text.rlike(stem_pattern(stems))


def topic_flag(text: Column, words: Sequence[str] = TOPIC_WORDS) -> Column:
    return text.rlike(word_pattern(words))


def keyword_columns(text: Column, stems: Mapping[str, Sequence[str]] = KEYWORD_STEMS,
                    patterns: Mapping[str, str] = CHARACTER_PATTERNS) -> dict[str, Column]:
    """All flags at once, for a single ``withColumns``."""
    flags = {name: text.rlike(pattern) for name, pattern in patterns.items()}
    flags.update({name: keyword_flag(text, words) for name, words in stems.items()})
    return flags


def overlaps_any(tokens: Column, words: Sequence[str]) -> Column:
    """Whether a token array holds any of the listed words."""
    return F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words]))
