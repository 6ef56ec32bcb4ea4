"""Sentence, token and clean-text expressions. No Python runs per row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTENCE_BREAK = r"[.!?]+\s+"
TOKEN_BREAK = r"[^\p{L}\p{N}]+"
NOT_LETTER = "[^A-Za-z]"

# Common English words left out of word tables.
STOP_WORDS = (
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are",
    "as", "at", "be", "because", "been", "before", "being", "below", "between", "both", "but",
    "by", "can", "could", "did", "do", "does", "doing", "down", "during", "each", "few", "for",
    "from", "further", "had", "has", "have", "having", "he", "her", "here", "hers", "herself",
    "him", "himself", "his", "how", "i", "if", "in", "into", "is", "it", "its", "itself", "just",
    "me", "more", "most", "my", "myself", "no", "nor", "not", "now", "of", "off", "on", "once",
    "only", "or", "other", "our", "ours", "ourselves", "out", "over", "own", "same", "she",
    "should", "so", "some", "such", "than", "that", "the", "their", "theirs", "them",
    "themselves", "then", "there", "these", "they", "this", "those", "through", "to", "too",
    "under", "until", "up", "very", "was", "we", "were", "what", "when", "where", "which",
    "while", "who", "whom", "why", "will", "with", "would", "you", "your", "yours", "yourself",
    "yourselves",
)

# Markup and notices that carry no opinion.
EMOTE_MARKUP = r"!\[img\]\(emote\|t5_2th52\|\d+\)"
SHORT_POST_NOTICE = (
    "I am a bot from /r/wallstreetbets. Your submission was removed because was too short. "
    "Please make it a comment if it's not worth expounding on."
)
NOTICE_PATTERNS = (
    r"\*\*PLEASE READ THIS MESSAGE IN ITS ENTIRETY BEFORE TAKING ACTION\.\*\*",
    r"This submission has been automatically removed",
    r"I am a bot, and this action was performed automatically",
)


def sentences(text: Column) -> Column:
    """Sentences as an array; NULL text gives NULL."""
    return F.filter(F.split(text, SENTENCE_BREAK), lambda s: F.trim(s) != "")


def tokens(text: Column, pattern: str = TOKEN_BREAK) -> Column:
    """Words as an array, split on runs of ``pattern``."""
    return F.filter(F.split(text, pattern), lambda t: t != "")


def without(words: Column, stop: Sequence[str] = STOP_WORDS) -> Column:
    """Drop stop words whatever their case; repeats of other words stay."""
    return F.filter(words, lambda t: ~F.lower(t).isin(*stop)) if stop else words


def normalise(words: Column) -> Column:
    """Keep ASCII letters, lower-case them and drop words with none left."""
    return F.filter(
        F.transform(words, lambda t: F.lower(F.regexp_replace(t, NOT_LETTER, ""))),
        lambda t: t != "",
    )


def joined(words: Column, separator: str = " ") -> Column:
    return F.concat_ws(separator, words)


def clean_tokens(text: Column, stop: Sequence[str] = STOP_WORDS,
                 lemmas: Mapping[str, str] | None = None) -> Column:
    """The token, stop-word, lemma and normalising steps, with fewer passes over each word.

    ``lemmas`` maps lower-case words to their lemmas before normalising, inside the
    row; longer dictionaries belong in :func:`pulse.operators.terms.lemmatise`.

    The same result as ``normalise(without(tokens(text), stop))``: letters and
    digits outside A-Z become the digit 0 for the whole text at once, words are
    told apart and compared with the stop words while they still carry that mark,
    and only then is it removed. Sentence breaks are word breaks as well, so the
    sentence step cannot change the result.
    """
    marked = F.lower(F.regexp_replace(text, r"[\p{L}\p{N}&&[^A-Za-z]]+", "0"))
    kept = F.filter(F.split(marked, "[^a-z0]+"), lambda t: ~t.isin("", *stop))
    if lemmas:
        table = F.create_map(*[F.lit(x) for pair in lemmas.items() for x in pair])
        kept = F.transform(kept, lambda t: F.lower(F.coalesce(F.try_element_at(table, t), t)))
    bare = F.transform(kept, lambda t: F.replace(t, F.lit("0"), F.lit("")))
    return F.filter(bare, lambda t: t != "")


def strip_markup(text: Column, pattern: str = EMOTE_MARKUP) -> Column:
    return F.regexp_replace(text, pattern, "")
