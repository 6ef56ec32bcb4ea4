"""Toxicity scores by weak supervision.

1. Voters. The terms (words and word beginnings) that mark toxic texts best on
   a bounded sample of labelled rows are dealt over ``LEXICONS`` lexicons; a
   lexicon votes "toxic" on a text that holds one of its terms and abstains
   otherwise. Pattern voters look at capitals, exclamation marks, symbols and
   repeated letters.
2. Label model. A generative model with one hidden class per text gives each
   voter a rate of firing on toxic and on clean texts, fitted by expectation
   maximisation on the votes. Labelled rows enter as a prior on the rates, worth
   ``PRIOR_ROWS`` rows. Voters that still agree once the hidden class is known are
   correlated: a voter's evidence is divided by one plus its correlations.
3. Classifier. A logistic regression over single terms and patterns is trained
   on the posterior labels, not on the given ones.

Only rows whose crc32(doc_id) mod 4 is not 2 are ever looked at for training,
at most ``SAMPLE`` of them, taken by a hash of the id: this bounds what reaches
the driver (vote lists of the sample, ``TERMS`` term counts). Scores are
computed for every row from its text alone.

Null and empty texts have no term and get the score of a text without evidence.
Without labels, or with one class only, every score is 0. Repeated rows score alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.llm.common import staged

SAMPLE = 20_000
TERMS = 1_000
#: Rows whose terms are counted together.
COUNTED_ROWS = 1_000
LEXICONS = 24
PRIOR_ROWS = 200
THRESHOLD = 0.3
#: Lengths of the word beginnings used as terms, besides whole words.
STEMS = (3, 4, 5, 6)
#: Least log-likelihood gain of a term, some four standard errors.
LEAST_GAIN = 8.0

_WORD = re.compile(r"[^\W\d_]+")
PATTERNS = (
    ("capitals", re.compile(r"\b[A-Z]{3,}\b(?:\W+[A-Z]{3,}\b){2}")),
    ("exclaims", re.compile(r"[!?]{2,}")),
    ("masked", re.compile(r"\b[A-Za-z]+[*@#$]{1,4}[A-Za-z]+\b")),
    ("stretched", re.compile(r"([A-Za-z])\1{3}")),
)


def terms_of(text: str | None) -> set[str]:
    """Different lower-case words (``=word``) and their beginnings of a text."""
    words = set(_WORD.findall((text or "").lower()))
    found = {f"={w}" for w in words}
    for n in STEMS:
        found.update(w[:n] for w in words if len(w) >= n)
    return found


def patterns_of(text: str | None) -> list[bool]:
    return [p.search(text or "") is not None for _, p in PATTERNS]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """Texts and labels of at most ``bound`` labelled rows that are not held out."""
    key = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(key, "doc_id").limit(bound)
    )
    # At most `bound` rows of two numbers: small enough to be sent to every executor.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic, clean = Counter(), Counter()
        for text, label in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
            (toxic if label else clean).update(terms_of(text))
        names = list(toxic.keys() | clean.keys())
        yield pa.RecordBatch.from_pydict({
            "term": pa.array(names, pa.string()),
            "toxic": pa.array([toxic[n] for n in names], pa.int64()),
            "clean": pa.array([clean[n] for n in names], pa.int64()),
        })


def toxic_terms(sample: DataFrame, n_toxic: int, n_clean: int, bound: int = TERMS) -> list[str]:
    """The terms that mark toxic texts best by log-likelihood ratio, on the sample."""
    counts = sample.mapInArrow(_term_counts, "term string, toxic long, clean long").groupBy("term").agg(
        F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    share_t, share_c = n_toxic / (n_toxic + n_clean), n_clean / (n_toxic + n_clean)
    total = F.col("t") + F.col("c")
    gain = F.col("t") * F.log(F.col("t") / (total * share_t)) + F.when(
        F.col("c") > 0, F.col("c") * F.log(F.col("c") / (total * share_c))).otherwise(0.0)
    marked = counts.where("t > 0").withColumn("gain", gain).where(
        (F.col("gain") >= LEAST_GAIN) & (F.col("t") > 4 * F.col("c")))
    return [r["term"] for r in marked.orderBy(F.desc("gain"), "term").limit(bound).collect()]


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Posterior probability of the hidden class "toxic" for each row of 0/1 votes."""
    share = labels.mean()
    weight = PRIOR_ROWS / len(labels)
    prior_fired = [weight * votes[labels == k].sum(axis=0) for k in (0, 1)]
    prior_rows = [weight * (labels == k).sum() for k in (0, 1)]
    rates = [(prior_fired[k] + 0.01) / (prior_rows[k] + 1.0) for k in (0, 1)]
    discount = np.ones(votes.shape[1])
    posterior = np.full(len(votes), share)
    for _ in range(rounds):
        fired = np.log(rates[1] / rates[0]) * discount
        silent = np.log((1 - rates[1]) / (1 - rates[0])) * discount
        odds = np.log(share / (1 - share)) + votes @ fired + (1 - votes) @ silent
        posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        for k, belief in ((0, 1 - posterior), (1, posterior)):
            rates[k] = (belief @ votes + prior_fired[k] + 0.01) / (belief.sum() + prior_rows[k] + 1.0)
            rates[k] = np.clip(rates[k], 1e-5, 1 - 1e-5)
        rest = votes - np.outer(posterior, rates[1]) - np.outer(1 - posterior, rates[0])
        spread = np.sqrt((rest ** 2).mean(axis=0)) + 1e-9
        related = np.abs(rest.T @ rest / len(rest) / np.outer(spread, spread))
        np.fill_diagonal(related, 0)
        discount = 1 / (1 + np.where(related > 0.1, related, 0).sum(axis=0))
    return posterior


def logistic(rows: np.ndarray, cols: np.ndarray, n_rows: int, n_cols: int, target: np.ndarray,
             penalty: float = 1e-4, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias on sparse 0/1 features and soft targets (accelerated gradient steps)."""
    width = max(1.0, np.bincount(rows, minlength=n_rows).mean())
    weights, bias = np.zeros(n_cols), float(np.log(target.mean() / (1 - target.mean())))
    speed, speed_bias = np.zeros(n_cols), 0.0
    scale = 1 / np.sqrt(np.bincount(cols, minlength=n_cols) / n_rows + 1e-3)
    rate = 1.0 / width
    for _ in range(rounds):
        odds = bias + np.bincount(rows, weights=weights[cols], minlength=n_rows)
        error = 1 / (1 + np.exp(-np.clip(odds, -30, 30))) - target
        slope = np.bincount(cols, weights=error[rows], minlength=n_cols) / n_rows * scale + penalty * weights
        speed = 0.9 * speed - rate * slope * scale
        speed_bias = 0.9 * speed_bias - rate * error.mean()
        weights, bias = weights + speed, bias + speed_bias
    return weights, bias


class ToxicityModel:
    """Weights of terms and patterns; with no weights every score is 0."""

    def __init__(self, weights: dict[str, float], patterns: list[float], bias: float):
        self.weights, self.patterns, self.bias = weights, patterns, bias

    def score(self, text: str | None) -> float:
        if not self.weights:
            return 0.0
        get = self.weights.get
        odds = self.bias + sum(get(term, 0.0) for term in terms_of(text))
        odds += sum(w for w, fired in zip(self.patterns, patterns_of(text), strict=True) if fired)
        return float(1 / (1 + np.exp(-min(max(odds, -700.0), 700.0))))

    def column(self, text: str = "text") -> Column:
        score = self.score

        @F.pandas_udf("double")
        def scored(texts: pd.Series) -> pd.Series:
            return pd.Series([score(t) for t in texts], dtype="float64")

        return scored(F.col(text))


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> ToxicityModel:
    """Fit voters, label model and classifier on a bounded sample of labelled rows."""
    sample = staged(training_sample(docs, labels, bound), "toxicity-sample")
    n, n_toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    names = toxic_terms(sample, n_toxic, n - n_toxic) if 0 < n_toxic < n else []
    if not names:
        return ToxicityModel({}, [0.0] * len(PATTERNS), 0.0)
    number = {name: i for i, name in enumerate(names)}

    def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            found = [sorted(number[t] for t in terms_of(text) & number.keys())
                     + [len(number) + i for i, fired in enumerate(patterns_of(text)) if fired] for text in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.list_(pa.int32())), batch["toxic"]], ["found", "toxic"])

    got = sample.mapInArrow(matches, "found array<int>, toxic int").toArrow()
    found, labelled = got["found"].combine_chunks(), got["toxic"].to_numpy()
    rows = np.repeat(np.arange(len(labelled)), found.value_lengths().to_numpy())
    cols = found.flatten().to_numpy().astype(np.int64)
    # Terms are dealt over the lexicons in order of their gain, so that all lexicons are of use.
    votes = np.zeros((len(labelled), LEXICONS + len(PATTERNS)), np.float32)
    votes[rows, np.where(cols < len(names), cols % LEXICONS, cols - len(names) + LEXICONS)] = 1
    posterior = label_model(votes, labelled)
    weights, bias = logistic(rows, cols, len(labelled), len(names) + len(PATTERNS), posterior)
    return ToxicityModel(dict(zip(names, weights[:len(names)].tolist(), strict=True)),
                         weights[len(names):].tolist(), float(bias))


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""
    scored = docs.select("doc_id", fit(docs, labels).column().alias("score"))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is below the threshold."""
    return docs.where(fit(docs, labels).column() < THRESHOLD)
