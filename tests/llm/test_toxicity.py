"""Weak supervision on a planted corpus: held-out accuracy and the awkward cases."""

import random
from zlib import crc32

import numpy as np

from pulse.llm import toxicity


def corpus(n=1200):
    rng = random.Random(2)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(3, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(40)]
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                text[rng.randrange(40)] = rng.choice(["zxidiot", "zxmoron", "qwtrash", "qwtrashy"])
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_scores_of_held_out_rows(spark, make_docs):
    rows, labels = corpus()
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_query(make_docs(rows), frame).collect()
    truth = {i: t for i, _, t in labels}
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert right / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_labels_of_held_out_rows_are_never_used(spark, make_docs):
    rows, labels = corpus(400)
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    sample = toxicity.training_sample(make_docs(rows), frame)
    used = sum(crc32(str(i).encode()) % 4 != 2 for i, _ in rows)
    assert sample.count() == used
    assert toxicity.training_sample(make_docs(rows), frame, 50).count() == 50


def test_no_labels_and_awkward_rows(spark, make_docs, awkward):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_query(make_docs(awkward), none).collect()
    assert len(got) == len(awkward) and {r["score"] for r in got} == {0.0}
    rows, labels = corpus(300)
    odd = [*labels, (None, 1, 1), (5, None, None)]
    frame = spark.createDataFrame(odd, "doc_id long, quality int, toxic int")
    scored = toxicity.toxicity_query(make_docs([*rows, *awkward]), frame).collect()
    assert len(scored) == len(rows) + len(awkward)
    kept = toxicity.without_toxic(make_docs([*rows, *awkward]), frame)
    assert kept.columns == make_docs([]).columns
    assert kept.count() == sum(r["predicted"] == 0 for r in scored)
    assert toxicity.toxicity_query(make_docs([]), frame).count() == 0


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.2
    rates = np.array([[0.02, 0.7], [0.03, 0.6], [0.3, 0.3], [0.02, 0.7]])
    votes = np.stack([rng.random(4000) < np.where(truth, r[1], r[0]) for r in rates], axis=1).astype(np.float32)
    votes[:, 3] = votes[:, 0]  # a voter that copies another adds nothing
    posterior = toxicity.label_model(votes, truth.astype(int))
    assert ((posterior > 0.5) == truth).mean() > 0.9
