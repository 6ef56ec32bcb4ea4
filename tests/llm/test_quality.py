"""Text statistics against brute force, and learned rules on planted junk."""

import random
import re
from collections import Counter

from pulse.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = list(zip(words, words[1:], words[2:]))
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered.update((i, i + 1, i + 2))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(covered))


def corpus(n=900):
    rng = random.Random(4)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(500)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(60, 120))]
        kind = rng.choice(["fine"] * 6 + ["symbols", "shouting"])
        if kind == "symbols":
            text = [w + "###" for w in text]
        elif kind == "shouting":
            text = [w.upper() + "!!" for w in text]
        rows.append((i, " ".join(text)))
        labels.append((i, int(kind == "fine"), 0))
    return rows, labels


def test_statistics_match_brute_force(make_docs, awkward):
    rng = random.Random(1)
    rows = [(i + 100, rng.choice([" ", "\n"]).join(rng.choice("abcd#") for _ in range(rng.randrange(0, 60)))) for i in range(60)]
    rows += awkward
    got = quality.statistics(make_docs(rows)).select(*quality.BASE).collect()
    assert sorted(map(tuple, got)) == sorted(brute(t) for _, t in rows)


def test_rules_condemn_junk_and_keep_the_rest(spark, make_docs):
    rows, labels = corpus()
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.quality_query(make_docs(rows), frame).collect()
    fine = {i: q for i, q, _ in labels}
    assert sum(r["kept"] == bool(fine[r["doc_id"]]) for r in got) / len(got) > 0.98
    assert {r["rule"] for r in got if not r["kept"]} - {None}


def test_base_rule_without_labels(spark, make_docs, awkward):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.quality_query(make_docs(awkward), none).collect()
    assert len(got) == len(awkward)
    assert all(r["kept"] == (not r["base_failed"]) for r in got)
    assert quality.quality_query(make_docs([]), none).count() == 0


def test_decision_list_is_ordered(spark):
    rules = [(quality.Term("x", True, 5.0),), (quality.Term("x", True, 1.0), quality.Term("y", False, 0.0))]
    frame = spark.createDataFrame([(6.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 0.0)], "x double, y double")
    assert [r[0] for r in frame.select(quality.verdict(rules)).collect()] == [0, 1, None, None]
