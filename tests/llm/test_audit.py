"""Filter orders against replaying each order document by document."""

import random
from itertools import permutations

from pulse.llm import audit


def failed(rows):
    """Set of failed filters of each (doc_id, text, part) row."""
    sets = []
    for doc_id, text, _ in rows:
        text = text or ""
        words = text.encode().split()
        names = {name for name, fails in (
            ("A", len(words) < 100), ("B", 100 * len(set(words)) < 80 * len(words)),
            ("C", 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text)),
            ("D", any(c in "#$%&*|" for c in text)),
            ("E", doc_id is not None and any(
                i is not None and i < doc_id and (t or "") == text for i, t, _ in rows))) if fails}
        sets.append(names)
    return sets


def replayed(rows, labels):
    """Every step of every order, by applying the filters one after another."""
    sets, out = failed(rows), []
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    for part in {p or "" for _, _, p in rows}:
        here = [(i, s) for (i, _, p), s in zip(rows, sets, strict=True) if (p or "") == part]
        steps = []
        for order in permutations("ABCDE"):
            kept = list(here)
            for step, f in enumerate(order, 1):
                gone = [(i, s) for i, s in kept if f in s]
                kept = [(i, s) for i, s in kept if f not in s]
                steps.append([part, "".join(order), step, len(kept), len(gone),
                              sum(f in s for _, s in here) - len(gone), sum(s == {f} for _, s in here),
                              sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)])
        total = {f: sum(s[4] for s in steps if s[1][s[2] - 1] == f) for f in "ABCDE"}
        out += [(*s, total[s[1][s[2] - 1]]) for s in steps]
    return sorted(out, key=str)


def random_rows():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["word", "Other", "THIRD", "x&y", *map(str, range(300))])
                      for _ in range(rng.choice([5, 60, 150, 400]))) for _ in range(12)] + ["", None, "ALL CAPS", "$"]
    ids = [*range(60), 3, 3, 7, None, None, None, -5]
    return [(i, rng.choice(texts), rng.choice(["en", "de", "", None])) for i in ids]


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, p, "s", 0) for i, t, p in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_every_step_of_every_order(spark, rows):
    docs = random_rows()
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 60, 3)] + [(3, 0, 0), (3, 1, 1), (6, None, None), (None, 1, 1)]
    table, marks = frames(spark, docs, labels)
    from pyspark.sql import functions as F
    got = rows(audit.audit_query(table.withColumns({c: F.lit(1) for c in ("mask", "part", "good", "n")}), marks))
    assert got == replayed(docs, labels)
    assert any(r[5] for r in got) and any(r[6] for r in got) and any(r[7] for r in got) and any(r[8] for r in got)


def test_empty_tables(spark, rows):
    docs = [(1, None, None), (2, "", "en")]
    table, marks = frames(spark, docs, [])
    assert rows(audit.audit_query(table, marks)) == replayed(docs, [])
    assert audit.audit_query(table.limit(0), marks).count() == 0


def test_paths_through_the_lattice():
    edges = audit.lattice(5)
    assert len(edges) == 80
    assert all(sum(p for s, _, p in edges if s.bit_count() == k) == 120 for k in range(5))
    assert all(sum(p for _, f, p in edges if f == name) == 120 for name in range(5))


def test_a_text_of_many_rows_is_counted_before_it_is_gathered(spark):
    docs = spark.range(30_000).selectExpr(
        "id AS doc_id", "IF(id % 3 = 0, 'the same text', concat('text ', id)) AS text", "'en' AS lang")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    cells = {r["mask"]: r["n"] for r in audit.failed_sets(docs, marks).collect()}
    assert cells == {0b00001: 20_001, 0b10001: 9_999}
