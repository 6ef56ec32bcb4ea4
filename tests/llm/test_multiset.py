"""Multiset fingerprints: edited texts, homomorphism and likeness."""

from hashlib import sha256

from pyspark.sql import functions as F

from pulse.llm import multiset


def test_edited_texts_and_next_documents(make_docs):
    rows = [(5, "a. b. c.\nd"), (9, ""), (7, None), (12, "é🙂" * 10), (3, "x" * 50), (-4, "last one. here")]
    got = {r["doc_id"]: r for r in multiset.fingerprint_query(make_docs(rows)).collect()}
    order = sorted(rows, reverse=True)
    for (key, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, n = text or "", len(text or "") // 3
        edited = text[:len(text) - n] + (after or "")[:n]
        assert got[key]["n_chars"] == len(text)
        assert got[key]["edited_sha256"] == sha256(edited.encode()).hexdigest()
    assert got[7]["fingerprint"] == got[9]["fingerprint"]
    assert got[9]["near_edited"] == 1.0


def test_ranges_are_linked_to_each_other(spark, make_docs):
    rows = [(i * 37 % 1009, f"text {i}. more") for i in range(500)]
    got = {r["doc_id"]: r for r in multiset.fingerprint_query(make_docs(rows)).collect()}
    order = sorted(rows, reverse=True)
    for (key, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        n = len(text) // 3
        assert got[key]["edited_sha256"] == sha256((text[:len(text) - n] + after[:n]).encode()).hexdigest()


def test_order_independence_and_incremental_change(spark):
    texts = ["one. two.\nthree", "three\ntwo. one.", "two.\nthree", "one."]
    row = spark.createDataFrame([tuple(texts)], "a string, b string, c string, d string").select(
        *[multiset.fingerprint(F.col(c)).alias(c) for c in "abcd"]).select(
        "a", "b", multiset.combined(F.col("c"), F.col("d")).alias("grown"), "c",
        multiset.combined(F.col("a"), F.col("d"), -1).alias("shrunk")).first()
    assert row["a"] == row["b"] == row["grown"] and row["shrunk"] == row["c"] != row["a"]


def test_likeness_estimates_common_paragraphs(spark):
    own = [[f"doc {k} line {i}" for i in range(60)] for k in range(2)]
    pairs = [("\n".join(own[0]), "\n".join(own[0][:keep] + own[1][keep:])) for keep in (0, 20, 40, 60)]
    values = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(
        multiset.likeness(multiset.fingerprint(F.col("a")), multiset.fingerprint(F.col("b")))).collect()]
    assert all(abs(v - keep / 60) < 0.2 for v, keep in zip(values, (0, 20, 40, 60), strict=True))
    assert values[3] == 1.0


def test_awkward_rows(make_docs, awkward):
    got = multiset.fingerprint_query(make_docs(awkward)).collect()
    assert len(got) == len(awkward)
    same = {r["fingerprint"] for r in got if r["doc_id"] in (4, 5)}
    assert len(same) == 1
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert multiset.fingerprint_query(make_docs([])).count() == 0
    assert multiset.fingerprint_query(make_docs([(1, "alone.")])).first()["near_next"] == 1.0


def test_likeness_of_texts_with_thousands_of_differing_paragraphs(spark):
    pairs, wanted = [], []
    for n in (24, 400, 1600, 4000, 20_000):
        for share in (0.0, 0.5, 0.9):
            one = [f"doc a line {i} of {n}" for i in range(n)]
            keep = int(n * share)
            pairs.append(("\n".join(one), "\n".join(one[:keep] + [f"doc b line {i} of {n}" for i in range(n - keep)])))
            wanted.append(share)
    pairs.append(("\n".join(f"short {i}" for i in range(24)), "\n".join(f"long {i}" for i in range(1581))))
    wanted.append(0.0)
    values = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(
        multiset.likeness(multiset.fingerprint(F.col("a")), multiset.fingerprint(F.col("b")))).collect()]
    assert all(abs(v - share) < 0.3 * (1 - share) for v, share in zip(values, wanted, strict=True)), values
