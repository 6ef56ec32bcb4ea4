"""Line dedup against a plain definition."""

import random

from pulse.llm import linededup


def brute(rows, run=linededup.RUN):
    """Texts after deletion, for rows with different ids; earlier means smaller (id, line)."""
    seen, out = set(), {}
    for key, text in sorted(rows):
        lines = text.split("\n")
        wordy = [i for i, line in enumerate(lines) if line.split()]
        gone = set()
        for k in range(len(wordy) - run + 1):
            window = tuple(lines[i] for i in wordy[k:k + run])
            if window in seen:
                gone.update(wordy[k:k + run])
            seen.add(window)
        out[key] = "\n".join(line for i, line in enumerate(lines) if i not in gone)
    return out


def test_matches_brute_force(make_docs):
    rng = random.Random(3)
    pool = [f"line {i}" for i in range(12)]
    rows = [(i, "\n".join(rng.choice([*pool, "", f"own {i}"]) for _ in range(rng.randrange(1, 30)))) for i in range(60)]
    docs = make_docs(rows)
    got = linededup.without_repeated_lines(docs)
    assert got.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in got.collect()} == brute(rows)


def test_awkward_rows(make_docs, awkward):
    got = linededup.without_repeated_lines(make_docs(awkward)).collect()
    assert sorted(((r["doc_id"] or 0, r["text"]) for r in got), key=str) == sorted(
        ((i or 0, t) for i, t in awkward), key=str)
    assert linededup.line_dedup_query(make_docs(awkward)).count() == len(awkward)
    assert linededup.line_dedup_query(make_docs([])).count() == 0


def test_later_runs_go_and_first_ones_stay(make_docs):
    run = "a b\nc d\ne f"
    got = linededup.without_repeated_lines(make_docs([(1, f"x\n{run}\ny"), (2, f"{run}\nz"), (3, "a b\nc d")]))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: f"x\n{run}\ny", 2: "z", 3: "a b\nc d"}


def test_long_passages_go_from_the_pipeline_however_few_lines_they_fill(spark, make_docs):
    import corpus_pipeline

    long = " ".join(f"word{i}" for i in range(51))
    half = [" ".join(f"{side}{i}" for i in range(26)) for side in "ab"]
    fifty = " ".join(f"few{i}" for i in range(50))
    two = "\n".join(half)
    rows = [(1, long), (2, f"x\n{long}"), (3, f"{two}\n\ny"), (4, f"z\n{half[0]}\n\n{half[1]}"), (5, half[0]),
            (6, fifty), (7, fifty), (8, f"{long}\n{long}\nq r"), (None, "x"), (9, None), (10, "")]
    got = corpus_pipeline.line_dedup_stage(spark, make_docs(rows), "")
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {
        1: long, 2: "x", 3: f"{two}\n\ny", 4: "z\n", 5: half[0], 6: fifty, 7: fifty, 8: "q r", None: "x", 9: None, 10: ""}
