"""The near-copy stage against brute-force Jaccard groups."""

import random

import pytest

from pulse.llm import neardup, simhash


def brute_groups(rows, size=5):
    """Smallest position reachable over pairs of Jaccard likeness 0.8 or more, for each row."""
    sets = []
    for _, text in rows:
        words = (text or "").lower().split()
        sets.append({" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b) and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group


def near_copies():
    rng = random.Random(11)
    rows = []
    for n in (30, 80, 200, 600, 1500):
        for _ in range(3):
            base = [f"w{rng.randrange(5000)}" for _ in range(n)]
            rows.append(" ".join(base))
            for edits in (1, 2, n // 50, n // 46, n // 40, n // 20):
                copy = list(base)
                for k in rng.sample(range(n), edits):
                    copy[k] = f"new{rng.randrange(10**6)}"
                rows.append(" ".join(copy))
    chain = [f"c{i}" for i in range(100)]  # each is near the one before, the last not near the first
    rows += [" ".join(chain[k * 5:] + [f"d{i}" for i in range(k * 5)]) for k in range(6)]
    rows += ["", None, " \n", "a b", "A  b", "a c"]
    rng.shuffle(rows)
    return list(enumerate(rows, 1))


def test_stage_keeps_one_of_each_jaccard_group(make_docs):
    rows = near_copies()
    group = brute_groups(rows)
    assert 20 < len(set(group)) < len(rows) - 30
    got = sorted(r["doc_id"] for r in simhash.one_of_each_group(make_docs(rows)).collect())
    assert got == sorted({rows[g][0] for g in group})


def test_fingerprints_meet_at_the_least_likeness():
    rng = random.Random(4)
    missed = 0
    for _ in range(300):
        common = [rng.getrandbits(64) for _ in range(80)]
        one, other = (neardup.np.unique(neardup.np.array(common + [rng.getrandbits(64) for _ in range(10)],
                                                         neardup.np.uint64)) for _ in range(2))
        assert neardup.alike(one, other)
        missed += not set(neardup.bands(one)) & set(neardup.bands(other))
    assert missed == 0


def test_rows_without_an_id_and_shared_ids_are_judged_by_their_texts(make_docs):
    rows = [(None, "one text without an id"), (None, "another text without an id"), (None, "another text without an id"),
            (3, "first text of a shared id"), (3, "second text of a shared id"), (3, "second text of a shared id"),
            (None, "first text of a shared id"), (9, "second text of a shared id"), (None, None), (None, "")]
    got = [(r["doc_id"], r["text"]) for r in simhash.one_of_each_group(make_docs(rows)).collect()]
    empty = [row for row in got if not row[1]]
    assert len(empty) == 1
    assert sorted(((i or 0, t) for i, t in got if t)) == [
        (0, "another text without an id"), (0, "one text without an id"),
        (3, "first text of a shared id"), (3, "second text of a shared id")]


def crowded(n, seed=8):
    """Texts that share a passage of a third of their words, and twelve near copies of some of them."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for _ in range(n):
        words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        rows.append(words[:60] + passage + words[60:])
    for k in range(12):
        copy = list(rows[k])
        for i in rng.sample(range(180), 2):
            copy[i] = f"new{rng.randrange(10**6)}"
        rows.append(copy)
    rng.shuffle(rows)
    return [(i, " ".join(words)) for i, words in enumerate(rows, 1)]


def written_pairs(monkeypatch):
    """Number of rows that each step of the stage stages, by name."""
    counts = {}
    real = neardup.staged

    def counted(df, name):
        out = real(df, name)
        counts.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(neardup, "staged", counted)
    return counts


@pytest.mark.parametrize("n", [300, 1200])
def test_a_common_passage_makes_no_pairs_of_all_its_texts(make_docs, monkeypatch, n):
    rows = crowded(n)
    counts = written_pairs(monkeypatch)
    kept = {r["doc_id"] for r in simhash.one_of_each_group(make_docs(rows)).collect()}
    assert len(kept) == n
    # A few pairs a member, for the buckets it is in; not one for each two of them.
    assert sum(counts["near-pairs"]) < 8 * n
    assert counts["near-pairs"][-1] < n


def near_cluster(n, edits, seed=9):
    """Copies of one text, each with its own edits: alike to the text, hardly to each other."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for _ in range(n):
        copy = list(base)
        for i in rng.sample(range(150), rng.choice(edits)):
            copy[i] = f"new{rng.randrange(10**6)}"
        rows.append(" ".join(copy))
    return list(enumerate(rows, 1))


@pytest.mark.parametrize("edits", [(2, 3, 4), (3, 5, 8), (1, 12)])
def test_large_groups_of_near_copies_equal_brute_force(make_docs, edits):
    rows = near_cluster(200, edits)
    group = brute_groups(rows)
    got = sorted(r["doc_id"] for r in simhash.one_of_each_group(make_docs(rows)).collect())
    assert got == sorted({rows[g][0] for g in group})


def test_fingerprints_within_two_bits_are_linked_before_any_bucket(make_docs, monkeypatch):
    rng = random.Random(3)
    rows = []
    for _ in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(1500)]
        for edits in (0, 1, 1, 2):
            copy = list(base)
            for i in rng.sample(range(1500), edits):
                copy[i] = f"new{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
    rows = list(enumerate(rows, 1))
    prints = [neardup.fingerprint(neardup.shingles(t.encode())) for _, t in rows]
    within = sum(((prints[k] ^ prints[i]) & (1 << 64) - 1).bit_count() <= 2 for i in range(48) for k in range(i) if k // 4 == i // 4)
    assert within > 12
    counts = written_pairs(monkeypatch)
    kept = sorted(r["doc_id"] for r in simhash.one_of_each_group(make_docs(rows)).collect())
    assert kept == list(range(1, 49, 4))
    # SimHash has connected what is within two bits; buckets bring the rest.
    assert counts["near-bits"][0] >= 12 and counts["near-links"][0] == counts["near-bits"][0]
    assert sum(counts["near-links"]) <= 48
