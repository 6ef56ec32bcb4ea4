"""Fingerprints and components against brute force."""

import random

import pytest
import xxhash

from pulse.llm import simhash
from pulse.llm.graph import connected


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Smallest id reachable; prints is a list of (id, value)."""
    group = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, (_, a) in enumerate(prints):
            for j, (_, b) in enumerate(prints):
                if (a ^ b).bit_count() <= 2 and group[j] > group[i]:
                    group[j], changed = group[i], True
    least = {}
    for (key, _), g in zip(prints, group, strict=True):
        if key is not None:
            least[g] = min(key, least.get(g, key))
    return [least.get(g) for g in group]


def test_covering_masks_meet_every_pair_within_the_radius():
    masks = simhash.covering_masks()
    assert len(masks) == 7
    for i in range(64):
        for j in range(i, 64):
            assert any(not (mask >> i & 1 or mask >> j & 1) for mask in masks)


def test_fingerprints_match_the_definition(make_docs, awkward):
    got = simhash.simhash_query(make_docs(awkward)).collect()
    texts = [f"{brute_fingerprint(t):016x}" for _, t in awkward]
    assert sorted(r["fingerprint"] for r in got) == sorted(texts)
    assert len(got) == len(awkward)


def test_components_match_brute_force(spark):
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(30)]
    for _ in range(8):  # a chain and a cloud around some of them
        value = values[rng.randrange(30)]
        for _ in range(12):
            value ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                value ^= 1 << rng.randrange(64)
            values.append(value)
    prints = list(enumerate(dict.fromkeys(values)))
    frame = spark.createDataFrame([(simhash.signed(v),) for _, v in prints], "fp long")
    labels = {r["node"]: r["root"] for r in connected(simhash.links(frame)).collect()}
    expected = brute_components(prints)
    groups = {}
    for (_, value), group in zip(prints, expected, strict=True):
        groups.setdefault(group, set()).add(labels.get(simhash.signed(value), simhash.signed(value)))
    assert all(len(roots) == 1 for roots in groups.values())
    assert len({next(iter(r)) for r in groups.values()}) == len(groups)


def test_one_document_of_each_group_stays(make_docs, awkward):
    docs = make_docs(awkward)
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert ids == [1, 4, 6, 7, 8]  # 2 and 3 go with 1, 5 and the repeated row with 4


def test_empty_table(make_docs):
    assert simhash.simhash_query(make_docs([])).count() == 0
    assert simhash.one_of_each_group(make_docs([])).count() == 0


@pytest.mark.parametrize("edges, roots", [
    ([(1, 2), (2, 3), (3, 4), (7, 9)], {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 9: 7}),
    ([(1, i) for i in range(2, 40)] + [(39, 50), (50, 60)], {i: 1 for i in [*range(1, 40), 50, 60]}),
])
def test_connected(spark, edges, roots):
    got = connected(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["root"] for r in got.collect()} == roots


def test_components_match_union_find(spark):
    rng = random.Random(3)
    pairs = {(a, b) for a, b in ((rng.randrange(90), rng.randrange(90)) for _ in range(70)) if a < b}
    root = {n: n for pair in pairs for n in pair}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = connected(spark.createDataFrame([*pairs, *pairs], "a long, b long"))
    assert {r["node"]: r["root"] for r in got.collect()} == root


def test_plans_of_component_rounds_stay_small(spark, monkeypatch):
    """A step reads the table of the step before twice; both steps in one plan read it twelve times."""
    frame = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")
    leaves, checkpoint = [], type(frame).checkpoint

    def counted(df, *args, **kwargs):
        leaves.append(df._jdf.queryExecution().optimizedPlan().collectLeaves().size())
        return checkpoint(df, *args, **kwargs)

    monkeypatch.setattr(type(frame), "checkpoint", counted)
    assert {r["root"] for r in connected(frame).collect()} == {0}
    assert leaves and max(leaves) <= 2
