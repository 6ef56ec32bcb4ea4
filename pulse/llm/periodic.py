"""Periodic runs of words: stretches that repeat with a period, at least ``POWER`` times.

A run is a longest stretch of consecutive words with smallest period q (words q
apart are identical) and a length of max(``LEAST``, ``POWER`` * q) or more. Words of
many texts are put behind each other and solved at once; symbols of different
texts differ, so nothing is found across them.

1. Suffixes are sorted by prefix doubling. Words that occur fewer than ``POWER``
   times in their text cannot lie in a run and count as unlike any other word.
2. The ranks of the doubling steps give the longest common prefix (LCP) of
   neighbours, and nearest smaller values give the LCP intervals. No tree is built.
3. Branching tandem test: in an interval of depth d, suffixes i of all child
   intervals but the largest look up the places of i + d and i - d in the inverse
   suffix array. If these lie in the interval as well, words i to i + 2d are a
   square; it is branching, the last of its run, if the word after it breaks the
   period. Every suffix is in a smaller child at most log2(n) times.
4. Squares are rotated to the left as long as the period holds and merged into
   runs, by ascending period: a square of several periods lies in a known run.

Null and empty texts have no words and no runs. A text is solved by one task, with
some (30 + 4 * log2 of its longest repeat) bytes a word. Rows are independent of each
other: repeated rows, null ids, ties and further columns change nothing.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.llm.common import raw

LEAST, POWER = 6, 4
#: Words that are solved together, and suffixes looked up at once.
BATCH, PROBES = 100_000, 4_000_000
_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def suffix_ranks(symbols: np.ndarray, stop: np.ndarray, least: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array, and the rank of each suffix by its first 1, 2, 4, ... symbols and at last by all.

    ``stop`` is the end of each place's text. Symbols with fewer than ``least``
    places are unlike each other.
    """
    size = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    counts = np.diff(np.append(heads, size))
    head = np.repeat(heads, counts)
    head = np.where(np.repeat(counts, counts) < least, np.arange(size), head)
    rank = np.empty(size, np.int32)
    rank[order] = head
    levels, known = [rank], 1
    rows = np.flatnonzero(np.repeat(counts, counts) >= max(least, 2))
    while len(rows):
        at = order[rows]
        after = at + known
        inside = after < stop[at]
        key = rank[at].astype(np.int64) * (size + 1) + np.where(inside, rank[np.where(inside, after, 0)] + 1, 0)
        turn = np.argsort(key, kind="stable")
        at, key = at[turn], key[turn]
        order[rows] = at
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        counts = np.diff(np.append(heads, len(rows)))
        rank = rank.copy()
        rank[at] = np.repeat(rows[heads], counts)
        levels.append(rank)
        rows = rows[np.repeat(counts > 1, counts)]
        known *= 2
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose suffix shares its first symbol with the row before, and how many symbols it shares."""
    first = levels[0][order]
    rows = np.flatnonzero(first[1:] == first[:-1]) + 1
    one, other = order[rows - 1], order[rows]
    start = other.copy()
    ends = stop[one], stop[other]
    for level in reversed(range(len(levels))):
        rank, step = levels[level], 1 << level
        inside = (one < ends[0]) & (other < ends[1])
        same = inside & (rank[np.where(inside, one, 0)] == rank[np.where(inside, other, 0)])
        one, other = one + step * same, other + step * same
    return rows, other - start


def lcp_intervals(rows: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Interval of each row, and first row, last row and depth of each interval, from nearest smaller values."""
    owner, low, high, deep = [], [], [], []
    stack: list[int] = []  # open intervals, by rising depth
    last = -2
    for row, d in zip(rows.tolist(), depth.tolist(), strict=True):
        if row != last + 1:
            for k in stack:
                high[k] = last
            stack.clear()
        begin = row - 1
        while stack and deep[stack[-1]] > d:
            k = stack.pop()
            high[k] = last
            begin = low[k]
        if not stack or deep[stack[-1]] < d:
            stack.append(len(low))
            low.append(begin)
            high.append(-1)
            deep.append(d)
        owner.append(stack[-1])
        last = row
    for k in stack:
        high[k] = last
    return np.array(owner, np.int64), np.array(low, np.int64), np.array(high, np.int64), np.array(deep, np.int64)


def _smaller_children(rows: np.ndarray, owner: np.ndarray, low: np.ndarray,
                      high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(interval, first row, rows) of all children but the largest of each interval."""
    parent = np.concatenate([np.arange(len(low)), owner])
    first = np.concatenate([low, rows])
    by = np.lexsort((first, parent))
    parent, first = parent[by], first[by]
    end = np.append(first[1:], 0)
    closing = np.append(parent[1:] != parent[:-1], True)
    size = np.where(closing, high[parent] + 1, end) - first
    by = np.lexsort((-size, parent))
    keep = by[np.concatenate([[False], parent[by][1:] == parent[by][:-1]])]
    return parent[keep], first[keep], size[keep]


def branching_squares(symbols: np.ndarray, start: np.ndarray, stop: np.ndarray,
                      least: int, power: int) -> list[tuple[int, int]]:
    """(place, period) of the last squares of all stretches that may be runs, by ascending period."""
    order, levels = suffix_ranks(symbols, stop, power)
    rows, depth = common_prefixes(order, levels, stop)
    if not len(rows):
        return []
    owner, low, high, deep = lcp_intervals(rows, depth)
    parent, first, size = _smaller_children(rows, owner, low, high)
    rank, found = levels[-1], []
    for part in np.split(np.arange(len(size)), np.flatnonzero(np.diff(np.cumsum(size) // PROBES)) + 1):
        n = size[part]
        row = np.repeat(first[part] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        k = np.repeat(parent[part], n)
        at, d = order[row], deep[k]
        for left, right in ((at, at + d), (at - d, at)):
            other = np.where(left == at, right, left)
            inside = (other >= start[at]) & (other < stop[at])
            place = rank[np.where(inside, other, 0)]
            hit = np.flatnonzero(inside & (low[k] <= place) & (place <= high[k]))
            square, period = left[hit], d[hit]
            end = square + 2 * period
            ends = end == stop[square]
            branching = ends | (symbols[np.where(ends, 0, end)] != symbols[end - period])
            # What a run needs to the left of its last square, at two places.
            need = np.maximum(least, power * period) - 2 * period
            room = square - need >= start[square]
            far, near = np.where(room, square - need, square), np.where(need > 0, square - 1, square)
            near = np.where(room, near, square)
            may = branching & room & (symbols[far] == symbols[far + period]) & (symbols[near] == symbols[near + period])
            found.append(np.stack([period[may], square[may]], axis=1))
    squares = np.unique(np.concatenate(found), axis=0)
    return [(i, d) for d, i in squares.tolist()]


def _rotated(symbols: np.ndarray, at: int, period: int, start: int) -> int:
    """The first place from which the period holds up to ``at``."""
    step = max(64, 2 * period)
    while at > start:
        low = max(start, at - step)
        breaks = np.flatnonzero(symbols[low:at] != symbols[low + period:at + period])
        if len(breaks):
            return low + int(breaks[-1]) + 1
        at, step = low, 2 * step
    return start


def runs_of(texts: list[np.ndarray], least: int = LEAST, power: int = POWER) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, sorted; texts are arrays of word numbers from 0."""
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    lengths = np.array([len(t) for t in texts])
    if not lengths.sum():
        return runs
    spread = np.concatenate([[0], np.cumsum([int(t.max()) + 1 if len(t) else 0 for t in texts])[:-1]])
    symbols = np.concatenate(texts) + np.repeat(spread, lengths)
    stops = np.cumsum(lengths)
    start, stop = np.repeat(stops - lengths, lengths), np.repeat(stops, lengths)
    known: dict[int, list[tuple[int, int]]] = {}
    bounds = stops.tolist()
    for at, period in branching_squares(symbols, start, stop, least, power):
        end = at + 2 * period
        if any(period % q == 0 and s <= at for s, q in known.get(end, ())):
            continue
        first = _rotated(symbols, at, period, int(start[at]))
        known.setdefault(end, []).append((first, period))
        if end - first >= max(least, power * period):
            text = bisect_right(bounds, at)
            runs[text].append((first - int(start[at]), end - first, period))
    return [sorted(r) for r in runs]


def _numbers(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


def _kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep)])


def with_runs(docs: DataFrame, least: int = LEAST, power: int = POWER) -> DataFrame:
    """doc_id, n_words, runs (by start and period) and the text without repetitions, of each row."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def solved(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        runs = runs_of([_numbers(w) for w in texts], least, power)
        return pa.RecordBatch.from_arrays([
            ids, pa.array(map(len, texts), pa.int64()),
            pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs], kind),
            pa.array([_kept(w, r).decode() for w, r in zip(texts, runs, strict=True)], pa.string())],
            ["doc_id", "n_words", "runs", "collapsed"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, texts, held = 0, [], 0
            for row, value in enumerate(batch["text"]):
                texts.append((value.as_py() or b"").split())
                held += len(texts[-1])
                if held >= BATCH or row == batch.num_rows - 1:
                    yield solved(batch["doc_id"].slice(begin, len(texts)), texts)
                    begin, texts, held = row + 1, [], 0

    name = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", raw()).mapInArrow(
        solve, f"doc_id {name}, n_words long, runs {_RUNS}, collapsed string")


def with_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text; in every tenth document, by a checksum of its id, the words from some place on repeat.

    Word i from place a on becomes word a + (i - a) mod p. A null id counts as an empty one.
    """
    check = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")

    def repeated(w: Column) -> Column:
        n, seed = F.size(w), F.floor(check / 10).cast("long")
        a = seed % n
        p = 1 + F.floor((n - a) / (3 + seed % 8)).cast("long")
        places = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
        return F.array_join(F.transform(places, lambda i: F.get(w, i)), " ")

    # A list of one binds the words, so that a text is split once, and only where it changes.
    changed = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit(""))), 0)
    return docs.select("doc_id", F.when(check % 10 == 0, changed).otherwise(F.col("text")).alias("text"))


def periodic_query(docs: DataFrame) -> DataFrame:
    """Runs of the texts with repeated tails: their number, the longest one, and digests of all and of what is kept."""
    found = with_runs(with_tails(docs))
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
