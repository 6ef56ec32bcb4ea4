"""Best-fit packing of tokenised documents into sequences of bounded length.

A document is its token ids and one end id. Longer ones are cut into pieces of
the capacity; only the last piece may be shorter. All that the plan needs is the
histogram of piece lengths, which has at most ``CAPACITY`` entries for any
number of documents.

1. Configuration program. Variables are patterns, multisets of lengths that fit
   into one sequence; every length must be covered as often as it occurs and
   the number of sequences is to be least. It is solved by multiplicative
   weights: lengths carry prices, a knapsack table over the capacity finds the
   dearest patterns (for each length the best pattern that holds it, from one
   table), these are added, and the prices of what they cover fall.
2. Rounding. A share of the solution is taken in whole patterns, fullest first, as
   long as the histogram has the pieces. The weights reach the optimum within a
   percent or two only, so several shares are tried and the plan with the fewest
   sequences is kept.
3. The rest is placed by best fit, longest first, on counts: equal pieces and
   equal gaps are handled together, so its time depends on the lengths only.

The plan becomes a table of slots: for a length, ranks from .. to belong to so
many sequences at this offset. Its size is bounded by patterns and lengths, so it
is sent to every task. Pieces get their rank among the pieces of equal length
from a bucketed row number, about sqrt(n) buckets for each length, so a length
shared by a third of all documents is spread as well.

Null and empty texts are the end id alone; an empty table packs into nothing.
Repeated rows are documents of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulse.llm.common import staged
from pulse.llm.wordtokens import worker_encoder

CAPACITY, END_ID = 4096, 1
ROUNDS = 24
#: Patterns within this share of the dearest one are added in a round.
NEAR_BEST = 0.02
#: Shares of the fractional solution that are tried when it is rounded.
SCALES = tuple(1 / 2**i for i in range(6))
_PIECE = "piece int, start long, length long, ids_crc32 long"


def pieces_of(ids: bytes, capacity: int = CAPACITY) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids, 4 bytes each."""
    ids += END_ID.to_bytes(4, "little")
    for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
        part = ids[4 * start:4 * (start + capacity)]
        yield piece, start, len(part) // 4, crc32(part)


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary)
        for batch in batches:
            rows, found = [], []
            for row, text in enumerate(batch["text"]):
                for piece in pieces_of(encoder.encode(text.as_py()), capacity):
                    rows.append(row)
                    found.append(piece)
            piece, start, length, crc = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"].take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
            ], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, {_PIECE}")


def _priced_patterns(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """For each length the dearest pattern that holds it, if it is near the dearest of all: one knapsack table."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(int(lengths[0]), capacity + 1):
        usable = np.searchsorted(lengths, room, side="right")
        gains = best[room - lengths[:usable]] + prices[:usable]
        k = int(gains.argmax())
        best[room], choice[room] = gains[k], k
        if best[room - 1] > best[room]:
            best[room], choice[room] = best[room - 1], -1
    value = prices + best[capacity - lengths]
    patterns = []
    for first in np.flatnonzero(value >= (1 - NEAR_BEST) * value.max()):
        pattern, room = [int(lengths[first])], capacity - int(lengths[first])
        while room >= lengths[0]:
            if choice[room] < 0:
                room -= 1
            else:
                pattern.append(int(lengths[choice[room]]))
                room -= pattern[-1]
        patterns.append(tuple(sorted(pattern, reverse=True)))
    return patterns


def configuration_program(histogram: dict[int, int], capacity: int = CAPACITY,
                          rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Fractional numbers of patterns that cover the histogram, by multiplicative weights."""
    lengths = np.array(sorted(histogram))
    demand = np.array([histogram[x] for x in lengths], float)
    place = {int(x): i for i, x in enumerate(lengths)}
    covered = np.zeros(len(lengths))
    taken: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        # The price of a length falls with its coverage; its size is the price in an ideal packing.
        prices = lengths / capacity * np.exp(-4.0 * (covered - covered.min()))
        patterns = _priced_patterns(lengths, prices, capacity)
        uses = [np.unique([place[x] for x in p], return_counts=True) for p in patterns]
        load = np.zeros(len(lengths))
        for at, n in uses:
            load[at] += n
        for pattern, (at, n) in zip(patterns, uses, strict=True):
            # Patterns of this round that share a length share its demand.
            amount = float((demand[at] / (load[at] * n)).min()) / rounds
            taken[pattern] = taken.get(pattern, 0.0) + amount
            covered[at] += amount * n / demand[at]
    return {p: x / max(covered.mean(), 1e-9) for p, x in taken.items()}


def best_fit(left: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on counts: sequences with equal contents are one entry."""
    gaps: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    open_gaps = 0  # bit g: some sequence has a gap of g
    for length in sorted(left, reverse=True):
        count = left[length]
        while count:
            fitting = open_gaps >> length
            if fitting:
                gap = length + (fitting & -fitting).bit_length() - 1
                pattern, n = gaps[gap].pop()
                if not gaps[gap]:
                    open_gaps &= ~(1 << gap)
            else:
                gap, pattern, n = capacity, (), count
            each = gap // length
            whole = min(n, count // each)
            # As many sequences as can be filled up to the gap, then one with the remainder.
            done = [(whole, each)] if whole else []
            if whole < n and count - whole * each:
                done.append((1, min(each, count - whole * each)))
            used = 0
            for sequences, pieces in done:
                rest = gap - pieces * length
                gaps.setdefault(rest, []).append((pattern + (length,) * pieces, sequences))
                open_gaps |= 1 << rest if rest else 0
                used += sequences
                count -= sequences * pieces
            if pattern and used < n:
                gaps.setdefault(gap, []).append((pattern, n - used))
                open_gaps |= 1 << gap
    return [entry for entries in gaps.values() for entry in entries]


def _rounded(solution: dict[tuple[int, ...], float], left: dict[int, int], scale: float,
             capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Whole numbers of the scaled patterns, fullest first, and the rest by best fit."""
    left, plan = dict(left), []
    for pattern, amount in sorted(solution.items(), key=lambda e: (capacity - sum(e[0]), -e[1], e[0])):
        times = min([int(amount * scale), *(left[x] // pattern.count(x) for x in set(pattern))])
        if times:
            plan.append((pattern, times))
            for x in pattern:
                left[x] -= times
    return plan + best_fit({x: n for x, n in left.items() if n}, capacity)


def packing_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, number of sequences): every piece of the histogram exactly once."""
    left = {x: n for x, n in histogram.items() if x < capacity}
    whole = [((capacity,), histogram[capacity])] if histogram.get(capacity) else []
    if not left:
        return whole
    solution = configuration_program(left, capacity)
    plans = [_rounded(solution, left, scale, capacity) for scale in SCALES]
    return whole + min(plans, key=lambda plan: sum(times for _, times in plan))


def slot_table(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Rows (length, first rank, pieces for each sequence, first sequence, offset), by length and rank."""
    rows, ranks, sequence = [], {}, 0
    for pattern, times in plan:
        offset = 0
        for length in sorted(set(pattern), reverse=True):
            each = pattern.count(length)
            rows.append((length, ranks.get(length, 0), each, sequence, offset))
            ranks[length] = ranks.get(length, 0) + each * times
            offset += each * length
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "each", "sequence", "offset"), table.T.copy(), strict=True))


def ranked(pieces: DataFrame, n: int) -> DataFrame:
    """pieces with ``rank``, from 0 among pieces of equal length."""
    buckets = max(1, math.isqrt(n))
    placed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = placed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = placed.withColumn("place", F.row_number().over(inside))
    return numbered.join(sizes, ["length", "bucket"]).withColumn(
        "rank", (F.col("before") + F.col("place") - 1).cast("long")).drop("bucket", "before", "place")


def packed(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    pieces = staged(token_pieces(docs, vocabulary, capacity), "token-pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = spark.sparkContext.broadcast(slot_table(packing_plan(histogram, capacity)))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            # Ranks of one length are fewer than all pieces: one sorted key for both.
            base = int(max(table["rank"].max(), rank.max(initial=0))) + 1
            at = np.searchsorted(table["length"] * base + table["rank"], length * base + rank, side="right") - 1
            turn = rank - table["rank"][at]
            yield pa.RecordBatch.from_arrays(
                [batch[c] for c in columns] + [
                    pa.array(table["sequence"][at] + turn // table["each"][at]),
                    pa.array(table["offset"][at] + turn % table["each"][at] * length)],
                [*columns, "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked(pieces, sum(histogram.values())).select(*columns, "rank").mapInArrow(
        place, f"doc_id {kind}, {_PIECE}, sequence_id long, offset long")
