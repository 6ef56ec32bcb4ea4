"""A compressed FM-index over word sequences, searched for many documents at a time.

The Burrows-Wheeler transform of the concatenated sequences is kept in a wavelet
matrix of packed bits with a counter for every 64. A backward step narrows the
range of suffixes that start with a string to those that start with one word
more on its left; it costs two rank queries on each level. All numpy work is
done for all searched sequences at once, one step of each.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Packed bits with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words)[:-1], out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Number of ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Rank of any symbol in a sequence of symbols below 2^levels."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.rows, self.zeros = levels, [], []
        for level in reversed(range(levels)):
            bits = (symbols >> level & 1).astype(np.uint8)
            self.rows.append(BitVector(bits))
            self.zeros.append(int(len(bits) - bits.sum(dtype=np.int64)))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def narrow(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each symbol before ``low`` and ``high``, both counted from its first one overall."""
        for depth, (row, zeros) in enumerate(zip(self.rows, self.zeros, strict=True)):
            one = (symbol >> (self.levels - 1 - depth) & 1).astype(bool)
            low_ones, high_ones = row.ones(low), row.ones(high)
            low = np.where(one, zeros + low_ones, low - low_ones)
            high = np.where(one, zeros + high_ones, high - high_ones)
        return low, high


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ordered by at least their first ``depth`` symbols, by prefix doubling."""
    rank, known = symbols.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while known < depth:
        shifted = np.zeros_like(rank)
        shifted[:-known] = rank[known:] + 1 if known < len(rank) else 0
        key = rank * (int(rank.max()) + 2) + shifted
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.zeros(len(key), np.int64)
        fresh[1:] = np.cumsum(ordered[1:] != ordered[:-1])
        rank = np.empty_like(fresh)
        rank[order] = fresh
        if int(fresh[-1]) == len(key) - 1:
            break
        known *= 2
    return order


class FMIndex:
    """Index of weighted sequences of words, given as 64-bit word hashes."""

    def __init__(self, sequences: list[np.ndarray], weights: np.ndarray, depth: int):
        lengths = np.array([len(s) for s in sequences])
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        joined = np.concatenate(sequences)
        _, inverse = np.unique(joined, return_inverse=True)
        # Symbol 0 ends a sequence; it is never searched for.
        self.text = np.zeros(len(joined) + len(sequences), np.int64)
        inside = np.ones(len(self.text), bool)
        inside[self.starts + lengths] = False
        self.text[inside] = inverse.reshape(-1) + 1
        order = suffix_order(self.text, depth)
        levels = max(1, int(self.text.max()).bit_length())
        counts = np.bincount(self.text, minlength=(1 << levels) + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        last = self.text[order - 1]
        self.matrix = WaveletMatrix(last, levels)
        # Where each symbol's occurrences begin in the bottom row of the matrix.
        size = len(self.text)
        symbols = np.arange(len(counts) - 1)
        self.base, _ = self.matrix.narrow(symbols, np.zeros(len(symbols), np.int64), np.full(len(symbols), size))
        owner = np.repeat(np.arange(len(sequences)), lengths + 1)
        self.weight = np.concatenate([[0], np.cumsum(weights[owner[order]])])
        self.lengths = lengths

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the strings with ``symbol`` put in front."""
        a, b = self.matrix.narrow(symbol, low, high)
        shift = self.first[symbol] - self.base[symbol]
        return a + shift, b + shift

    def repeated_windows(self, window: int) -> np.ndarray:
        """For each place of the indexed text: does a window of ``window`` words that starts here have weight 2 or more?

        Matching statistics, cut off at the window. A search runs leftwards from
        an end ``e`` as long as the string has weight 2. Where it fails, at ``f``,
        [f, e) is unique; so is every window around it. Probes of doubling length
        to the right of f then look for a shorter unique string [f, x), and the
        search goes on from the end x - 1. After a match of a full window the next
        window on the left is searched.
        """
        size = len(self.text)
        found = np.zeros(size, bool)
        live = np.flatnonzero(self.lengths >= window)
        start = self.starts[live]
        end = start + self.lengths[live]
        at, low, high = end.copy(), np.zeros(len(live), np.int64), np.full(len(live), size)
        fail = np.full(len(live), -1)  # place of the failure that is being probed, or -1
        limit = np.zeros(len(live), np.int64)  # end of the search that failed there
        while len(live):
            symbol = self.text[at - 1]
            new_low, new_high = self.step(symbol, low, high)
            twice = self.weight[new_high] - self.weight[new_low] >= 2
            probing = fail >= 0
            at = np.where(twice, at - 1, at)
            low, high = np.where(twice, new_low, low), np.where(twice, new_high, high)
            hit = twice & ~probing & (end - at >= window)
            found[at[hit]] = True
            # Searches that end: at the start of their sequence, or by a failure.
            lost = ~twice & ~probing
            full = lost & (end - at >= window)
            short = lost & ~full
            # A probe that fails, or that would reach the known unique end, gives the next end.
            passed = twice & probing & (at == fail)
            longer = fail + 2 * (end - fail)
            known = passed & (longer >= limit)
            solved = (probing & ~twice) | known
            again = passed & ~known
            next_end = np.where(known, limit - 1, end - 1)
            restart = full | short | solved | again
            new_end = np.where(full, at - 1 + window, np.where(
                short, np.minimum(at + 1, end), np.where(solved, next_end, np.where(again, longer, end))))
            limit = np.where(short, end, limit)
            fail = np.where(short, at - 1, np.where(solved, -1, fail))
            # A failure of one word alone is unique by itself: nothing to probe.
            alone = short & (limit - fail <= 1)
            fail = np.where(alone, -1, fail)
            new_end = np.where(alone, at - 1, new_end)
            end = new_end
            at = np.where(restart, end, at)
            low, high = np.where(restart, 0, low), np.where(restart, size, high)
            keep = np.where(fail >= 0, fail - start >= 0, end - start >= window) & ~((fail < 0) & (at <= start))
            if not keep.all():
                live, start, end, at, low, high, fail, limit = (
                    x[keep] for x in (live, start, end, at, low, high, fail, limit))
        return found
