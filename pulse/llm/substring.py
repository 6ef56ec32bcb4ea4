"""Removal of word windows that occur more than once in the corpus.

1. Every window of ``WINDOW`` words has a minimiser, the smallest hash of its
   ``GRAM``-word strings. Windows in a row with the same minimiser form a segment.
   Equal windows have equal minimisers, so they can only meet in segments that
   share one; minimisers with a single place in the corpus are dropped.
2. Segments of equal content are one entry with weight 2 (it has two places or
   more, which is all that matters), so copies never multiply the work.
3. Shards are groups of minimisers. A shard's entries form a compressed FM-index;
   its entries are then streamed through it, and matching statistics by
   backward search report the intervals whose windows have weight 2 or more.
4. A minimiser with over ``HOT_ENTRIES`` different entries would not fit into a
   shard. Its entries are cut into their windows, which are counted by a hash
   of their words, spread over the whole cluster.
5. Intervals go back to all places of an entry, and each document loses the
   words they cover.

Windows are judged on the input. Null and empty texts, and texts of fewer words
than a window, lose nothing (overlaps of a document with itself count, so a long
text of one repeated word is removed). Rows with equal doc_id and text are one
document and are cut alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.llm.common import staged
from pulse.llm.fmindex import FMIndex

WINDOW, GRAM = 35, 5
#: Words of one FM-index, and entries of one minimiser that may share it.
SHARD_WORDS, HOT_ENTRIES = 1_000_000, 5_000
#: Words of texts that are cut into segments together.
CUT_WORDS = 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), np.uint64)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(29))


def _window_minima(values: np.ndarray, n: int) -> np.ndarray:
    """Place of the smallest of each n values in a row, the first one of equals."""
    least, place, known = values, np.arange(len(values)), 1
    while known < n:
        step = min(known, n - known)
        later = least[step:] < least[:-step]
        least, place = np.where(later, least[step:], least[:-step]), np.where(later, place[step:], place[:-step])
        known += step
    return place


class _Contents:
    """128-bit hashes of stretches of words: sums of word hashes times powers of two odd numbers."""

    def __init__(self, hashes: np.ndarray):
        self.sides = []
        for base in _BASES:
            powers, back = (np.multiply.accumulate(np.concatenate(
                [np.ones(1, np.uint64), np.full(len(hashes), b, np.uint64)])) for b in (base, pow(base, -1, 1 << 64)))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers[:-1], dtype=np.uint64)])
            self.sides.append((sums, back))

    def of(self, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
        """Both halves of the hashes of the words [first, last)."""
        size = (last - first).astype(np.uint64)
        return [_mixed((sums[last] - sums[first]) * back[first] + size).view(np.int64) for sums, back in self.sides]


def segments_of(hashes: np.ndarray, lengths: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text, first word in it, number of words, minimiser and content hash (two halves) of each segment.

    ``hashes`` are those of the words of texts of the given lengths behind each other.
    """
    stops = np.cumsum(lengths)
    text = np.repeat(np.arange(len(lengths)), lengths)
    if len(hashes) < window:
        return tuple(np.empty(0, np.int64) for _ in range(6))
    grams = np.zeros(len(hashes) - gram + 1, np.uint64)
    for j in range(gram):
        grams = grams * _BASE + hashes[j:len(hashes) - gram + 1 + j]
    places = _window_minima(_mixed(grams), window - gram + 1)
    # Windows that lie in one text, and of these the first with each minimiser.
    inside = np.flatnonzero(text[:len(places)] == text[window - 1:window - 1 + len(places)])
    if not len(inside):
        return tuple(np.empty(0, np.int64) for _ in range(6))
    places = places[inside]
    owner = text[inside]
    first = np.flatnonzero(np.concatenate([[True], (places[1:] != places[:-1]) | (owner[1:] != owner[:-1])]))
    begin = inside[first]
    end = inside[np.append(first[1:], len(inside)) - 1] + window
    owner = owner[first]
    return (owner, begin - (stops - lengths)[owner], end - begin,
            _mixed(grams)[places[first]].view(np.int64), *_Contents(hashes).of(begin, end))


def _with_key(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key that equal rows share: (did, key)."""
    return docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("did"),
        F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("key"))


def _segments(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def solved(batch: pa.RecordBatch, begin: int, texts: list[list[bytes]]) -> pa.RecordBatch:
        words = word_hashes(list(chain.from_iterable(texts)))
        row, *found = segments_of(words, np.array([len(t) for t in texts]), window, gram)
        take = pa.array(row + begin, pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch["did"].take(take), batch["key"].take(take),
             *[pa.array(c, t) for c, t in zip(found, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]],
            ["did", "key", "at", "n", "mark", "c1", "c2"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, texts, held = 0, [], 0
            for row, text in enumerate(batch["text"]):
                texts.append(text.as_py().split())
                held += len(texts[-1])
                if held >= CUT_WORDS or row == batch.num_rows - 1:
                    yield solved(batch, begin, texts)
                    begin, texts, held = row + 1, [], 0

    return docs.select("did", "key", F.col("text").cast("binary").alias("text")).mapInArrow(
        cut, "did string, key long, at int, n int, mark long, c1 long, c2 long")


def _place() -> Column:
    """A number for the place of a segment; only equality matters."""
    return F.xxhash64("did", "key", "at")


def _several(place: Column) -> Column:
    """Whether a group has more than one place."""
    return F.min(place) != F.max(place)


def _packed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, did, key, packed): texts compressed before they are shuffled."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["did"], batch["key"],
                 pa.array([press.compress(t.as_py()) for t in batch["text"]], pa.binary())],
                ["doc_id", "did", "key", "packed"])

    return docs.select("doc_id", "did", "key", F.col("text").cast("binary").alias("text")).mapInArrow(
        pack, f"doc_id {kind}, did string, key long, packed binary")


def _entry_words(entries: DataFrame, texts: DataFrame) -> DataFrame:
    """mark, hot, c1, c2, weight and the word hashes of each entry, read from its first place."""
    wanted = entries.groupBy("did", "key").agg(
        F.collect_list(F.struct("at", "n", "mark", "hot", "c1", "c2", "weight")).alias("wanted"))
    joined = texts.join(wanted, ["did", "key"]).select("packed", "wanted")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # The entries of all texts of the batch, flat; only their words are hashed.
            entries = pa.concat_arrays([batch["wanted"].flatten()])
            owner = np.repeat(np.arange(batch.num_rows), batch["wanted"].value_lengths().to_numpy())
            first, size = entries.field("at").to_numpy(), entries.field("n").to_numpy()
            out, text, words = [], -1, []
            for row, at, n in zip(owner.tolist(), first.tolist(), size.tolist(), strict=True):
                if row != text:
                    text, words = row, zstandard.decompress(batch["packed"][row].as_py()).split()
                out.append(word_hashes(words[at:at + n]).tobytes())
            yield pa.RecordBatch.from_arrays(
                [*[entries.field(c) for c in ("mark", "hot", "c1", "c2", "weight")], pa.array(out, pa.binary())],
                ["mark", "hot", "c1", "c2", "weight", "words"])

    return joined.mapInArrow(
        take, "mark long, hot boolean, c1 long, c2 long, weight int, words binary")


_RUNS = "c1 long, c2 long, runs array<struct<a:int,b:int>>"


def _runs(starts: np.ndarray, window: int) -> list[dict[str, int]]:
    """Intervals of words [a, b) covered by windows at the given sorted starts."""
    if not len(starts):
        return []
    gaps = np.flatnonzero(np.diff(starts) > window) + 1
    return [{"a": int(part[0]), "b": int(part[-1]) + window} for part in np.split(starts, gaps)]


def _search_shards(words: DataFrame, window: int, shard_words: int) -> DataFrame:
    """Repeated intervals of each entry, from an FM-index for each shard of minimisers."""
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def solve(shard: dict[tuple[int, int], tuple[int, np.ndarray]]) -> pa.RecordBatch:
        names = list(shard)
        index = FMIndex([w for _, w in shard.values()], np.array([n for n, _ in shard.values()]), window)
        found = index.repeated_windows(window)
        runs = [_runs(np.flatnonzero(found[a:a + n]), window)
                for a, n in zip(index.starts.tolist(), index.lengths.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array([c1 for c1, _ in names], pa.int64()), pa.array([c2 for _, c2 in names], pa.int64()),
             pa.array(runs, kind)], ["c1", "c2", "runs"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by minimiser; a shard ends where it is full and the minimiser changes.
        shard: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
        size, mark = 0, None
        for batch in batches:
            for m, c1, c2, weight, raw in zip(*(batch[c].to_pylist() for c in (
                    "mark", "c1", "c2", "weight", "words")), strict=True):
                if m != mark and size >= shard_words:
                    yield solve(shard)
                    shard, size = {}, 0
                mark = m
                if (c1, c2) not in shard:
                    shard[c1, c2] = weight, np.frombuffer(raw, np.uint64)
                    size += len(raw) // 8
        if shard:
            yield solve(shard)

    return words.repartition("mark").sortWithinPartitions("mark").mapInArrow(search, _RUNS)


def _count_windows(words: DataFrame, window: int) -> DataFrame:
    """The same for the entries of hot minimisers: their windows, counted by hash."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c1, c2, weight, raw in zip(*(batch[c].to_pylist() for c in ("c1", "c2", "weight", "words")), strict=True):
                n = len(raw) // 8 - window + 1
                halves = np.frombuffer(b"".join(
                    xxhash.xxh3_128_digest(raw[8 * i:8 * (i + window)]) for i in range(n)), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c1] * n, pa.int64()), pa.array([c2] * n, pa.int64()), pa.array([weight] * n, pa.int32()),
                     pa.array(range(n), pa.int32()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())],
                    ["c1", "c2", "weight", "start", "w1", "w2"])

    windows = words.mapInArrow(spread, "c1 long, c2 long, weight int, start int, w1 long, w2 long")
    place = F.xxhash64("c1", "c2", "start")
    repeated = staged(windows.groupBy("w1", "w2").agg(
        (_several(place) | (F.max("weight") > 1)).alias("several")).where("several").drop("several"), "segment-windows")
    starts = windows.join(repeated, ["w1", "w2"]).groupBy("c1", "c2").agg(
        F.array_distinct(F.collect_list("start")).alias("starts"))  # at most the windows of one segment
    return starts.select("c1", "c2", F.transform(
        "starts", lambda s: F.struct(s.alias("a"), (s + window).alias("b"))).alias("runs"))


def repeated_intervals(docs: DataFrame, texts: DataFrame, window: int = WINDOW, gram: int = GRAM,
                       shard_words: int = SHARD_WORDS, hot_entries: int = HOT_ENTRIES) -> DataFrame:
    """(did, key, cuts): intervals of words to remove, for each document that has some."""
    segments = staged(_segments(docs, window, gram), "segments")
    # Staged, so that the join deals both sides anew and the rows of a very common passage can be split.
    marks = staged(segments.groupBy("mark").agg(_several(_place()).alias("several")).where("several").drop("several"),
                   "segment-marks")
    places = staged(segments.join(marks, "mark", "left_semi"), "segment-places")
    entries = staged(places.groupBy("c1", "c2").agg(
        F.when(_several(_place()), 2).otherwise(1).alias("weight"),
        *[F.first(c).alias(c) for c in ("did", "key", "at", "n", "mark")]), "segment-entries")
    hot = staged(entries.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") > hot_entries).select("mark", F.lit(True).alias("hot")), "segment-hot")
    marked = entries.join(hot, "mark", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    words = staged(_entry_words(marked, texts), "segment-words")
    runs = _search_shards(words.where("not hot"), window, shard_words).unionByName(
        _count_windows(words.where("hot"), window))
    runs = staged(runs.where(F.size("runs") > 0), "segment-runs")
    cuts = places.select("did", "key", "at", "c1", "c2").join(runs, ["c1", "c2"]).select(
        "did", "key", F.transform("runs", lambda r: F.struct(
            (r["a"] + F.col("at")).alias("a"), (r["b"] + F.col("at")).alias("b"))).alias("cuts"))
    return cuts.groupBy("did", "key").agg(F.flatten(F.collect_list("cuts")).alias("cuts"))


def _kept(words: list[bytes], cuts: list[dict[str, int]] | None) -> tuple[int, bytes]:
    """Number of removed words, and the kept ones joined by spaces."""
    if not cuts:
        return 0, b" ".join(words)
    keep = np.ones(len(words), bool)
    for cut in cuts:
        keep[cut["a"]:cut["b"]] = False
    return int(len(words) - keep.sum()), b" ".join([words[i] for i in np.flatnonzero(keep)])


def substring_query(docs: DataFrame, **sizes: int) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words, per row."""
    keyed = _with_key(docs)
    texts = _packed_texts(keyed)
    cuts = repeated_intervals(keyed, texts, **sizes)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, removed, digests = [], [], []
            for packed, cut in zip(batch["packed"], batch["cuts"], strict=True):
                words = zstandard.decompress(packed.as_py()).split()
                gone, text = _kept(words, cut.as_py())
                n_words.append(len(words))
                removed.append(gone)
                digests.append(sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return texts.join(cuts, ["did", "key"], "left").select("doc_id", "packed", "cuts").mapInArrow(
        finish, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")
