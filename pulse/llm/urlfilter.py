"""URL filters: lists of hosts and paths, held in cascades of Bloom filters.

A rule is a host and a path. It fits a URL whose host is the rule's or a subdomain of
it and whose path starts with the rule's; the longest rule that fits decides (of rules
of equal length the one with the longer host). So a URL has a few candidate keys, one
for each of its host's suffixes and each length that rule paths have, and the rule is
the first candidate that is listed.

Membership is exact for all keys of the corpus (the universe) without a join:

1. the first Bloom filter holds the listed keys; the keys of the universe that pass it
   unlisted are its false positives;
2. the next filter holds the false positives, and listed keys that pass it are false
   again; levels alternate until no key is left over.

A key is listed if the number of levels it passes before it fails is odd. The first
level's rate of false positives is the number of listed keys over that of the universe
(times the root of a half) and one half at the others, so all levels together have some
1.5 * log2(universe / listed) + 6 bits a listed key: their size follows the list and not
the corpus. Only keys that pass the first level are ever shuffled. Lists whose filters
would have more than ``MOST_BYTES`` are joined by key instead of being sent to all tasks.

Where no rule fits, the method's verdict is the cascade of listed sites: block if a label
of the host is listed, else allow. A host is what lies between the first ``://`` and the
next ``/``, ``?``, ``#`` or the end, with A-Z in lower case; the path goes on up to ``?``,
``#`` or the end. Null URLs and those without ``://`` have an empty host and path and no
candidates. Rows are judged one by one: repeated rows, null ids, extra columns and an
empty table need nothing special.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.llm.common import staged

#: Filters of this size or less are sent to the tasks.
MOST_BYTES = 256 << 20
#: Below this many listed keys the filters are as large as for so many.
LEAST_KEYS = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"

#: The rules of the query (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Site names that are blocked where no rule fits.
SITES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its bits as bytes, and how many bits a key sets."""

    bits: np.ndarray
    hashes: int


def _places(one: np.ndarray, two: np.ndarray, level: int, size: int, hashes: int) -> np.ndarray:
    """Bit numbers of each key (a row each), from two 64-bit hashes; every level has numbers of its own."""
    start = one ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    start = (start ^ (start >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    start = start ^ (start >> np.uint64(32))
    step = (two + np.uint64(2 * level + 1)) | np.uint64(1)
    numbers = start[:, None] + np.arange(hashes, dtype=np.uint64) * step[:, None]
    numbers = (numbers ^ (numbers >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return ((numbers >> np.uint64(16)) % np.uint64(size)).astype(np.int64)


def _passes(level: Level, number: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    place = _places(one, two, number, 8 * len(level.bits), level.hashes)
    return ((level.bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1).all(axis=1)


def members(levels: Sequence[Level], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether each key is listed: it passes an odd number of levels before it fails."""
    listed = np.zeros(len(one), bool)
    live = np.arange(len(one))
    for number, level in enumerate(levels):
        live = live[_passes(level, number, one[live], two[live])]
        listed[live] = number % 2 == 0
    return listed


def key_hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("one"), F.xxhash64(F.lit("second"), key).alias("two")]


def _filter_of(keys: DataFrame, number: int, size: int, hashes: int) -> Level:
    """A Bloom filter of ``size`` bits from (one, two): bits are put together by their bytes before they are brought."""
    @F.pandas_udf("array<long>")
    def places(one: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series(list(_places(one.to_numpy().view(np.uint64), two.to_numpy().view(np.uint64), number, size, hashes)))

    bits = np.zeros(size // 8, np.uint8)
    # At most size / 8 rows; the size is bounded by MOST_BYTES.
    words = keys.select(F.explode(places("one", "two")).alias("bit")).groupBy(
        F.shiftright("bit", 3).alias("at")).agg(F.bit_or(F.call_function(
            "shiftleft", F.lit(1), F.col("bit").bitwiseAND(7).cast("int"))).alias("byte"))
    for part in words.toArrow().to_batches():
        bits[part["at"].to_numpy()] = part["byte"].to_numpy()
    return Level(bits, hashes)


def _passing(spark, levels: Sequence[Level], number: int):
    """A predicate on (one, two): the key passes the last of these levels, which has this number."""
    held = spark.sparkContext.broadcast(levels[number])

    @F.pandas_udf("boolean")
    def passes(one: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series(_passes(held.value, number, one.to_numpy().view(np.uint64), two.to_numpy().view(np.uint64)))

    return passes


def _size(keys: int, rate: float) -> tuple[int, int]:
    """Bits (whole bytes) and hashes of a Bloom filter."""
    per_key = max(1.0, -math.log2(rate)) / math.log(2)
    return 8 * math.ceil(max(keys, LEAST_KEYS) * per_key / 8), max(1, round(-math.log2(rate)))


def bloom_cascade(listed: DataFrame, universe: DataFrame) -> list[Level] | None:
    """Levels that tell the listed keys from all other keys of the universe; None if they would be too large.

    Both are tables of (one, two), the hashes of keys; the universe may repeat keys.
    """
    spark = listed.sparkSession
    inside = staged(listed.select("one", "two").distinct(), "cascade-listed")
    count = inside.count()
    if not count:
        return []
    others = universe.agg(F.approx_count_distinct("one", 0.02)).first()[0]
    rate = min(0.5, math.sqrt(0.5) * max(count, LEAST_KEYS) / max(1, others))
    size, hashes = _size(count, rate)
    if size // 8 > MOST_BYTES:
        return None
    levels = [_filter_of(inside, 0, size, hashes)]
    passing = universe.select("one", "two").where(_passing(spark, levels, 0)("one", "two")).distinct()
    outside = staged(passing.join(inside, ["one", "two"], "left_anti"), "cascade-false")
    # The sets that levels hold in turn; each is what was wrongly passed by the level before.
    while (left := outside.count()):
        number = len(levels)
        if number > 100:
            raise RuntimeError("two keys have equal hashes")
        levels.append(_filter_of(outside, number, *_size(left, 0.5)))
        wrong = staged(inside.where(_passing(spark, levels, number)("one", "two")), "cascade-false")
        inside, outside = outside, wrong
    return levels


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    host = F.translate(F.regexp_extract(F.col(url), _PARTS, 1), _UPPER, _LOWER)
    return pages.withColumns({
        "host": F.coalesce(host, F.lit("")), "path": F.coalesce(F.regexp_extract(F.col(url), _PARTS, 2), F.lit(""))})


def host_suffixes(host: Column) -> Column:
    """A host and all domains that it lies in."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(
        F.slice(labels, i, F.size(labels) - i + 1), "."))


def candidate_keys(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """Keys of the rules that would fit, longest first."""
    none = F.array().cast("array<string>")
    if not lengths:
        return none
    starts = [F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in sorted(lengths, reverse=True)]
    keys = F.flatten(F.transform(host_suffixes(host), lambda h: F.transform(
        F.filter(F.array(*starts), lambda p: p.isNotNull()),
        lambda p: F.struct(-F.char_length(F.concat(h, p)), -F.char_length(h), F.concat(h, p).alias("key")))))
    return F.when(host != "", F.transform(F.array_sort(keys), lambda k: k["key"])).otherwise(none)


def _hashed(keys: Column) -> list[Column]:
    return [F.transform(keys, lambda k: F.xxhash64(k)), F.transform(keys, lambda k: F.xxhash64(F.lit("second"), k))]


def _flat(arrays: pd.Series) -> np.ndarray:
    return np.concatenate([*arrays, np.empty(0, np.int64)]).astype(np.int64).view(np.uint64)


def _first_of_each(listed: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Place of the first listed key of each row; -1 without one."""
    at = np.flatnonzero(listed)
    owner = np.repeat(np.arange(len(sizes)), sizes)[at]
    rows, begin = np.unique(owner, return_index=True)
    found = np.full(len(sizes), -1)
    found[rows] = at[begin] - (np.cumsum(sizes) - sizes)[rows]
    return found


def _by_cascades(rows: DataFrame, ruled: list[Level], blocking: list[Level], sites: list[Level]) -> DataFrame:
    """``rows`` with rule and blocked, all levels held by every task."""
    held = rows.sparkSession.sparkContext.broadcast((ruled, blocking, sites))

    @F.pandas_udf("struct<place:int,blocked:boolean>")
    def judge(one: pd.Series, two: pd.Series, site_one: pd.Series, site_two: pd.Series) -> pd.DataFrame:
        ruled, blocking, sites = held.value
        sizes, labels = one.map(len).to_numpy(), site_one.map(len).to_numpy()
        one, two = _flat(one), _flat(two)
        place = _first_of_each(members(ruled, one, two), sizes)
        has = place >= 0
        blocked = _first_of_each(members(sites, _flat(site_one), _flat(site_two)), labels) >= 0
        at = ((np.cumsum(sizes) - sizes) + place)[has]
        blocked[has] = members(blocking, one[at], two[at])
        return pd.DataFrame({"place": place, "blocked": blocked})

    found = rows.withColumn("_found", judge(*_hashed(F.col("_keys")), *_hashed(F.col("_labels"))))
    return found.withColumns({
        "rule": F.when(F.col("_found.place") >= 0, F.get(F.col("_keys"), F.col("_found.place"))),
        "_blocked": F.col("_found.blocked")}).drop("_found")


def _by_joins(rows: DataFrame, rules: DataFrame, sites: DataFrame) -> DataFrame:
    """The same for lists of any length: candidates meet the lists by key."""
    rows = staged(rows.withColumn("_row", F.monotonically_increasing_id()), "url-rows")
    rule = rows.select("_row", F.posexplode("_keys").alias("at", "key")).join(rules, "key").groupBy("_row").agg(
        F.min(F.struct("at", "key", (F.col("verdict") == "block").alias("block"))).alias("_rule"))
    site = rows.select("_row", F.explode("_labels").alias("key")).join(
        sites.select("key").distinct(), "key").select("_row", F.lit(True).alias("_site")).distinct()
    return rows.join(rule, "_row", "left").join(site, "_row", "left").withColumns({
        "rule": F.col("_rule.key"), "_blocked": F.coalesce("_rule.block", "_site")}).drop("_row", "_rule", "_site")


def filtered_urls(pages: DataFrame, rules: DataFrame, sites: DataFrame) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    ``rules`` has verdict, host and path, each host and path once; ``sites`` has the
    labels (key) that are blocked where no rule fits.
    """
    rules = staged(rules.select("verdict", F.concat("host", "path").alias("key"), F.char_length("path").alias("n")),
                   "url-rules")
    # As many values as rule paths have lengths.
    lengths = [r["n"] for r in rules.select("n").distinct().collect()]
    rows = with_host_and_path(pages)
    rows = rows.withColumns({
        "_keys": candidate_keys(F.col("host"), F.col("path"), lengths),
        "_labels": F.when(F.col("host") != "", F.split("host", r"\.", -1)).otherwise(F.array().cast("array<string>"))})

    def hashed(keys: DataFrame) -> DataFrame:
        return keys.select(*key_hashes(F.col("key")))

    keys, labels = (hashed(rows.select(F.explode(c).alias("key"))) for c in ("_keys", "_labels"))
    # Which of the rules block: a cascade whose universe are the rules.
    cascades = [bloom_cascade(hashed(rules), keys), bloom_cascade(hashed(rules.where("verdict = 'block'")), hashed(rules)),
                bloom_cascade(hashed(sites), labels)]
    if any(levels is None for levels in cascades):
        judged = _by_joins(rows, rules, sites)
    else:
        judged = _by_cascades(rows, *cascades)
    return judged.withColumn("verdict", F.when(F.col("_blocked"), "block").otherwise("allow")).drop(
        "_keys", "_labels", "_blocked")


def url_query(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of each page under the query's rules and sites."""
    spark = pages.sparkSession
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    sites = spark.createDataFrame([(s,) for s in SITES], "key string")
    return filtered_urls(pages.select("page_id", "url"), rules, sites).select("page_id", "host", "path", "rule", "verdict")


URL_SQL = r"""
WITH rules(verdict, host, path) AS (VALUES
    ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
    ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), sites(label) AS (VALUES
    ('adult-x'), ('ads-track'), ('casino-win'), ('cheap-pills'), ('free-bets'), ('spam-farm')
), parts AS (
    SELECT row_number() OVER () AS row, page_id,
        coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
    FROM pages
), fits AS (
    SELECT parts.row, arg_max(rules.host || rules.path, length(rules.host || rules.path) * 1000 + length(rules.host)) AS rule,
        arg_max(verdict, length(rules.host || rules.path) * 1000 + length(rules.host)) AS verdict
    FROM parts JOIN rules ON (parts.host = rules.host OR ends_with(parts.host, '.' || rules.host))
        AND starts_with(parts.path, rules.path)
    GROUP BY parts.row
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN EXISTS (
    SELECT 1 FROM sites WHERE list_contains(string_split(host, '.'), label)) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN fits USING (row)
"""
