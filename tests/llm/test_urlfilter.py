"""URL filters against a plain search of the rules, and cascades against sets."""

import random

import pytest
from pyspark.sql import functions as F

from pulse.llm import urlfilter

URLS = [
    None, "", "no address", "http://", "://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/a?b#c",
    "https://example.com/en/", "https://example.com/en", "https://notexample.com/en/1", "https://a.www.example.com/en/x",
    "http://x.net/es/1", "http://net/fr/", "http://x.net/ES/1", "http://y.org/a/://b.net/es/", "http://y.org?u=http://x.com/",
    "ftp://spam-farm.example.org/en/1", "http://SPAM-FARM.example.com/fr/2", "http://m.casino-win.org#top",
    "http://example.com:8080/en/1", "http://.com/x", "http://a..com/x", "http://É.com/é", "line\nhttp://x.net/fr/a\nb",
    "http://x.net/es/1", "http://" + "a." * 300 + "com/" + "p/" * 5000,
]


def judged(url, rules=urlfilter.RULES, sites=urlfilter.SITES):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, *max(fits)[2:]
    return host, path, None, "block" if set(host.split(".")) & set(sites) else "allow"


def test_query_equals_a_search_of_the_rules(spark, rows):
    pages = spark.createDataFrame([(None if i == 3 else i, u, "html") for i, u in enumerate(URLS)],
                                  "page_id long, url string, html string")
    pages = pages.withColumns({c: F.lit(1) for c in ("host", "path", "rule", "_keys", "key")})
    assert rows(urlfilter.url_query(pages)) == sorted(
        ((None if i == 3 else i, *judged(u)) for i, u in enumerate(URLS)), key=str)
    assert urlfilter.url_query(pages.limit(0)).count() == 0


@pytest.mark.parametrize("listed", [0, 1, 300, 5_000])
def test_cascade_is_exact_for_the_whole_universe(spark, listed):
    keys = spark.range(20_000).select(F.concat(F.lit("key "), "id").alias("key"), "id")
    hashed = keys.select("id", *urlfilter.key_hashes(F.col("key")))
    levels = urlfilter.bloom_cascade(hashed.where(F.col("id") < listed), hashed.union(hashed))
    rows = hashed.toPandas()
    found = urlfilter.members(levels, *[rows[c].to_numpy().view("uint64") for c in ("one", "two")])
    assert set(rows["id"][found]) == set(range(listed))
    if listed == 300:
        assert sum(8 * len(level.bits) for level in levels) < listed * 25


def many_rules():
    rng = random.Random(5)
    hosts = [".".join(rng.choice("abcd") for _ in range(rng.randrange(1, 4))) for _ in range(40)]
    paths = ["/", "/a", "/a/", "/a/b", "/b/"]
    rules = sorted({(h, p): rng.choice(["allow", "block"]) for h, p in zip(hosts, rng.choices(paths, k=40), strict=True)}.items())
    urls = ["http://" + ".".join(rng.choice("abcde") for _ in range(rng.randrange(1, 5))) + rng.choice(
        ["", "/", "/a", "/a/b/c", "/ab", "/b/", "/c"]) for _ in range(2000)]
    return [(v, h, p) for (h, p), v in rules], urls


@pytest.mark.parametrize("most", [urlfilter.MOST_BYTES, 1])
def test_many_rules_by_filters_and_by_joins(spark, rows, monkeypatch, most):
    monkeypatch.setattr(urlfilter, "MOST_BYTES", most)
    rules, urls = many_rules()
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = urlfilter.filtered_urls(pages, spark.createDataFrame(rules, "verdict string, host string, path string"),
                                  spark.createDataFrame([("e",)], "key string"))
    assert rows(got.select("page_id", "host", "path", "rule", "verdict")) == sorted(
        ((i, *judged(u, rules, ["e"])) for i, u in enumerate(urls)), key=str)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("Join" in plan) == (most == 1)
