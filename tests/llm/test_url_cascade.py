import random

import pytest
from odd_rows import CLASHES
from pyspark.sql import functions as F

from ticktape.llm import bloom_cascade


def plain(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), a == "block", h + p) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, "block" if best and best[1] else "allow"


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es", "block"), ("a.b", "", "block"), ("", "", "allow"), ("com", "/", "block")]
URLS = [
    None, "", "no scheme", "http://", "http://EXAMPLE.com/en/x", "http://www.example.com/en/?q", "http://x.www.example.com/en/1#top",
    "http://com/", "http://com", "http://acom/", "http://.com/", "http://net/es", "http://net/espresso", "http://net/e", "https://a.b", "https://z.a.b?x",
    "x://y://z/", "http://é.example.com/en/é", "http://ÉX.com/A", "http://example.com/en", "http://a..com/\n/x", "http://com/" + "long/" * 5000,
]


@pytest.mark.parametrize("limit", [1 << 28, 64])
def test_urls_against_a_loop(spark, monkeypatch, limit):
    monkeypatch.setattr(bloom_cascade, "MAX_BITS", limit)  # the small one cuts the lists into parts
    rng = random.Random(11)
    names = ["com", "net", "example", "www", "a", "b", "es"]
    urls = URLS + URLS[:3] + ["http://" + ".".join(rng.choice(names) for _ in range(rng.randint(1, 4))) + rng.choice(["", "/", "/en/", "/es/x", "?y"]) for _ in range(300)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").select("*", *[F.lit(1).alias(c) for c in CLASHES if c != "host"], F.lit("h").alias("host"), F.lit("r").alias("rule"), F.lit("k").alias("keys"))
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    got = {r["row"]["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in bloom_cascade.judged(pages, rules).collect()}
    assert got == {i: plain(u, RULES) for i, u in enumerate(urls)}
    assert bloom_cascade.judged(pages.where("false"), rules).count() == 0
    none = bloom_cascade.judged(pages, rules.where("false")).select("rule", "verdict").distinct().collect()
    assert [tuple(r) for r in none] == [(None, "allow")]


def test_a_cascade_is_exact_over_its_universe(spark, monkeypatch):
    monkeypatch.setattr(bloom_cascade, "BITS_PER_KEY", 2)  # many false positives, so many levels
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("pmod(hash(key), 17) = 0").unionByName(spark.createDataFrame([("not in the universe",)], "key string"))
    levels = bloom_cascade.cascade(listed, universe)
    assert len(levels) > 3
    asks = bloom_cascade.member(levels, spark)
    found = universe.where(asks(F.col("key"))).select("key")
    want = listed.join(universe, "key")
    assert found.count() == want.count() and found.exceptAll(want).count() == 0
    assert bloom_cascade.cascade(listed.where("false"), universe) == []
