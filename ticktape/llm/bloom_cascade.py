"""URL filters by a cascade of Bloom filters.

Level 0 encodes the listed keys.  Keys of the corpus that are not listed and pass it are its false positives, which level 1
encodes; listed keys that pass level 1 are encoded by level 2, and so on until a level has no false positive left.  A
key's first level that it does not pass decides.  Because the levels were built over every key that the corpus can ask for,
the answer is exact for the corpus, and asking takes no join.

A rule is a host and the start of a path.  The keys that a url asks for follow from the shapes of the rules (labels of
the host, characters of the path), so a url has one key for each shape and not for every prefix.  Of the rules that fit, the
longest wins; one that both lists hold blocks.

Levels are bitmaps, built in Spark and broadcast.  Lists too long for ``MAX_BITS`` are cut into parts by a hash of the
key; each part has its own cascade and its keys are asked in a pass of their own, so what is broadcast stays bounded.

Defined cases: a null url, or one without ``://``, has an empty host and path and fits no rule; repeated rows are judged
each; empty lists fit nothing; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ticktape.llm.tables import written

BITS_PER_KEY, HASHES = 10, 5
#: Bits of level 0 of one part of a list: 32 MB.
MAX_BITS = 1 << 28
#: Rules of more shapes than this are an error: each is a key of every url.
MAX_SHAPES = 256
ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


@dataclass(frozen=True)
class Level:
    bits: np.ndarray
    size: int

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = np.ones(len(a), bool)
        for i in range(HASHES):
            at = _place(a, b, i, self.size)
            found &= (self.bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return found


def _place(a: np.ndarray, b: np.ndarray, i: int, size: int) -> np.ndarray:
    return ((a.view(np.uint64) + np.uint64(i) * b.view(np.uint64)) & np.uint64(size - 1)).astype(np.int64)


def _hashes(key: Column, level: Column) -> tuple[Column, Column]:
    return F.xxhash64(key, level), F.xxhash64(level, key).bitwiseOR(F.lit(1))


def bitmap(keys: DataFrame, level: int) -> Level | None:
    """A Bloom filter of the distinct column ``key``; None if there is none."""
    n = keys.count()
    if not n:
        return None
    size = 64
    while size < n * BITS_PER_KEY:
        size *= 2
    if size > 2 * MAX_BITS:
        raise ValueError(f"{n} keys do not fit one bitmap")
    a, b = _hashes(F.col("key"), F.lit(level))
    # taken modulo the size first, so that nothing overflows
    a, b = a.bitwiseAND(F.lit(size - 1)), b.bitwiseAND(F.lit(size - 1))
    places = F.array(*[(a + b * i).bitwiseAND(F.lit(size - 1)) for i in range(HASHES)])
    words = keys.select(F.explode(places).alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")
    )
    bits = np.zeros(size // 64, np.uint64)
    got = words.toPandas()  # at most size / 64 rows, which MAX_BITS bounds
    bits[got["word"].to_numpy()] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return Level(bits, size)


def _listed(levels: list[Level], pairs: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    listed, open_ = np.zeros(n, bool), np.ones(n, bool)
    for k, level in enumerate(levels):
        passed = level.holds(*pairs[k])
        listed[open_ & ~passed] = k % 2 == 1
        open_ &= passed
    listed[open_] = len(levels) % 2 == 1  # passed the last level, which has no false positive
    return listed


def members(lists: list[list[Level]], n_keys: int, spark: SparkSession):
    """A column function of ``n_keys`` keys: a struct of ``l<list>_<key>``, whether that list holds that key.

    All keys and lists are asked in one call, so a row goes to Python once, as hashes.
    """
    shared, depth = spark.sparkContext.broadcast(lists), max(1, *map(len, lists))
    names = [(f"l{a}_{i}", a, i) for a in range(len(lists)) for i in range(n_keys)]

    @pandas_udf(", ".join(f"{name} boolean" for name, _, _ in names))
    def asked(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            hashes = [c.to_numpy(np.int64) for c in columns]
            pairs = [list(zip(hashes[2 * depth * i :: 2], hashes[2 * depth * i + 1 :: 2]))[:depth] for i in range(n_keys)]
            yield pd.DataFrame({name: _listed(shared.value[a], pairs[i], len(hashes[0])) for name, a, i in names})

    def of(keys: list[Column]) -> Column:
        known = [F.coalesce(key, F.lit("")) for key in keys]
        return asked(*[h for key in known for k in range(depth) for h in _hashes(key, F.lit(k))])

    return of


def member(levels: list[Level], spark: SparkSession):
    """A column function: whether a key of the universe is listed."""
    asks = members([levels], 1, spark)
    return lambda key: key.isNotNull() & asks([key])["l0_0"]


def cascade(listed: DataFrame, universe: DataFrame) -> list[Level]:
    """Levels that tell the keys of ``listed`` from the other keys of ``universe`` (distinct columns ``key``)."""
    spark, levels = listed.sparkSession, []
    encoded, others = listed, None
    while (level := bitmap(encoded, len(levels))) is not None:
        levels.append(level)
        passes = _passes(level, len(levels) - 1, spark)
        if others is None:
            wrong = universe.where(passes(F.col("key"))).join(listed, "key", "left_anti")
        else:
            wrong = others.where(passes(F.col("key")))
        encoded, others = written(wrong, "false-positives"), encoded
    return levels


def _passes(level: Level, number: int, spark: SparkSession):
    shared = spark.sparkContext.broadcast(level)

    @pandas_udf("boolean")
    def passes(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(shared.value.holds(a.to_numpy(np.int64), b.to_numpy(np.int64)))

    return lambda key: passes(*_hashes(key, F.lit(number)))


def shapes_of(rules: DataFrame) -> list[tuple[int, int]]:
    labels = F.size(F.split("host", r"\.", -1))
    found = rules.select(labels.alias("labels"), F.length("path").alias("chars")).distinct().limit(MAX_SHAPES + 1).collect()
    if len(found) > MAX_SHAPES:
        raise ValueError(f"rules of more than {MAX_SHAPES} shapes")
    return sorted((r["labels"], r["chars"]) for r in found)


def keys_of(host: Column, path: Column, shapes: list[tuple[int, int]]) -> list[Column]:
    """For each shape the key that a url asks for, or null if it is too short for it."""
    labels = F.size(F.split(host, r"\.", -1))
    return [
        F.when((labels >= n) & (F.length(path) >= chars), F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, chars)))
        for n, chars in shapes
    ]


def judged(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = ALLOW) -> DataFrame:
    """``row`` (the input row), ``host``, ``path``, ``rule`` (the longest that fits, or null) and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``action`` (allow or block).
    """
    spark = pages.sparkSession
    shapes = shapes_of(rules)
    host, path = host_and_path(F.col(url).cast("string"))
    rows = pages.select(F.struct("*").alias("row"), host.alias("host"), path.alias("path"))
    if not shapes:
        return rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    rows = rows.withColumn("keys", F.array(*keys_of(F.col("host"), F.col("path"), shapes)))
    listed = rules.select(F.concat("host", "path").alias("key"), "action").distinct()
    universe = written(rows.select(F.explode("keys").alias("key")).where("key is not null").distinct(), "universe")
    # level 0 holds the list and level 1 its false positives, fewer than a fiftieth of the universe
    parts = -(-max(listed.count(), universe.count() // 50) * BITS_PER_KEY // MAX_BITS)
    part_of = lambda key: F.pmod(F.hash(key), F.lit(parts))
    size = len(shapes)
    for part in range(parts):
        inside = part_of(F.col("key")) == part
        lists = [cascade(listed.where(inside & (F.col("action") == a)).select("key"), universe.where(inside)) for a in (ALLOW, BLOCK)]
        asks = members(lists, size, spark)
        rows = rows.withColumn(f"asked{part}", asks([F.col("keys")[i] for i in range(size)]))

    def held(i: int, a: int) -> Column:
        """Whether list ``a`` has the ``i``-th key, said by the part that the key is in."""
        said = F.lit(False)
        for part in range(parts):
            said = F.when(part_of(F.col("keys")[i]) == part, F.col(f"asked{part}")[f"l{a}_{i}"]).otherwise(said)
        return F.col("keys")[i].isNotNull() & said

    fits = F.array(*[
        F.when(held(i, 0) | held(i, 1), F.struct(F.length(F.col("keys")[i]).alias("n"), held(i, 1).alias("blocks"), F.col("keys")[i].alias("rule")))
        for i in range(size)
    ])
    best = F.array_max(fits)
    verdict = F.when(best.isNull(), default).when(best["blocks"], BLOCK).otherwise(ALLOW)
    return rows.select("row", "host", "path", best["rule"].alias("rule"), verdict.alias("verdict"))
