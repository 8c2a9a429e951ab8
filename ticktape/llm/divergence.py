"""How far the sources of a language lie apart, by the terms that they use: exact symmetric chi-square sums of every two of them.

1. Terms (runs of letters and of anything beyond ASCII) are counted once over all texts, per language, source and term, with the
   number of documents; a task adds up its own documents before anything travels.
2. The terms of at least ``LEAST_DOCS`` documents of a language are its columns, the most widespread first; its sources are the rows,
   the largest first.  Whole-number shares stand in the cells; a cell without a count holds its row's share of nothing.
3. A tile of columns is one task: a K-squared quadtree over its nonzero cells.  Two rows of quadrants are walked together: where both
   are all zero, every column costs the same and the quadrant is priced by its width; nonzero leaves are compared cell by cell.
4. Tiles are added up to one value for every two sources.  What sets a source apart is ranked from its cells alone.

A language of many sources has its rows in bands of ``BAND``, and a task is a tile and two bands; tiles get narrower as rows get more, so a
task holds about ``CELLS`` cells at most.  No text travels, and no source, language or term is ever one task.

Defined cases: a null text, language or source is an empty one; a document without terms still makes its source a group; every row
counts as a document; a language without kept terms has pairs of value 0 and no terms; counts are exact up to 9e15 words; no rows
give no result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticktape.llm.quadtree import LEAF, Quadtree
from ticktape.llm.tables import text_of, written

LEAST_DOCS, BEST = 10, 10
BAND, WIDEST, CELLS = 1024, 4096, 1 << 21
#: Distinct (group, term) counts that a task adds up before it passes them on.
HELD = 400_000
#: Slices of a class of equally widespread terms, each numbered by one task.
PARTS = 256
#: UTF-8 bytes: letters of ASCII in lower case, everything beyond ASCII as it is, a blank for all others.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTS = "lang string, source string, term string, n long, docs long"


def terms(text: str) -> list[bytes]:
    """The terms of a text, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def passed_on() -> pa.RecordBatch:
        rows = [(*group, term, n, docs[term]) for group, (found, docs) in held.items() for term, n in found.items()]
        # every group has a row with no term, whether it has terms or not
        rows += [(*group, b"", 0, 0) for group in held]
        held.clear()
        lang, source, term, n, docs = zip(*rows)
        texts = [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays([*texts, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(*[c.to_pylist() for c in batch.columns]):
            found, docs = held.setdefault((lang, source), (Counter(), Counter()))
            words = terms(text)
            found.update(words)
            docs.update(set(words))
        if sum(len(found) for found, _ in held.values()) > HELD:
            yield passed_on()
    if held:
        yield passed_on()


def counted(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of every term, and a row without a term for every group."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]
    rows = docs.select(*named, text_of(text).alias("text")).mapInArrow(_count, _COUNTS)
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def columns(counts: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """``lang, term, total, column``: the kept terms of each language, numbered from 0, the most widespread first.

    Classes of terms by their documents' magnitude are cut into slices by hash; a slice is numbered by one task.
    """
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).where(F.col("docs") >= least)
    place = (63 - F.floor(F.log2("docs"))) * PARTS + F.pmod(F.xxhash64("term"), F.lit(PARTS))
    kept = written(kept.select("lang", "term", "total", place.cast("int").alias("part")), "terms")
    sizes = kept.groupBy("lang", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("part")) - F.col("n")
    number = F.row_number().over(Window.partitionBy("lang", "part").orderBy("term")) - 1
    numbered = kept.withColumn("at", number).join(sizes.select("lang", "part", before.alias("before")), ["lang", "part"])
    return numbered.select("lang", "term", "total", (F.col("before") + F.col("at")).alias("column"))


def share(n: str, words: str, kept: str) -> Column:
    """One more than the billionths that ``n`` and two are of all ``words`` with two for each ``kept`` term; exact."""
    return F.expr(
        f"1 + (CAST(1000000000 AS DECIMAL(10,0)) * CAST({n} + 2 AS DECIMAL(19,0))) div CAST({words} + 2 * {kept} AS DECIMAL(20,0))"
    )


def apart(p: str, q: str) -> Column:
    """Square of the difference over the sum, in whole numbers."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def width(rows: Column) -> Column:
    """Columns of a tile of two bands of so many rows: a power of two."""
    fits = F.floor(F.log2(F.lit(CELLS) / F.least(rows, F.lit(2 * BAND))))
    return F.pow(F.lit(2), F.least(F.greatest(fits, F.lit(LEAF.bit_length() - 1)), F.lit(WIDEST.bit_length() - 1))).cast("long")


def matrix(counts: DataFrame, least: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """Groups (``lang, source, words, kept, row, rows, none``: the share of no occurrence) and cells (``lang, source, row, column,
    term, p`` and the language's ``q``)."""
    names = written(columns(counts, least), "columns")
    langs = names.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_words"))
    cells = written(counts.where("term <> ''").select("lang", "source", "term", "n").join(names, ["lang", "term"]), "counts")
    words = cells.groupBy("lang", "source").agg(F.sum("n").alias("words"))
    groups = counts.where("term = ''").select("lang", "source").join(words, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    by_size = Window.partitionBy("lang").orderBy(F.desc("words"), "source")
    groups = groups.withColumn("row", F.row_number().over(by_size) - 1).withColumn("rows", F.count("*").over(Window.partitionBy("lang")))
    none = F.when(F.col("kept") > 0, F.expr("0L")).alias("zero")
    groups = groups.select("*", none).withColumn("none", F.when(F.col("kept") > 0, share("zero", "words", "kept"))).drop("zero")
    groups = written(groups, "groups")
    known = groups.select("lang", "source", "words", "kept", "lang_words", "row", "rows")
    shares = cells.join(known, ["lang", "source"]).withColumn("p", share("n", "words", "kept")).withColumn("q", share("total", "lang_words", "kept"))
    return groups, shares.select("lang", "source", "row", "rows", "column", "term", "p", "q")


def _tile(key: tuple, cells: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """One tile and two bands: what its columns add to every pair of rows, the higher row first."""
    lang, _, low, high = key
    rows = rows.sort_values("row", kind="stable")
    row, none, across = rows["row"].to_numpy(), rows["none"].to_numpy(np.int64), int(rows["across"].iloc[0])
    n_low = int(rows["of_low"].sum())
    first = range(0, n_low)
    second = first if low == high else range(n_low, len(row))
    tree = Quadtree(np.searchsorted(row, cells["row"].to_numpy()), cells["column"].to_numpy(), cells["p"].to_numpy(np.int64), len(row), across)
    sums = np.zeros((len(row), len(row)), np.int64)
    for level, a, b, c, zero in tree.pairs(first, second):
        side = tree.leaf << level
        mine, other = slice(a * side, (a + 1) * side), slice(b * side, (b + 1) * side)
        n = min(side, across - c * side)
        if zero:  # every column costs what two empty cells do
            p, q = none[mine][:, None], none[other][None, :]
            sums[mine, other] += n * ((p - q) ** 2 // (p + q))
            continue
        p, q = (np.where(v == 0, z[:, None], v) for v, z in ((tree.cells(x, c)[: len(none[s]), :n], none[s]) for x, s in ((a, mine), (b, other))))
        for i in range(len(p)):
            sums[mine.start + i, other] += ((p[i] - q) ** 2 // (p[i] + q)).sum(axis=1)
    i, j = np.nonzero(np.triu(np.ones(sums.shape, bool), 1))
    own = np.isin(i, first) & np.isin(j, second)
    i, j = i[own], j[own]
    return pd.DataFrame({"lang": lang, "a": row[i], "b": row[j], "value": sums[i, j]})


def pair_sums(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """``lang, a, b, value`` for every two rows ``a < b`` of a language."""
    bands = F.ceil(F.col("rows") / BAND)
    own = F.floor(F.col("row") / BAND)
    beside = F.explode(F.sequence(F.lit(0).cast("long"), bands - 1))

    def banded(rows: DataFrame) -> DataFrame:
        """Each row once for every band that its own is compared with."""
        both = rows.withColumn("beside", beside)
        return both.withColumn("low", F.least(own, "beside")).withColumn("high", F.greatest(own, "beside")).drop("beside")

    size = width(F.col("rows"))
    tiled = banded(cells.select("lang", "row", "rows", F.floor(F.col("column") / size).alias("tile"), (F.col("column") % size).alias("column"), "p"))
    tiles = F.sequence(F.lit(0).cast("long"), F.floor((F.col("kept") - 1) / size))
    some = groups.where("kept > 0").select("lang", "row", "rows", "none", "kept", F.explode(tiles).alias("tile"))
    across = F.least(size, F.col("kept") - F.col("tile") * size)
    sides = banded(some.withColumn("across", across)).withColumn("of_low", own == F.col("low"))
    key = ["lang", "tile", "low", "high"]
    summed = (
        tiled.select(*key, "row", "column", "p").groupBy(*key)
        .cogroup(sides.select(*key, "row", "none", "across", "of_low").groupBy(*key))
        .applyInPandas(_tile, "lang string, a long, b long, value long")
    )
    return summed.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def report(counts: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """``lang, source, part, item, value, rank``: the other sources by distance, and the terms that a source has most beyond its language."""
    groups, cells = matrix(counts, least)
    cells = written(cells, "cells")
    sums = written(pair_sums(groups, cells), "pairs")
    named = groups.select("lang", "row", "source")
    first, second = named.toDF("lang", "a", "source"), named.toDF("lang", "b", "item")
    ways = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    pairs = ways.join(first, ["lang", "a"]).join(second, ["lang", "b"]).select("lang", "source", "item", "value")
    bare = groups.where("kept = 0")
    others = bare.select("lang", "source").join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = pairs.unionByName(others.select("lang", "source", "item", F.lit(0).cast("long").alias("value")))
    beyond = cells.where("p > q").select("lang", "source", F.col("term").alias("item"), apart("p", "q").alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    shape = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", place.alias("rank"))
    return shape(pairs, "pair").unionByName(shape(beyond, "term").where(F.col("rank") <= BEST))


def compared(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCS) -> DataFrame:
    """``report`` on documents."""
    return report(written(counted(docs, text, lang, source), "term-counts"), least)
