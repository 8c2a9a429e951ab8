"""The quadtree and the distances of sources against plain sums."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_rows import none, odd
from pyspark.sql import functions as F

from ticktape.llm import divergence, tables
from ticktape.llm.quadtree import Quadtree

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def plain(docs, least=10):
    rows = [(r["lang"] or "", r["source"] or "", TERM.findall((r["text"] or "").translate(LOWER))) for r in docs.collect()]
    out = []
    for lang in {r[0] for r in rows}:
        widespread = Counter(t for l, _, words in rows if l == lang for t in set(words))
        kept = sorted(t for t, n in widespread.items() if n >= least)
        sources = {s: Counter() for l, s, _ in rows if l == lang}
        for l, s, words in rows:
            if l == lang:
                sources[s].update(w for w in words if widespread[w] >= least)

        def shares(found):
            n = sum(found.values())
            return [1 + 10**9 * (found[t] + 2) // (n + 2 * len(kept)) for t in kept]

        p = {s: shares(found) for s, found in sources.items()}
        q = shares(sum(sources.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(map(f, p[s], p[o])), o) for o in sources if o != s]
            terms = [(f(a, b), t) for t, a, b in zip(kept, p[s], q) if sources[s][t] and a > b]
            for part, found, most in (("pair", pairs, None), ("term", terms, 10)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


def found(docs, least=10):
    return sorted(tuple(r) for r in divergence.compared(docs, least=least).select("lang", "source", "part", "item", "value", "rank").collect())


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40), st.integers(1, 70), st.sets(st.tuples(st.integers(0, 39), st.integers(0, 69)), max_size=40), st.sampled_from([1, 2, 4, 16]), st.integers(0, 40))
def test_walk_covers_every_cell_once(n_rows, n_columns, places, leaf, cut):
    places = sorted((r, c) for r, c in places if r < n_rows and c < n_columns)
    row, column = (np.array([p[i] for p in places], np.int64) for i in (0, 1))
    dense = np.zeros((n_rows, n_columns), np.int64)
    dense[row, column] = np.arange(1, len(places) + 1)
    tree = Quadtree(row, column, dense[row, column], n_rows, n_columns, leaf)
    cut = min(cut, n_rows)
    for first, second in ((range(n_rows),) * 2, (range(cut), range(cut, n_rows))):
        seen = np.zeros((n_rows, n_rows, n_columns), int)
        for level, a, b, c, zero in tree.pairs(first, second):
            side = leaf << level
            seen[a * side : (a + 1) * side, b * side : (b + 1) * side, c * side : (c + 1) * side] += 1
            mine, other = (dense[x * side : (x + 1) * side, c * side : (c + 1) * side] for x in (a, b))
            assert zero == (not mine.any() and not other.any()) and (zero or level == 0)
            if not level:
                assert (tree.cells(a, c)[: mine.shape[0], : mine.shape[1]] == mine).all()
        for i in first:
            for j in second:
                if i <= j:
                    assert (seen[i, j] == 1).all()


def test_given_tables(spark, sf_dir):
    docs = tables.documents(spark, sf_dir)
    assert found(docs) == plain(docs)


@pytest.mark.parametrize("least", [1, 2, 10])
def test_odd_rows(spark, least):
    docs = odd(spark).withColumn("lang", F.when(F.col("doc_id") > 3, F.col("lang")))
    assert found(docs, least) == plain(docs, least)
    assert found(none(spark), least) == []


def test_many_rows_in_bands_and_narrow_tiles(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BAND", 8)
    monkeypatch.setattr(divergence, "WIDEST", 64)
    monkeypatch.setattr(divergence, "CELLS", 512)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}é" for i in range(300)]
    rows = [(" ".join(words[(i * k) % 300] for k in range(1, 2 + i % 17)), "xy"[i % 3 == 0], f"s{i % 29}") for i in range(400)]
    docs = spark.createDataFrame([*rows, ("", "z", "lone"), ("", "z", "other")], "text string, lang string, source string")
    for least in (2, 5):
        assert found(docs, least) == plain(docs, least)


def test_tasks_pass_counts_on_when_they_hold_many(spark, sf_dir, monkeypatch):
    docs = tables.documents(spark, sf_dir).limit(60)
    before = sorted(map(tuple, divergence.counted(docs).collect()))
    monkeypatch.setattr(divergence, "HELD", 5)
    assert sorted(map(tuple, divergence.counted(docs).collect())) == before


def test_shares_of_very_large_counts(spark):
    cases = [(9 * 10**15 - 2, 9 * 10**15, 1), (0, 9 * 10**15, 10**9), (3, 7, 2), (10**14 + 7, 3 * 10**14, 99_999_999)]
    df = spark.createDataFrame(cases, "n long, w long, k long").select(divergence.share("n", "w", "k"))
    assert [r[0] for r in df.collect()] == [1 + 10**9 * (n + 2) // (w + 2 * k) for n, w, k in cases]
