"""Counts of every order of filters against running the filters one after another."""

from itertools import permutations

import pytest
from odd_rows import none, odd
from pyspark.sql import functions as F

from ticktape.llm import filter_audit, tables

COLUMNS = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def one_after_another(rows, names="ABCDE"):
    """``rows``: (part, key, text, fails of A to D, good, toxic)."""
    firsts = {}
    for _, key, text, *_ in rows:
        if key is not None:
            firsts[text] = min(key, firsts.get(text, key))
    judged = [(part, [*fails, key is not None and key > firsts.get(text, key)], good, toxic) for part, key, text, fails, good, toxic in rows]
    out, removed_in_all = [], {}
    for part in {r[0] for r in rows}:
        for order in permutations(range(5)):
            left = own = [r for r in judged if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                removed_in_all[part, f] = removed_in_all.get((part, f), 0) + len(gone)
                failing = sum(r[1][f] for r in own)
                alone = sum(r[1][f] and sum(r[1]) == 1 for r in own)
                name = "".join(names[i] for i in order)
                out.append((part, name, step, len(left), len(gone), failing - len(gone), alone, sum(r[2] for r in gone), sum(r[3] for r in gone), f))
    return sorted((*r[:-1], removed_in_all[r[0], r[-1]]) for r in out)


def plain(docs, labels):
    marks = [(r["doc_id"], r["quality"], r["toxic"]) for r in labels.collect()]
    good, toxic = {k for k, q, _ in marks if q == 1 and k is not None}, {k for k, _, t in marks if t == 1 and k is not None}
    texts = [(r["lang"] or "", r["doc_id"], r["text"] or "") for r in docs.collect()]
    return one_after_another([(p, k, t, filter_audit.failures(t), k in good, k in toxic) for p, k, t in texts])


def audited(docs, labels):
    return sorted(tuple(r[c] for c in COLUMNS) for r in filter_audit.audited(docs, labels).collect())


def test_given_tables(spark, sf_dir):
    docs, labels = tables.documents(spark, sf_dir), tables.labels(spark, sf_dir)
    assert audited(docs, labels) == plain(docs, labels)


@pytest.mark.parametrize("make", [odd, none])
def test_odd_rows(spark, make):
    docs = make(spark).withColumn("lang", F.when(F.col("doc_id") > 4, F.col("source")))
    labels = spark.createDataFrame([(1, 1, 0), (5, None, 1), (5, 1, 1), (None, 1, 1), (8, 0, None)], "doc_id long, quality int, toxic int")
    found = audited(docs, labels)
    assert found == plain(docs, labels)
    assert len(found) == 600 * len({r["lang"] or "" for r in docs.collect()})
    assert audited(docs, labels.where("false")) == plain(docs, labels.where("false"))


def test_a_group_of_copies_with_most_rows(spark):
    rows = [(i, "the same words " * 40 if i % 3 else f"word {i}", "en") for i in range(3000)] + [(None, "the same words " * 40, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2, i % 5 == 0) for i in range(0, 3000, 7)], "doc_id long, quality int, toxic boolean")
    labels = labels.withColumn("toxic", F.col("toxic").cast("int"))
    assert audited(docs, labels) == plain(docs, labels)


def test_rules():
    assert filter_audit.failures("") == (True, False, False, False)
    assert filter_audit.failures("A a a a a a a a a a") == (True, True, False, False)
    assert filter_audit.failures("Ab\x85cd é" + " x|") == (True, False, False, True)
    assert filter_audit.failures("AB cdefgh") == (True, False, True, False)
    words = " ".join(f"w{i}" for i in range(100))
    assert filter_audit.failures(words) == (False,) * 4
    assert filter_audit.failures(words + " w1" * 26) == (False, True, False, False)
    assert filter_audit.failures(words + " w1" * 25) == (False,) * 4


def test_lookup_of_busy_and_null_keys(spark):
    rows = [("a", i) for i in range(50)] + [("b", 50), (None, 51), ("c", 52), (None, 53)]
    table = tables.written(spark.createDataFrame(rows, "k string, v int"), "rows")
    side = spark.createDataFrame([("a", 1), ("b", 2), ("z", 3)], "k string, w int")
    expected = sorted((k, v, {"a": 1, "b": 2}.get(k)) for k, v in rows if k) + [(None, 51, None), (None, 53, None)]
    for busy in (1, 2, 1000):
        found = [tuple(r) for r in tables.looked_up(table, side, "k", busy).collect()]
        assert sorted(found, key=lambda r: (r[0] is None, r)) == expected
