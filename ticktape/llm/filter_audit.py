"""How filters interact when they run one after another, in every order: what each removes, repeats and costs.

Every filter has a relation of its own, a stored table of the ids of the rows that fail it.  What a filter removes after some others
have run depends on which ran, not on their order, so all orders of n filters come down to the subsets that can go before it:

* removals: a filter's failing rows, left-anti joined with the relations of the subset;
* redundancies: the same rows, left-semi joined with them;
* survivors: the rows that fail anything, left-anti joined with the relations of the subset, and those that fail nothing.

One join of each kind does it for all subsets: a row is put beside every subset after it has been dealt out by its id, so what travels is
an id once per relation and never a text.  Only counts by part, filter and subset are kept; orders, shares and the sums over all
orders are read from them.

Defined cases: a null text is empty, a null part is the empty part; a row without a key is no copy and has no label; rows that
repeat a key and a text are no copies of each other, as neither key is smaller; no rows give no parts and no result; other columns
are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from itertools import permutations
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ticktape.llm.tables import looked_up, text_of, written

# The filters of the query.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SYMBOL = re.compile(r"[#$%&*|]")
_TEXT_RULES = "a boolean, b boolean, c boolean, d boolean"


def failures(text: str) -> tuple[bool, bool, bool, bool]:
    """Which of the four rules on a text alone it fails: too short, repetitive, too many capitals, any symbol."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes: exactly the six ASCII blanks
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    return (
        len(words) < LEAST_WORDS, 100 * len(set(words)) < LEAST_DISTINCT * len(words),
        100 * capitals > MOST_CAPITALS * len(text), _SYMBOL.search(text) is not None,
    )


def text_rules(text: Column) -> Column:
    @pandas_udf(_TEXT_RULES)
    def judged(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([failures(t) for t in batch], columns=list("abcd"), dtype="bool")

    return judged(text)


def measured(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Every document as a narrow row: ``row`` (its number), ``part``, ``good``, ``toxic``, and ``A`` to ``E``, the filters it fails."""
    body = text_of(text)
    told = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(body, 256)).alias("mark"), text_rules(body).alias("fails"),
    )
    told = written(told.select("row", "key", "part", "mark", *[F.col(f"fails.{c}").alias(c.upper()) for c in "abcd"]), "rules")
    firsts = told.groupBy("mark").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = looked_up(told, written(firsts, "firsts"), "mark").withColumn("E", F.coalesce(F.col("key") > F.col("first"), F.lit(False)))
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key"))
    known = known.agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    marked = looked_up(written(copies.drop("mark", "first"), "copies"), known.where("good OR toxic"), "key")
    return written(marked.select("row", "part", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")], *"ABCDE"), "judged")


def relations(rows: DataFrame, names: str = "ABCDE") -> dict[str, DataFrame]:
    """One stored table per filter: ``row``, ``part`` and labels of the rows that fail it."""
    return {n: written(rows.where(F.col(n)).select("row", "part", "good", "toxic"), f"failing-{n}") for n in names}


def _subsets(bits: list[int]) -> list[int]:
    return [sum(b for i, b in enumerate(bits) if chosen >> i & 1) for chosen in range(1 << len(bits))]


def interactions(rows: DataFrame, failing: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Counts by part and subset: ``part, before, kept`` of the rows that pass all of the subset ``before``, and ``part, filter, before,
    removed, redundant, good_lost, toxic_lost`` of each filter after it.  Filters are bits in the order of ``failing``."""
    bits = {name: 1 << i for i, name in enumerate(failing)}
    every = None
    tagged = None
    for name, table in failing.items():
        ids, own = table.select(F.col("row").alias("failed"), F.lit(bits[name]).alias("bit")), table.withColumn("filter", F.lit(bits[name]))
        every, tagged = (ids, own) if every is None else (every.unionByName(ids), tagged.unionByName(own))
    on_row = F.col("row") == F.col("failed")
    clean = rows.join(every, on_row, "left_anti").groupBy("part").agg(F.count("*").alias("clean"))
    flawed = rows.join(every, on_row, "left_semi").select("row", "part", "good", "toxic", F.lit(0).alias("filter"))
    others = {0: _subsets(list(bits.values()))} | {b: _subsets([o for o in bits.values() if o != b]) for b in bits.values()}
    choice = F.create_map(*[x for b, subsets in others.items() for x in (F.lit(b), F.array(*map(F.lit, subsets)))])
    # dealt out by row first: the subsets are put beside a row after it has travelled
    dealt = tagged.unionByName(flawed).repartition("row").withColumn("before", F.explode(choice[F.col("filter")]))
    hit = on_row & (F.col("before").bitwiseAND(F.col("bit")) != 0)
    by = ("part", "filter", "before")
    losses = [F.sum(F.col(c).cast("long")).alias(f"{c}_lost") for c in ("good", "toxic")]
    passed = written(dealt.join(every.hint("shuffle_hash"), hit, "left_anti").groupBy(*by).agg(F.count("*").alias("removed"), *losses), "removed")
    repeated = dealt.where("filter <> 0").join(every.hint("shuffle_hash"), hit, "left_semi")
    redundant = repeated.groupBy(*by).agg(F.count("*").alias("redundant"))

    def grid(names: str, cells: list[tuple]) -> DataFrame:
        """Every part beside every cell, so that zeros are there."""
        listed = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names.split(), c)]) for c in cells])
        return rows.groupBy("part").agg(F.count("*").alias("n")).withColumn("cell", F.explode(listed)).select("part", "cell.*")

    survivors = passed.where("filter = 0").select("part", "before", F.col("removed").alias("passed"))
    kept = grid("before", [(s,) for s in others[0]]).join(survivors, ["part", "before"], "left").join(clean, "part", "left")
    kept = kept.select("part", "before", (F.coalesce("passed", F.lit(0)) + F.coalesce("clean", F.lit(0))).alias("kept"))
    cells = grid("filter before", [(b, s) for b in bits.values() for s in others[b]])
    cells = cells.join(passed, list(by), "left").join(redundant, list(by), "left").na.fill(0)
    return kept, cells


def audit(rows: DataFrame, failing: Mapping[str, DataFrame]) -> DataFrame:
    """For every part, every order of the filters and every step: what the step's filter keeps, removes, repeats and loses."""
    spark, names, n = rows.sparkSession, "".join(failing), len(failing)
    kept, cells = interactions(rows, failing)
    kept, cells = written(kept, "kept"), written(cells, "cells")
    bits = {name: 1 << i for i, name in enumerate(names)}
    share = [factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) if s.bit_count() < n else 0 for s in range(1 << n)]
    alone = F.max(F.when(F.col("before") + F.col("filter") == (1 << n) - 1, F.col("removed"))).alias("unique_fails")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in share]), F.col("before") + 1)
    sums = cells.groupBy("part", "filter").agg(alone, F.sum(F.col("removed") * weight).alias("shapley"))
    steps = [
        ("".join(order), at + 1, bits[f], sum(bits[x] for x in order[:at])) for order in permutations(names) for at, f in enumerate(order)
    ]
    ordered = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, filter int, before int"))
    after = kept.withColumnRenamed("before", "after")
    placed = cells.join(sums, ["part", "filter"]).withColumn("after", F.col("before") + F.col("filter")).join(after, ["part", "after"])
    return placed.join(ordered, ["filter", "before"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def audited(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``audit`` of the five filters on documents."""
    rows = measured(docs, labels, key, text, part)
    return audit(rows, relations(rows))
