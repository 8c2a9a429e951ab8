"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Targets: the sources share ``share`` of all tokens by weight; a source stops at ``most`` times its own size and what it
   cannot take is shared again by weight until none is above.
2. The mix is so many blocks of ``BLOCK`` tokens.  They go to the sources by highest quotients target / (2 k + 1), and a
   source's blocks go to its shards the same way by the shards' sizes.  That gives every shard an integer quota.
3. In a shard, documents lie in a seeded order and are cut into equal blocks; the quota takes every block as often as it
   fills whole rounds, and one run of further blocks from a seeded start, around the end.  A document is taken whole or
   not at all but where a run begins or ends inside it.

A source has a shard for every ``SHARD_ROWS`` documents, or its part of ``SHARDS`` shards in all where that is less, so a source that
holds a third of all rows is spread over many tasks and the shards' table has a bounded size.  Sources are counted in Spark; their
table comes to the driver, as a list of weights has to, and more than ``MOST_SOURCES`` sources are an error.

Only sizes are sorted and summed.  A shard's run comes down to the places where it begins and ends, so ``mix`` reads the texts once,
where they lie: a document before, inside or behind the run is left, taken or left.  Only those that a run cuts, a few of a
shard, are put beside their spans by a join.  ``twin``, a hash of the whole row, tells rows of one key and text apart.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own, last in order; identical
rows lie next to each other in their shard, and one of them stands for all that a run cuts; a mix of nothing is empty.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticktape.llm.tables import text_of, written

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
BLOCK, SHARD_ROWS, SHARDS, SEED = 16, 512, 1 << 16, 17
MOST_SOURCES = 100_000
_WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of runs of anything but the six ASCII blanks."""
    flat = F.btrim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "), F.lit(" "))
    return F.when(F.length(flat) == 0, 0).otherwise(F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 1).cast("long")


def targets(sizes: dict, weights: dict, share: float = SHARE, most: int = MOST) -> dict:
    """Exact targets: ``share`` of all sizes by weight, none above ``most`` times its size."""
    total = Fraction(share).limit_denominator(10**6) * sum(sizes.values())
    given, free = {}, dict(weights)
    while free:
        rest, weight = total - sum(given.values()), sum(free.values())
        full = [s for s in free if rest * free[s] / weight > most * sizes[s]]
        if not full:
            return given | {s: rest * w / weight for s, w in free.items()}
        for s in full:
            given[s] = Fraction(most * sizes[s])
            del free[s]
    return given


def highest_quotients(seats: int, weights: list, caps: list[int] | None = None) -> list[int]:
    """Sainte-Lague: ``seats`` to ``weights``, each to the highest weight / (2 taken + 1); ties to the first; none above its cap."""
    caps = caps or [max(0, seats)] * len(weights)
    total, n = sum(weights), len(weights)
    if not total or seats <= 0:
        return [0] * n
    # rounding by a divisor that is too large gives seats that are certain; the rest, fewer than 2 n, is dealt one by one
    sure = max(0, seats - n)
    taken = [min(c, (2 * w * sure + total) // (2 * total)) if sure else 0 for w, c in zip(weights, caps)]
    heap = [(-Fraction(w) / (2 * t + 1), i) for i, (w, t, c) in enumerate(zip(weights, taken, caps)) if w and t < c]
    heapq.heapify(heap)
    for _ in range(seats - sum(taken)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        taken[i] += 1
        if taken[i] < caps[i]:
            heapq.heappush(heap, (-Fraction(weights[i]) / (2 * taken[i] + 1), i))
    return [int(t) for t in taken]


def order_of(key: str, text: str) -> Column:
    """The seeded place of a row among others."""
    return F.xxhash64(F.lit(SEED), F.col(key), F.xxhash64(text_of(text)))


def twin_of(docs: DataFrame) -> Column:
    """A hash of the whole row, whatever its types."""
    plain = [F.to_json(F.struct(f"`{f.name}`")) if any(t in f.dataType.simpleString() for t in ("map<", "variant")) else F.col(f"`{f.name}`") for f in docs.schema.fields]
    return F.xxhash64(*plain)


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``key``, ``source``, ``size``, ``order`` (the seeded place of a row among others) and ``twin``."""
    return docs.select(
        F.col(key).alias("key"), F.col(source).cast("string").alias("source"), n_words(text_of(text)).alias("size"),
        order_of(key, text).alias("order"), twin_of(docs).alias("twin"),
    )


def plan(sizes: DataFrame, share: float = SHARE, most: int = MOST, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Of ``sized`` rows: the sources' table (``no``, ``source_size``, ``target``, ``shards``) and the shards' (``blocks``, ``quota``)."""
    spark = sizes.sparkSession
    found = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    held = {r["source"]: r["size"] for r in found}
    goal = targets(held, {r["source"]: WEIGHTS[i % len(WEIGHTS)] for i, r in enumerate(found)}, share, most)
    seats = highest_quotients(int(sum(goal.values()) / block + Fraction(1, 2)), list(map(goal.get, held)))
    n = sum(r["n"] for r in found)
    shards_of = lambda own: min(-(-own // SHARD_ROWS), -(-own * SHARDS // n))
    rows = [
        (i, r["source"], r["size"], float(goal[r["source"]]), shards_of(r["n"]), q, bool(goal[r["source"]] >= most * r["size"]))
        for i, (r, q) in enumerate(zip(found, seats))
    ]
    known = spark.createDataFrame(rows, "no int, source string, source_size long, target double, shards int, quota long, all_of_it boolean")
    sources = known.drop("quota", "all_of_it")
    shards = sharded(sizes, sources).groupBy("no", "shard").agg(F.sum("size").alias("shard_size"))
    shards = shards.join(F.broadcast(known.select("no", "quota", "all_of_it")), "no")

    def deal(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("shard", kind="stable")
        held, quota = group["shard_size"].tolist(), int(group["quota"].iloc[0])
        blocks = [-(-s // block) for s in held]
        caps = [most * b for b in blocks]
        dealt = caps if group["all_of_it"].iloc[0] else highest_quotients(min(quota, sum(caps)), held, caps)
        return group[["no", "shard", "shard_size"]].assign(blocks=blocks, quota=dealt)

    shape = "no int, shard int, shard_size long, blocks long, quota long"
    return sources, written(shards.groupBy("no").applyInPandas(deal, shape), "quotas")


def sharded(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with their source's columns and their ``shard``; the sources' table is bounded by ``MOST_SOURCES``."""
    named = sources.withColumnRenamed("source", "of")
    own = rows.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    return own.withColumn("shard", F.pmod("order", F.col("shards")).cast("int")).drop("shards")


def placed(rows: DataFrame, quotas: DataFrame, block: int = BLOCK) -> DataFrame:
    """``sharded`` rows with what they give: ``rounds`` times all of their words, and two spans (``skip``, ``take``) to the run."""
    window = Window.partitionBy("no", "shard").orderBy("order", "key", "size", "twin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = rows.withColumn("stop", F.sum("size").over(window)).join(quotas, ["no", "shard"])
    n = F.greatest("blocks", F.lit(1))
    first = F.pmod(F.xxhash64(F.lit(SEED), "no", "shard"), n)
    run = F.col("quota") % n
    # the run covers blocks first .. first + run, around the end: two spans of the shard's words
    spans = (
        (first * block, F.least((first + run) * block, F.col("shard_size"))),
        (F.lit(0), F.least(F.greatest(first + run - n, F.lit(0)) * block, F.col("shard_size"))),
    )
    begin = F.col("stop") - F.col("size")
    given = []
    for a, b in spans:
        skip = F.greatest(a - begin, F.lit(0))
        take = F.greatest(F.least("stop", b) - F.greatest(begin, a), F.lit(0))
        given.append(F.struct(skip.cast("long").alias("skip"), take.cast("long").alias("take")))
    return at.withColumn("rounds", F.floor(F.col("quota") / n).cast("long")).withColumn("spans", F.array(*given))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: key, source, size, its source's size and target, and the words taken, repeats counted."""
    sizes = written(sized(docs, key, text, source), "sizes")
    sources, quotas = plan(sizes)
    taken = F.col("rounds") * F.col("size") + F.col("spans")[0]["take"] + F.col("spans")[1]["take"]
    return placed(sharded(sizes, sources), quotas).select(
        F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", taken.alias("taken")
    )


def _runs(given: DataFrame) -> DataFrame:
    """One row per shard that gives anything: its ``rounds``, the first and last place that each span of its run takes whole
    (``from0, to0, from1, to1``), and ``cuts``, the places that a run cuts; there are four at most."""
    at, takes = F.struct("order", "twin"), [F.col("spans")[i]["take"] for i in (0, 1)]
    alike = given.groupBy("no", "shard", "order", "twin").agg(
        F.first("rounds").alias("rounds"),
        *[F.min(F.coalesce(t == F.col("size"), F.lit(False)) & (F.col("size") > 0)).alias(f"in{i}") for i, t in enumerate(takes)],
        F.max(takes[0] + takes[1]).alias("most"),
    )
    inside = [F.when(F.col(f"in{i}"), at) for i in (0, 1)]
    cut = F.when((F.col("most") > 0) & ~F.col("in0") & ~F.col("in1"), at)
    ends = [a for i, x in enumerate(inside) for a in (F.min(x).alias(f"from{i}"), F.max(x).alias(f"to{i}"))]
    runs = alike.groupBy("no", "shard").agg(F.max("rounds").alias("rounds"), *ends, F.collect_set(cut).alias("cuts"))
    return runs.where("rounds > 0 OR from0 IS NOT NULL OR from1 IS NOT NULL OR size(cuts) > 0")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for every time a document is taken, its text cut to the words
    taken where a run begins or ends inside it."""
    sizes = written(sized(docs, key, text, source), "sizes")
    sources, quotas = plan(sizes)
    places = ["no", "shard", "order", "twin"]
    given = written(placed(sharded(sizes, sources), quotas).select(*places, "size", "rounds", "spans"), "given")
    runs = written(_runs(given), "runs")
    told = docs.select(F.struct("*").alias("row"), F.col(source).cast("string").alias("source"), order_of(key, text).alias("order"), twin_of(docs).alias("twin"))
    at, old = F.struct("order", "twin"), F.col("row").getField(text)
    # the shards' table is bounded by SHARDS and MOST_SOURCES
    rows = sharded(told, sources).join(F.broadcast(runs), ["no", "shard"]).where(text_of("row." + text).rlike(_WORD))
    rows = rows.withColumn("is_cut", F.array_contains("cuts", at))
    inside = [F.coalesce(at.between(F.col(f"from{i}"), F.col(f"to{i}")), F.lit(False)).cast("long") for i in (0, 1)]
    whole = rows.where("NOT is_cut").select("row", F.explode(F.array_repeat(F.lit(0), (F.col("rounds") + inside[0] + inside[1]).cast("int"))))
    one = rows.where("is_cut").groupBy(*places).agg(F.first("row").alias("row"))
    parts = F.filter(
        F.concat(F.array_repeat(F.struct(F.lit(0).cast("long").alias("skip"), F.col("size").alias("take")), F.col("rounds").cast("int")), "spans"),
        lambda s: s["take"] > 0,
    )
    taken = given.join(one, places).select("row", "size", F.explode(parts).alias("span"))
    words = F.regexp_extract_all(old, F.lit(_WORD), F.lit(0))
    cut = F.array_join(F.slice(words, (F.col("span.skip") + 1).cast("int"), F.col("span.take").cast("int")), " ")
    new = F.when(F.col("span.take") == F.col("size"), old).otherwise(cut)
    fields = {f.name: F.col("row").getField(f.name) for f in docs.schema.fields}
    shape = lambda part, body: part.select(*[(body if n == text else c).alias(n) for n, c in fields.items()])
    return shape(whole, old).unionByName(shape(taken, new))
