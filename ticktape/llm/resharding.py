"""Minimum-cost-flow resharding: new shard capacities with the fewest bytes moved.

Old shards are supplies, new shards demands.  Bytes that stay in their shard cost nothing, bytes that move cost one each; the
flow is solved by successive shortest paths over a graph of a few edges per shard (moves go through one hub), which
gives for every old shard the byte spans that stay and that go elsewhere.  Inside an old shard documents lie largest
first, and a document goes where the middle of its bytes lies, so the ends of spans fall among the smallest documents and
shards come out equal to within a small document.

Places are running sums over (shard, size class, part) groups whose number follows the rows, so no group is large,
however large a shard is; only shard totals come to the driver.  Texts are not shuffled by the plan.

Defined cases: a null text has no bytes and still its fixed overhead; null keys are placed by their text; repeated rows
each get a place; no rows give no rows; a document larger than a shard's capacity stays whole.  Groups of equal
texts are not kept together: a group may hold a third of all rows, and sizes come first.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticktape.llm.tables import text_of, written

NEW_SHARDS, OLD_SHARDS, OVERHEAD = 40, 32, 16
#: Documents in a group of a running sum, about; shards at most.
GROUP_ROWS, MOST_SHARDS = 512, 100_000


def min_cost_flow(n: int, edges: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each edge (from, to, capacity, cost) of a cheapest maximum flow, by successive shortest paths."""
    to, room, cost, out = [], [], [], [[] for _ in range(n)]
    for a, b, capacity, price in edges:
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            out[x].append(len(to))
            to.append(y)
            room.append(c)
            cost.append(p)
    potential = [0] * n
    while True:
        far, via, queue = [None] * n, [None] * n, [(0, source)]
        far[source], settled = 0, [False] * n
        while queue:
            d, x = heapq.heappop(queue)
            if settled[x]:
                continue
            settled[x] = True
            for e in out[x]:
                if room[e]:
                    y, new = to[e], d + cost[e] + potential[x] - potential[to[e]]
                    if far[y] is None or new < far[y]:
                        far[y], via[y] = new, e
                        heapq.heappush(queue, (new, y))
        if far[sink] is None:
            return [room[2 * i + 1] for i in range(len(edges))]
        for x in range(n):
            if far[x] is not None:
                potential[x] += far[x]
        # push along every shortest path that is left, found depth first over edges of no reduced cost
        next_edge = [0] * n
        while True:
            path, x, seen = [], source, {source}
            while x != sink:
                while next_edge[x] < len(out[x]):
                    e = out[x][next_edge[x]]
                    if room[e] and to[e] not in seen and cost[e] + potential[x] - potential[to[e]] == 0:
                        break
                    next_edge[x] += 1
                else:
                    if not path:
                        break
                    seen.discard(x)
                    x = to[path.pop() ^ 1]
                    next_edge[x] += 1
                    continue
                path.append(e)
                x = to[e]
                seen.add(x)
            if x != sink:
                break
            pushed = min(room[e] for e in path)
            for e in path:
                room[e] -= pushed
                room[e ^ 1] += pushed


def transfers(old: dict[int, int], capacities: list[int]) -> list[tuple[int, int, int]]:
    """(old shard, new shard, bytes) of a plan that moves the fewest bytes; what stays comes first for each old shard."""
    names = sorted(old)
    hub = len(names) + len(capacities)
    source, sink = hub + 1, hub + 2
    edges = [(source, i, old[s], 0) for i, s in enumerate(names)]
    edges += [(len(names) + j, sink, c, 0) for j, c in enumerate(capacities)]
    stay = [(i, s) for i, s in enumerate(names) if 0 <= s < len(capacities)]
    edges += [(i, len(names) + s, min(old[s], capacities[s]), 0) for i, s in stay]
    edges += [(i, hub, old[s], 1) for i, s in enumerate(names)]
    edges += [(hub, len(names) + j, c, 0) for j, c in enumerate(capacities)]
    flow = min_cost_flow(hub + 3, edges, source, sink)
    at = len(names) + len(capacities)
    kept = [(names[i], s, f) for (i, s), f in zip(stay, flow[at:]) if f]
    at += len(stay)
    leave = [[s, f] for s, f in zip(names, flow[at:]) if f]
    at += len(names)
    arrive = [[j, f] for j, f in enumerate(flow[at:]) if f]
    moved = []
    while leave and arrive:  # the hub's bytes, paired in order
        n = min(leave[0][1], arrive[0][1])
        moved.append((leave[0][0], arrive[0][0], n))
        for side in (leave, arrive):
            side[0][1] -= n
            if not side[0][1]:
                side.pop(0)
    return sorted(kept + moved, key=lambda t: (t[0], t[0] != t[1], t[1]))


def even(total: int, shards: int) -> list[int]:
    return [total * (i + 1) // shards - total * i // shards for i in range(shards)]


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``size``, ``text_crc32`` and ``place``, a hash of the row."""
    body = text_of(text)
    crc = F.crc32(body.cast("binary"))
    return docs.select(
        F.col(key).alias("key"), (F.octet_length(body) + OVERHEAD).cast("long").alias("size"), crc.alias("text_crc32"),
        F.xxhash64(F.col(key), body).alias("place"),
    )


def _running(rows: DataFrame, shard: str, order: list[str], value: Column, parts: Column, by: list[Column]) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over the rows of the same shard that come earlier by ``order`` (columns of the
    group, the last of them ``part``) and then by ``by``."""
    rows = rows.withColumn("part", F.pmod(F.col("place"), parts)).withColumn("value", value)
    group = [shard, *order, "part"]
    sums = rows.groupBy(*group).agg(F.sum("value").alias("whole"))
    over = Window.partitionBy(shard).orderBy(*[F.col(c).desc() for c in order], "part")
    starts = sums.withColumn("start", F.sum("whole").over(over) - F.col("whole")).drop("whole")
    inside = Window.partitionBy(*group).orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("inside", F.sum("value").over(inside) - F.col("value"))
    return placed.join(starts, group).withColumn("before", F.col("start") + F.col("inside")).drop("part", "value", "inside", "start")


def reshard(rows: DataFrame, old_shard: str = "old_shard", shards: int = NEW_SHARDS, capacities: list[int] | None = None) -> DataFrame:
    """``measured`` rows with a column of their old shard get their new ``shard`` and a gapless ``slot`` in it.

    ``rows`` is read several times, so it should be a written table.
    """
    spark = rows.sparkSession
    totals = rows.groupBy(old_shard).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).limit(MOST_SHARDS + 1).collect()
    if len(totals) > MOST_SHARDS or shards > MOST_SHARDS:
        raise ValueError(f"more than {MOST_SHARDS} shards")
    old = {r[old_shard]: r["bytes"] for r in totals}
    n = sum(r["n"] for r in totals)
    capacities = capacities or even(sum(old.values()), shards)
    if sum(capacities) < sum(old.values()):
        raise ValueError("the new shards hold less than the old ones")
    spans, at = [], {}
    for source, target, size in transfers(old, capacities):
        spans.append((source, target, at.get(source, 0), at.get(source, 0) + size))
        at[source] = spans[-1][3]
    moves = spark.createDataFrame(spans, "of int, shard int, begin long, stop long")  # a few rows per shard
    class_ = rows.withColumn("class", F.floor(F.log2("size")).cast("int"))
    parts = F.lit(max(1, n // (GROUP_ROWS * max(1, len(old)))))
    lying = _running(class_, old_shard, ["class"], F.col("size"), parts, [F.col("size").desc(), "place", "key"])
    middle = F.col("before") + F.floor(F.col("size") / 2)
    sent = lying.join(F.broadcast(moves), (F.col(old_shard) == F.col("of")) & (middle >= F.col("begin")) & (middle < F.col("stop")))
    sent = sent.drop("of", "begin", "stop", "class", "before")
    parts = F.lit(max(1, n // (GROUP_ROWS * shards)))
    return _running(sent, "shard", [], F.lit(1).cast("long"), parts, ["place", "key"]).withColumnRenamed("before", "slot")


def rewrite(docs: DataFrame, placed: DataFrame, path: str, key: str = "doc_id", text: str = "text", old_shard: str = "old_shard") -> list[int]:
    """Writes under ``path`` the files of the shards that gain or lose a document (``shard=<n>``) and of no other; returns
    their numbers.  ``placed`` is a ``reshard`` result with one row per row of ``docs``."""
    moved = placed.where(F.col(old_shard) != F.col("shard"))
    touched = moved.select(F.explode(F.array(old_shard, "shard")).alias("s")).distinct().collect()  # shard numbers
    affected = sorted(r["s"] for r in touched)
    same = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col(key), text_of(text)).alias("place"))
    # equal rows have equal places and any order among them will do
    number = lambda df: df.withColumn("copy", F.row_number().over(Window.partitionBy("place").orderBy(F.lit(0))))
    target = number(placed.where(F.col("shard").isin(affected)).select("place", "shard", "slot"))
    rows = number(same).join(target, ["place", "copy"]).select("row.*", "shard", "slot")
    rows.repartition("shard", F.floor(F.col("slot") / 100_000)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    return affected


def resharded(docs: DataFrame, shards: int = NEW_SHARDS, old_shards: int = OLD_SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows moved from ``old_shards`` shards by hash to ``shards`` equal ones."""
    rows = measured(docs, key, text).withColumn("old_shard", F.pmod(F.xxhash64("place"), F.lit(old_shards)).cast("int"))
    return reshard(written(rows, "sizes"), shards=shards).withColumnRenamed("key", key)
