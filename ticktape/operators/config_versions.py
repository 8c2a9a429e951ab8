"""A filter configuration that changes while events flow: every event meets the criteria that held when it arrived.

Configurations are kept as a log of changes, rows of ``effective_from, pair, criteria``.  A change holds for its pair from that place
of the arrival order on, itself included, until the pair's next one; NULL ``criteria`` withdraw the pair's entry, so that its
trades pass again.  Before a pair's first change its trades pass.

Defined edges: a trade without a pair or without a place in the order passes; an empty log lets everything pass; a pair with two changes
at one place, or an incomplete change, is a ``FilterConfigError``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticktape import schemas as S
from ticktape.operators.filters import EventFilter, table_criterion
from ticktape.operators.lookup import MAX_BROADCAST_BYTES, text_bytes
from ticktape.operators.price_action import arrival_of
from ticktape.sources.filter_config import check_filter_changes

#: A pair's changes are searched in a row's array up to this number, beyond it they meet the trades in order.
MAX_IN_ARRAY = 64
_BUCKET_BITS = 17


def in_force(changes: DataFrame, at: int) -> DataFrame:
    """The configuration (``pair, criteria``) that holds at one place of the order."""
    newest = F.max_by(F.struct("criteria"), "effective_from")
    held = changes.where(F.col("effective_from") <= at).groupBy("pair").agg(newest.alias("_newest"))
    return held.select("pair", F.col("_newest.criteria").alias("criteria")).where(F.col("criteria").isNotNull())


def supersede(changes: DataFrame, config: DataFrame, effective_from: int) -> DataFrame:
    """The changes by which ``config`` takes the place of what holds then: new, other and withdrawn entries only."""
    old = in_force(changes, effective_from).select("pair", F.col("criteria").alias("_old"))
    both = old.join(config.select("pair", "criteria"), "pair", "full_outer")
    differs = both.where(~F.col("_old").eqNullSafe(F.col("criteria")))
    return differs.select(F.lit(effective_from).cast("long").alias("effective_from"), "pair", "criteria")


def versioned(
    changes: DataFrame,
    order: str = "ingest_seq",
    max_in_array: int = MAX_IN_ARRAY,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    bucket_bits: int = _BUCKET_BITS,
) -> EventFilter:
    """The filter that a log of changes makes of trades ordered by the whole number ``order``.

    A short log, by bytes and by the changes of its busiest pair, is broadcast as one row per pair.  A longer one meets the trades in a
    union dealt out by (pair, range of the order), so neither a busy pair nor one that changes all the time is one task; that form reads
    the trades once for the ranges and takes no stream (a micro-batch will do).
    """
    check_filter_changes(changes)
    column = f"_criteria_{uuid.uuid4().hex}"
    busiest = changes.groupBy("pair").count().agg(F.max("count").alias("n")).first()["n"] or 0
    if busiest <= max_in_array and text_bytes(changes) <= max_broadcast_bytes:
        prepare = lambda trades: _from_array(trades, changes, order, column)
    else:
        prepare = lambda trades: _in_order(trades, changes, order, column, bucket_bits)
    return EventFilter(S.TRADE, F.coalesce(F.forall(column, table_criterion), F.lit(True)), prepare)


def _from_array(trades: DataFrame, changes: DataFrame, order: str, column: str) -> DataFrame:
    history = changes.groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("effective_from", "criteria"))).alias(column))
    reached = F.filter(column, lambda c: c["effective_from"] <= F.col(order))
    return trades.join(F.broadcast(history), "pair", "left").select(
        *trades.columns, F.try_element_at(reached, F.lit(-1))["criteria"].alias(column)
    )


def _in_order(trades: DataFrame, changes: DataFrame, order: str, column: str, bucket_bits: int) -> DataFrame:
    if trades.isStreaming:
        raise ValueError("a log of changes of this size takes batches, not a stream: use it inside foreachBatch")
    # Ranges from the trades; a change falls into the range of its place.
    arrival = arrival_of(trades.select(F.col(order).cast("long").alias("ingest_seq")), bucket_bits)
    buckets = [f"_bucket{i}" for i in range(len(arrival.bucket))]
    keys, place = ["pair", *buckets], F.col("ingest_seq")
    events = trades.select("pair", F.col(order).cast("long").alias("ingest_seq"), F.struct(*trades.columns).alias("_event"))
    entries = changes.select("pair", F.col("effective_from").alias("ingest_seq"), F.struct("criteria").alias("_change"))
    both = events.unionByName(entries, allowMissingColumns=True)
    dealt = both.select("*", *[c.alias(name) for c, name in zip(arrival.bucket, buckets)]).repartition(*keys)

    # Of each group only its last change travels on, to the groups of the pair that follow.  The whole row, so that both uses share
    # one exchange.
    last = F.max_by(F.struct(*dealt.columns), F.when(F.col("_change").isNotNull(), place))
    before = Window.partitionBy("pair").orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)
    closing = dealt.groupBy(*keys).agg(last.alias("_last")).select(*keys, F.col("_last._change").alias("_last"))
    opening = closing.select(*keys, F.last("_last", ignorenulls=True).over(before).alias("_before"))
    # A change comes before the trades of its place.
    inside = Window.partitionBy(*keys).orderBy(place.asc_nulls_first(), F.col("_event").isNotNull())
    latest = F.last("_change", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    held = dealt.join(opening, keys, "left").select("_event", F.coalesce(latest, "_before").alias("_held"))
    return held.where(F.col("_event").isNotNull()).select("_event.*", F.col("_held.criteria").alias(column))
