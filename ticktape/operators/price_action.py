"""Price action: each bar's close against the last close seen for its pair, and spike/drop alerts."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticktape import schemas as S
from ticktape.functions import floats as N

DEFAULT_THRESHOLD = 0.0001  # fixed value: percent

_BUCKET_BITS = 17
#: Buckets at most where the order has several columns; beyond 2^29 frames they grow instead of becoming more.
_MOST_BUCKETS = 4096
#: Buckets at most of the first level where the order is one number; a second level has no limit.
_MOST_QUANTILES = 1024
#: Size of a quantile sketch: places are right within about a tenth of a percent of the rows.
_SKETCH = 4096
#: Sketches merged side by side before the last one.
_SKETCHED_TOGETHER = 64
#: Sampled rows per bucket from which the bounds are taken.
_SAMPLED = 32


@dataclass(frozen=True)
class Arrival:
    """The order in which bars arrived, in two levels.

    ``bucket`` columns rise with the order and ``rank`` columns order the bars inside a bucket.  A bucket is
    small enough for one task even when it holds bars of a single pair only.
    """

    bucket: tuple[Column, ...]
    rank: tuple[Column, ...]


def arrival_of(bars: DataFrame, bucket_bits: int = _BUCKET_BITS, order_from: DataFrame | None = None) -> Arrival:
    """Arrival by the ingest columns, else by bar time, in buckets of about 2^bucket_bits rows.

    Buckets are ranges of the order, so neither sparse sequence numbers nor many small files make more of them.  Where the
    order is one number, their bounds come from one pass, a quantile sketch; else from a count and a sample.
    ``order_from`` is what to read for that instead of ``bars``: the frames, say, which need no decoding for it.
    """
    if "ingest_seq" not in bars.columns:
        order, rank = ["end_time"], ("end_time", "timestamp", "event_type")
    else:
        order = [c for c in S.ARRIVAL_COLUMNS[:3] if c in bars.columns]
        rank = (*order, "pos") if "pos" in bars.columns else tuple(order)
    rows, rank = bars if order_from is None else order_from, tuple(F.col(c) for c in rank)
    if len(order) == 1 and isinstance(rows.schema[order[0]].dataType, T.IntegralType):
        return Arrival(_sketched_buckets(rows, order[0], 1 << bucket_bits), rank)
    return Arrival((_bucket(order, _range_cuts(rows, order, 1 << bucket_bits)),), rank)


def _sketched_buckets(rows: DataFrame, column: str, per_bucket: int) -> tuple[Column, ...]:
    """Buckets of about ``per_bucket`` rows by ranges of one number, found in one reading of ``rows``.

    Up to 1,024 ranges hold equal shares; if that is too few, each is cut further into spans of equal width.  Rows that
    crowd in a part of a range make uneven spans, but never a wrong order.
    """
    group = (F.spark_partition_id() % _SKETCHED_TOGETHER).alias("group")
    partial = rows.select(F.col(column).cast("long").alias("v"), group).groupBy("group").agg(F.kll_sketch_agg_bigint("v", _SKETCH).alias("s"))
    whole = partial.agg(F.kll_merge_agg_bigint("s", _SKETCH).alias("s"))
    places = F.array(*[F.lit(i / _MOST_QUANTILES) for i in range(_MOST_QUANTILES + 1)])
    n = F.kll_sketch_get_n_bigint("s")
    found = whole.select(n.alias("n"), F.when(n > 0, F.kll_sketch_get_quantile_bigint("s", places)).alias("places")).first()
    wanted = -(-(found["n"] or 0) // per_bucket)
    if wanted < 2:
        return (F.lit(0),)
    first = min(_MOST_QUANTILES, 1 << (wanted - 1).bit_length())
    low, *between, high = found["places"][:: _MOST_QUANTILES // first]
    cuts = sorted(set(between))
    bucket = _bucket([column], [(c,) for c in cuts])
    spans = -(-wanted // first)
    if spans == 1:
        return (bucket,)
    # Differences of 64-bit numbers, exact and without overflow, then as doubles.
    bounds = F.array(*[F.lit(b) for b in (low, *cuts, high)])
    start, end = (F.element_at(bounds, bucket + i).cast("decimal(20,0)") for i in (1, 2))
    into, width = (F.col(column).cast("decimal(20,0)") - start).cast("double"), (end - start).cast("double")
    part = F.floor(into / F.nullif(width, F.lit(0.0)) * F.lit(float(spans)))
    return bucket, F.greatest(F.lit(0), F.least(F.lit(spans - 1), F.coalesce(part, F.lit(0)))).cast("int")


def _order_value(columns: list[str]) -> Column:
    """The order as one comparable value, of types that survive a trip to the driver."""
    parts = [F.unix_micros(F.col(c).cast("timestamp")) if c == "ingest_ts" else F.col(c) for c in columns]
    return F.struct(*[p.alias(f"o{i}") for i, p in enumerate(parts)])


def _range_cuts(rows: DataFrame, order: list[str], per_bucket: int) -> list[tuple]:
    """Bounds that cut ``rows`` into ranges of about ``per_bucket``; a sample of bounded size comes to the driver."""
    n = rows.count()
    buckets = min(_MOST_BUCKETS, -(-n // per_bucket))
    if buckets < 2:
        return []
    values = rows.select(_order_value(order).alias("v"))
    if n > 2 * buckets * _SAMPLED:
        values = values.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < (buckets * _SAMPLED << 30) // n)
    sample = sorted((tuple(r["v"]) for r in values.collect() if None not in tuple(r["v"])))
    return sorted({sample[i * len(sample) // buckets] for i in range(1, buckets)}) if sample else []


def _bucket(order: list[str], cuts: list[tuple]) -> Column:
    """How many cuts lie at or below a row, counted in two levels: first among every sixteenth cut or so."""
    if not cuts:
        return F.lit(0)
    value = _order_value(order)
    literal = lambda some: F.array(*[F.struct(*[F.lit(x).alias(f"o{i}") for i, x in enumerate(c)]) for c in some])
    reached = lambda some: F.size(F.filter(some, lambda c: c <= value))
    step = max(1, math.isqrt(len(cuts)))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    whole = F.greatest(reached(literal([g[0] for g in groups])) - 1, F.lit(0))
    return whole * step + reached(F.element_at(F.array(*map(literal, groups)), whole + 1))


def price_action(
    bars: DataFrame,
    threshold: float = DEFAULT_THRESHOLD,
    scope: str = "pair",
    arrival: Arrival | None = None,
    carried: DataFrame | None = None,
    beside: tuple[str, ...] = (),
) -> DataFrame:
    """Bars with ``last``, ``direction`` (up, down, same), ``pct`` and ``kind`` (spike, drop or NULL).

    ``scope='pair'`` compares with the pair's previous close, minute and second bars alike; a pair's first bar
    is compared with its own open, or with the pair's price in ``carried`` (``pair, last``) if there is one.
    ``scope='bar'`` compares every bar with its own open.  ``beside`` names columns of ``bars`` whose value in the pair's previous bar
    is wanted as ``last_<name>`` (scope ``pair`` only; NULL for a pair's first bar here).

    Bars are dealt out by (pair, bucket), once; the previous close is found inside a group, and only the last
    close of each group travels on, to the first bar of the pair's next one.  So a pair that holds much of the
    data is still spread over many tasks.
    """
    if scope == "bar":
        return _measure(bars.withColumn("last", F.col("open")), threshold)
    if scope != "pair":
        raise ValueError(f"scope must be 'pair' or 'bar', not {scope!r}")
    arrival = arrival or arrival_of(bars)
    keys = ["pair", *_bucket_names(arrival)]
    dealt = _with_buckets(bars, arrival).repartition(*keys)
    # The whole last row, not its close alone: with other columns this would be another exchange, and another
    # reading of the source.
    latest = F.max_by(F.struct(*dealt.columns), F.struct(*arrival.rank))
    wanted = ("close", *beside)
    closing = dealt.groupBy(*keys).agg(latest.alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(f"_{c}") for c in wanted])
    # A pair has one row here per bucket.
    by_bucket = Window.partitionBy("pair").orderBy(*keys[1:])
    opening = closing.select(*keys, *[F.lag(f"_{c}").over(by_bucket).alias(f"_before_{c}") for c in wanted])
    if carried is not None:
        seed = carried.select("pair", F.col("last").alias("_seed"))
        opening = opening.join(seed, "pair", "left").withColumn("_before_close", F.coalesce("_before_close", "_seed")).drop("_seed")
    # The order ends in all columns, so that no column is pruned on this side alone: the two sides would not share the
    # exchange any more, and the source would be read and decoded twice.
    inside = Window.partitionBy(*keys).orderBy(*arrival.rank, F.xxhash64(*_hashable(bars)))
    previous = {c: F.coalesce(F.lag(c).over(inside), f"_before_{c}") for c in wanted}
    rows = dealt.join(opening, keys).withColumn("last", F.coalesce(previous.pop("close"), "open"))
    rows = rows.withColumns({f"last_{c}": value for c, value in previous.items()}) if beside else rows
    return _measure(rows.select(*bars.columns, "last", *[f"last_{c}" for c in beside]), threshold)


def last_prices(bars: DataFrame, arrival: Arrival | None = None, carried: DataFrame | None = None) -> DataFrame:
    """The last close of every pair (``pair, last``), keeping ``carried`` pairs that have no bar here.

    Closes are combined on the map side, so any pair may hold any share of the bars.
    """
    arrival = arrival or Arrival((), arrival_of(bars.limit(0)).rank)
    latest = bars.groupBy("pair").agg(F.max_by("close", F.struct(*arrival.bucket, *arrival.rank)).alias("last"))
    if carried is None:
        return latest
    kept = carried.select("pair", "last").join(latest.select("pair"), "pair", "left_anti")
    return latest.unionByName(kept)


def _hashable(rows: DataFrame) -> list[str]:
    return [f.name for f in rows.schema if not any(t in f.dataType.json() for t in ('"map"', "variant"))]


def _bucket_names(arrival: Arrival) -> list[str]:
    return [f"_bucket{i}" for i in range(len(arrival.bucket))]


def _with_buckets(bars: DataFrame, arrival: Arrival) -> DataFrame:
    return bars.select("*", *[c.alias(n) for c, n in zip(arrival.bucket, _bucket_names(arrival))])


def _measure(bars: DataFrame, threshold: float) -> DataFrame:
    close, last, pct = F.col("close"), F.col("last"), F.col("pct")
    direction = F.when(N.gt(close, last), "up").when(N.lt(close, last), "down").otherwise("same")
    kind = F.when(N.gt(F.abs(pct), F.lit(float(threshold))), F.when(pct > 0, "spike").otherwise("drop"))
    return (
        bars.withColumn("direction", direction)
        .withColumn("pct", N.ieee_div(close - last, last) * 100.0)
        .withColumn("kind", kind)
    )


def alert_columns(bars: DataFrame) -> DataFrame:
    """What ``price_action`` needs of bars of which only the alerts are wanted."""
    return bars.select(*S.arrival_columns(bars.columns), "event_type", "pair", "open", "close", "timestamp", "end_time")


def alerts(measured: DataFrame) -> DataFrame:
    """The spikes and drops among ``price_action`` rows, with a readable ``message``."""
    carried = S.arrival_columns(measured.columns)
    message = F.format_string("%s %s %.2f%%: %s -> %s", "pair", "kind", "pct", F.col("last").cast("string"), F.col("close").cast("string"))
    return measured.where(F.col("kind").isNotNull()).select(
        *carried, "pair", "kind", "pct", "last", "close", "event_type", "timestamp", message.alias("message")
    )
