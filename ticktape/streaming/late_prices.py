"""Streaming price action for bars that land out of order.

Arrival order is told by the ingest columns, not by the micro-batch that a bar comes in.  A bar that lands late is compared with
the bar that came before it, whichever micro-batch that was in, and the bar behind it is measured again and written as a new version of
itself.  So what ``read_current`` gives after any number of micro-batches is what ``price_action`` gives for all bars at once,
and nothing is held back to wait for a gap to close.

Next to the checkpoint are kept: every pair's newest place and close (``newest``, two slots that take turns), and per micro-batch its
bars and every pair's first and last of them (``bars``, ``edges``).  A micro-batch without late bars reads ``newest`` alone.
One with late bars reads the edges of the late pairs, and of the bars only the micro-batches whose edges
overlap; between a late bar's neighbours nothing else can lie.  Bars are measured by ``price_action``, so no pair is one task.

A micro-batch that is run again reads only what earlier ones left and overwrites its own output and state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ticktape import schemas as S
from ticktape.operators.lookup import lookup_join
from ticktape.operators.price_action import DEFAULT_THRESHOLD, arrival_of, price_action
from ticktape.sinks import tables


def late_price_stream(bars: DataFrame, output: str, checkpoint: str, threshold: float = DEFAULT_THRESHOLD) -> DataStreamWriter:
    """The stream that writes measured bars, and new versions of those whose predecessor landed after them, under ``output``."""
    if "ingest_seq" not in bars.columns:
        raise ValueError("streaming bars need ingest_seq to know their arrival order")

    def write(batch: DataFrame, run: str, batch_id: int) -> None:
        batch.persist()
        try:
            measure(batch, output, checkpoint, run, batch_id, threshold)
        finally:
            batch.unpersist()

    return tables.for_each(bars, checkpoint, write)


def _order(columns: list[str]) -> list[str]:
    return [c for c in (*S.ARRIVAL_COLUMNS[:3], "pos") if c in columns]


def _place(columns: list[str]) -> Column:
    return F.struct(*_order(columns))


def measure(bars: DataFrame, output: str, checkpoint: str, run: str, batch_id: int, threshold: float = DEFAULT_THRESHOLD) -> None:
    """One micro-batch of bars: written with every older bar that now has another predecessor, and the state carried on."""
    state, spark = f"{checkpoint.rstrip('/')}-late", bars.sparkSession
    columns, place = bars.columns, _place(bars.columns)
    bars.write.mode("overwrite").parquet(f"{state}/bars/batch_id={batch_id}")
    edges = bars.groupBy("pair").agg(
        F.min_by(F.struct(*columns), place).alias("first"), F.max(F.struct(place.alias("place"), F.col("close").alias("close"))).alias("last")
    )
    edges.write.mode("overwrite").parquet(f"{state}/edges/batch_id={batch_id}")
    own = spark.read.schema(edges.schema).parquet(f"{state}/edges/batch_id={batch_id}")
    newest = own.select("pair", "last")
    rows, before = bars.withColumn("is_new", F.lit(True)), None
    if batch_id:
        earlier = spark.read.schema(newest.schema).parquet(f"{state}/newest/slot={(batch_id - 1) % 2}")
        spans = own.select("pair", _place_of("first", columns).alias("lo"), F.col("last.place").alias("hi"))
        known = spans.join(earlier, "pair")
        late = known.where("lo < last.place").select("pair", "lo", "hi")
        on_time = known.where("lo > last.place").select("pair", F.col("last.close").alias("last"))
        older, before = _neighbours(spark, state, batch_id, late, edges.schema, bars.schema)
        before = on_time if before is None else on_time.unionByName(before)
        rows = rows if older is None else rows.unionByName(older.withColumn("is_new", F.lit(False)))
        both = newest.unionByName(earlier)
        newest = both.groupBy("pair").agg(F.max("last").alias("last"))
    measured = price_action(rows, threshold, arrival=arrival_of(rows), carried=before, beside=("is_new",))
    changed = measured.where("is_new OR last_is_new").withColumn("rewritten", ~F.col("is_new")).drop("is_new", "last_is_new")
    newest.write.mode("overwrite").parquet(f"{state}/newest/slot={batch_id % 2}")
    tables.write_alerts(changed, output, run, batch_id, rebalance=False)


def _place_of(row: str, columns: list[str]) -> Column:
    return F.struct(*[F.col(f"{row}.{c}").alias(c) for c in _order(columns)])


def _neighbours(spark: SparkSession, state: str, batch_id: int, late: DataFrame, edge_schema, bar_schema) -> tuple[DataFrame | None, DataFrame | None]:
    """For pairs with late bars between ``lo`` and ``hi``: the stored bars between and the next one behind, and the close before.

    The late pairs' edges come from all earlier micro-batches; bars only from those whose edges overlap the span.
    """
    columns, place = bar_schema.names, _place(bar_schema.names)
    late = late.persist()
    try:
        if late.isEmpty():
            return None, None
        edges = spark.read.schema(edge_schema).parquet(f"{state}/edges").where(F.col("batch_id") < batch_id)
        edges = lookup_join(edges, late, ["pair"], "inner").withColumn("begin", _place_of("first", columns))
        overlap = (F.col("begin") <= F.col("hi")) & (F.col("last.place") >= F.col("lo"))
        batches = [r["batch_id"] for r in edges.where(overlap).select("batch_id").distinct().collect()]
        stored = spark.read.schema(bar_schema).parquet(f"{state}/bars").where(F.col("batch_id").isin(batches))
        near = lookup_join(stored, late, ["pair"], "inner").withColumn("place", place)
        between = near.where("place >= lo AND place <= hi").select(*columns)
        row = F.struct(*columns).alias("row")
        behind = near.where("place > hi").select("pair", "place", row).unionByName(
            edges.where("begin > hi").select("pair", F.col("begin").alias("place"), F.col("first").alias("row"))
        )
        ahead = near.where("place < lo").select("pair", "place", "close").unionByName(
            edges.where("last.place < lo").select("pair", "last.place", "last.close")
        )
        following = behind.groupBy("pair").agg(F.min_by("row", "place").alias("row")).select("row.*")
        before = ahead.groupBy("pair").agg(F.max_by("close", "place").alias("last"))
        return between.unionByName(following), before
    finally:
        late.unpersist()


def read_current(spark: SparkSession, output: str) -> DataFrame:
    """Every bar once, as last measured.  Only bars with more than one version are looked up, and those are few."""
    rows = tables.read_appended(spark, output)
    bar = ["run", "pair", *_order(rows.columns)]
    newer = rows.where("rewritten").groupBy(*bar).agg(F.max("batch_id").alias("_newest"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"n.{c}")) for c in bar]
    seen = rows.alias("r").join(newer.alias("n"), same, "left").where("_newest IS NULL OR batch_id = _newest")
    return seen.select("r.*").drop("rewritten")
