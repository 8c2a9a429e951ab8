"""Streaming price action: the batch operator per micro-batch, with the last prices carried between them.

Window functions do not run on a stream and a keyed state operator would put all bars of a busy pair into
one task.  So each micro-batch runs ``price_action``, which spreads a pair over buckets, and the last price of
every pair is kept in a small table next to the checkpoint.  A micro-batch that is run again reads the same
prices and overwrites the same output, so each bar is measured once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from ticktape.operators.price_action import DEFAULT_THRESHOLD, arrival_of, last_prices, price_action
from ticktape.sinks import tables

_STATE_SCHEMA = "pair STRING, last DOUBLE"
Keep = Callable[[DataFrame], DataFrame]


def price_action_stream(
    bars: DataFrame,
    output: str,
    checkpoint: str,
    threshold: float = DEFAULT_THRESHOLD,
    scope: str = "pair",
    keep: Keep = lambda measured: measured,
) -> DataStreamWriter:
    """The stream that writes ``price_action`` rows of a stream of bars under ``output``, by run, batch and date.

    ``bars`` needs ``ingest_seq``: rows of a micro-batch come in no particular order.  ``keep`` says what of
    the measured bars is written; pass ``alerts`` for spikes and drops only.
    """
    if scope == "pair" and "ingest_seq" not in bars.columns:
        raise ValueError("streaming bars need ingest_seq to know their arrival order")

    def write(batch: DataFrame, run: str, batch_id: int) -> None:
        batch.persist()
        try:
            measure(batch, output, checkpoint, run, batch_id, threshold, scope, keep)
        finally:
            batch.unpersist()

    return tables.for_each(bars, checkpoint, write)


def measure(
    bars: DataFrame, output: str, checkpoint: str, run: str, batch_id: int, threshold: float, scope: str, keep: Keep, commit: bool = True
) -> None:
    """One micro-batch of bars: measured against the carried prices, written, and the prices carried on."""
    if scope == "bar":
        tables.write_alerts(keep(price_action(bars, threshold, scope="bar")), output, run, batch_id, commit=commit)
        return
    state = f"{checkpoint.rstrip('/')}-prices"
    carried, arrival = _read_prices(bars.sparkSession, state, batch_id), arrival_of(bars)
    measured = price_action(bars, threshold, arrival=arrival, carried=carried)
    last_prices(bars, arrival, carried).write.mode("overwrite").parquet(_slot(state, batch_id))
    tables.write_alerts(keep(measured), output, run, batch_id, commit=commit)


def _slot(state: str, batch_id: int) -> str:
    """Prices after a batch.  Two slots take turns: a batch reads the one it does not write."""
    return f"{state}/slot={batch_id % 2}"


def _read_prices(spark: SparkSession, state: str, batch_id: int) -> DataFrame:
    if batch_id == 0:
        return spark.createDataFrame([], _STATE_SCHEMA)
    return spark.read.schema(_STATE_SCHEMA).parquet(_slot(state, batch_id - 1))


def read_price_action(spark: SparkSession, output: str) -> DataFrame:
    """Everything the streams have finished so far."""
    return tables.read_appended(spark, output)
