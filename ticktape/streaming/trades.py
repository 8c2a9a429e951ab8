"""Streams of frames to tables: filter matches, whole families, price alerts; each with its rejects."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ticktape import schemas as S
from ticktape.operators import decode, filters, price_action, topics
from ticktape.sinks import commits, tables
from ticktape.sources import frames as frame_sources
from ticktape.streaming import prices


def matches(
    frames: DataFrame,
    event_filters: Mapping[str, filters.EventFilter] | None = None,
    topic_names: Iterable[str] | None = topics.DEFAULT_TOPICS,
) -> DataFrame:
    """Trades of the wanted topics, once per filter they pass.  Batch or streaming frames."""
    trades = decode.decode_family(decode.split_frames(frames), S.TRADE)
    if topic_names is not None:
        trades = topics.topic_filter(trades, topic_names)
    chosen = {"default": filters.parameterized()} if event_filters is None else event_filters
    return filters.fan_out(trades, chosen, S.TRADE)


def persist_matches(
    frames: DataFrame,
    root: str,
    checkpoint: str,
    event_filters: Mapping[str, filters.EventFilter] | None = None,
    topic_names: Iterable[str] | None = topics.DEFAULT_TOPICS,
    conditions: str = "keep",
) -> DataStreamWriter:
    """The stream that appends ``matches`` to the trade table under ``root``, and what cannot be read to ``rejects``."""
    chosen = {"default": filters.parameterized()} if event_filters is None else event_filters
    topic_names = None if topic_names is None else list(topic_names)

    def write(staged: DataFrame, run: str, batch_id: int) -> None:
        trades = decode.staged_family(staged, S.TRADE)
        if topic_names is not None:
            trades = topics.topic_filter(trades, topic_names)
        found = filters.fan_out(trades, chosen, S.TRADE)
        tables.write_table(found, S.TRADE, root, conditions, run, batch_id, commit=False)

    return _each_staged(frames, root, checkpoint, (S.TRADE,), [_name(S.TRADE)], write)


def persist_families(
    frames: DataFrame, root: str, checkpoint: str, families: Iterable[S.Family] = (S.QUOTE, S.BOOK, S.BAR),
    topic_names: Iterable[str] | None = None,
) -> DataStreamWriter:
    """The stream that appends the events of ``families`` to their tables under ``root``, and the rejects."""
    families = tuple(families)
    topic_names = None if topic_names is None else list(topic_names)

    def write(staged: DataFrame, run: str, batch_id: int) -> None:
        for family in families:
            events = decode.staged_family(staged, family)
            events = events if topic_names is None else topics.topic_filter(events, topic_names)
            tables.write_table(events, family, root, run=run, batch_id=batch_id, commit=False)

    return _each_staged(frames, root, checkpoint, families, map(_name, families), write)


def persist_alerts(
    frames: DataFrame, root: str, checkpoint: str, threshold: float = price_action.DEFAULT_THRESHOLD, scope: str = "pair",
    topic_names: Iterable[str] | None = topics.DEFAULT_TOPICS, also: Callable[[DataFrame], None] | None = None,
) -> DataStreamWriter:
    """The stream that appends spikes and drops to ``alerts`` under ``root``, and what cannot be read to ``rejects``.

    ``also`` gets each micro-batch's alerts once they are written, to send them to a topic, say; a micro-batch that is run
    again passes them on again.
    """
    topic_names = None if topic_names is None else list(topic_names)
    output = f"{root.rstrip('/')}/alerts"

    def write(staged: DataFrame, run: str, batch_id: int) -> None:
        bars = decode.staged_family(staged, S.BAR)
        bars = bars if topic_names is None else topics.topic_filter(bars, topic_names)
        prices.measure(bars, output, checkpoint, run, batch_id, threshold, scope, price_action.alerts, commit=False)
        if also is not None:
            shape = price_action.alerts(price_action.price_action(bars, threshold, scope="bar")).schema
            also(staged.sparkSession.read.schema(shape).parquet(f"{output}/run={run}/batch_id={batch_id}").select(*shape.names))

    return _each_staged(frames, root, checkpoint, (S.BAR,), ["alerts"], write)


def persist_all(
    frames: DataFrame, root: str, checkpoint: str, event_filters: Mapping[str, filters.EventFilter] | None = None,
    topic_names: Iterable[str] | None = topics.DEFAULT_TOPICS, threshold: float = price_action.DEFAULT_THRESHOLD, scope: str = "pair",
    conditions: str = "keep", store: Iterable[S.Family] = (),
) -> DataStreamWriter:
    """Both flows beside each other on one stream, which is split and decoded once: filter matches to the trade table, spikes
    and drops to ``alerts``, the families in ``store`` to their tables, and what cannot be read to ``rejects``.

    A micro-batch counts as done, in all of its tables at once, when the last of them is written.
    """
    chosen = {"default": filters.parameterized()} if event_filters is None else event_filters
    topic_names, store = None if topic_names is None else list(topic_names), tuple(store)
    names = [_name(S.TRADE), "alerts", *map(_name, store)]

    def write(staged: DataFrame, run: str, batch_id: int) -> None:
        def events(family: S.Family) -> DataFrame:
            rows = decode.staged_family(staged, family)
            return rows if topic_names is None else topics.topic_filter(rows, topic_names)

        found = filters.fan_out(events(S.TRADE), chosen, S.TRADE)
        tables.write_table(found, S.TRADE, root, conditions, run, batch_id, commit=False)
        output = f"{root.rstrip('/')}/alerts"
        prices.measure(events(S.BAR), output, checkpoint, run, batch_id, threshold, scope, price_action.alerts, commit=False)
        for family in store:
            tables.write_table(events(family), family, root, run=run, batch_id=batch_id, commit=False)

    return _each_staged(frames, root, checkpoint, {f.name: f for f in (S.TRADE, S.BAR, *store)}.values(), names, write)


def _dealt(batch: DataFrame) -> DataFrame:
    """The frames of a micro-batch, numbered and spread over the cores: one landed file may be a single split."""
    return frame_sources.spread(frame_sources.numbered(batch))


def _name(family: S.Family) -> str:
    return commits.place(tables.table_path("", family))[1]


def persist_staged(frames: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """The stream that stages every event and reject of ``frames`` in one pass."""

    def write(batch: DataFrame, run: str, batch_id: int) -> None:
        tables.write_staged(decode.stage_events(_dealt(batch)), path, run, batch_id)

    return tables.for_each(frames, checkpoint, write)


def _each_staged(
    frames: DataFrame, root: str, checkpoint: str, families: Iterable[S.Family], names: Iterable[str], write
) -> DataStreamWriter:
    """Each micro-batch split and decoded once; ``write`` gets the events of ``families`` and fills the tables ``names``, to which
    the rejects are added.  The log then takes the batch for all of them; a batch that it holds is passed over.

    The decoded rows are kept by the executors while they are read; a lost block is decoded again.
    """
    families, names = tuple(families), [*names, "rejects"]

    def one(batch: DataFrame, run: str, batch_id: int) -> None:
        if commits.is_done(batch.sparkSession, root, names, run, batch_id):
            return
        staged = decode.stage_events(_dealt(batch), families).persist()
        try:
            write(staged, run, batch_id)
            tables.write_rejects(staged, root, run, batch_id, commit=False)
            commits.record(staged.sparkSession, root, names, run, batch_id)
        finally:
            staged.unpersist()

    return tables.for_each(frames, checkpoint, one)
