"""The end-to-end batch flows: frames to stored filter matches, frames to price alerts."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame

from ticktape import schemas as S
from ticktape.operators import decode, filters, price_action, topics
from ticktape.sinks import commits, tables
from ticktape.streaming.trades import matches


def trade_matches(
    frames: DataFrame,
    event_filters: Mapping[str, filters.EventFilter] | None = None,
    topic_names: Iterable[str] | None = topics.DEFAULT_TOPICS,
) -> DataFrame:
    """Trades of the wanted topics, once per filter they pass, tagged ``filter_id``."""
    return matches(frames, event_filters, topic_names)


def bars_of(frames: DataFrame, topic_names: Iterable[str] | None = topics.DEFAULT_TOPICS) -> DataFrame:
    """Minute and second bars of the wanted topics."""
    bars = decode.decode_family(decode.split_frames(frames), S.BAR)
    return bars if topic_names is None else topics.topic_filter(bars, topic_names)


def price_alerts(
    frames: DataFrame,
    threshold: float = price_action.DEFAULT_THRESHOLD,
    scope: str = "pair",
    topic_names: Iterable[str] | None = topics.DEFAULT_TOPICS,
) -> DataFrame:
    """Spikes and drops.  Nothing is written; the frames are read once for the bounds of buckets and once for the alerts."""
    bars = price_action.alert_columns(bars_of(frames, topic_names))
    arrival = price_action.arrival_of(bars, order_from=frames) if scope == "pair" else None
    return price_action.alerts(price_action.price_action(bars, threshold, scope, arrival))


def run_batch(
    frames: DataFrame,
    root: str,
    event_filters: Mapping[str, filters.EventFilter] | None = None,
    topic_names: Iterable[str] | None = topics.DEFAULT_TOPICS,
    threshold: float = price_action.DEFAULT_THRESHOLD,
    scope: str = "pair",
    conditions: str = "keep",
    store: Iterable[S.Family] = (),
    lost: DataFrame | None = None,
) -> str:
    """Both flows over one set of frames, which is split and decoded once.

    Under ``root``: the trade table of matches, ``alerts``, ``rejects``, and a table for each family in ``store`` (quotes,
    books, bars) with its events of the wanted topics.  ``staged`` holds the decoded rows of the families that are read
    here, and no others.  ``lost`` are the damaged files of ``read_with_losses``, which ``rejects`` then names.  The tables show the run when all of them are written.  Returns the run's name, which all of its folders
    carry.
    """
    spark, run = frames.sparkSession, tables.new_run()
    families = {f.name: f for f in (S.TRADE, S.BAR, *store)}.values()
    staged_path = f"{root.rstrip('/')}/staged"
    tables.write_staged(decode.stage_events(frames, families), staged_path, run, commit=False)
    staged = spark.read.option("basePath", staged_path).parquet(f"{staged_path}/run={run}")
    topic_names = None if topic_names is None else list(topic_names)

    def events(family: S.Family) -> DataFrame:
        rows = decode.staged_family(staged, family)
        return rows if topic_names is None else topics.topic_filter(rows, topic_names)

    chosen = {"default": filters.parameterized()} if event_filters is None else event_filters
    tables.write_table(filters.fan_out(events(S.TRADE), chosen, S.TRADE), S.TRADE, root, conditions, run, commit=False)
    measured = price_action.price_action(price_action.alert_columns(events(S.BAR)), threshold, scope)
    tables.write_alerts(price_action.alerts(measured), f"{root.rstrip('/')}/alerts", run, commit=False)
    for family in store:
        tables.write_table(events(family), family, root, run=run, commit=False)
    tables.write_rejects(staged, root, run, commit=False, lost=lost)
    written = [tables.table_path("", f) for f in (S.TRADE, *store)]
    commits.record(spark, root, [*[commits.place(p)[1] for p in written], "alerts", "rejects"], run, 0)
    return run
