"""Topic selection: ``CHANNEL.PAIR`` for one pair, ``CHANNEL.*`` for all pairs of an event type."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticktape.operators.lookup import lookup_join

# The topics selected when none are named.
DEFAULT_TOPICS = (
    "XT.BTC-USD",
    "XA.BTC-USD",
    "XT.ETH-USD",
    "XA.ETH-USD",
    "XT.LINK-USD",
    "XA.LINK-USD",
)


def channel_topics(
    minute_bars: bool = False,
    second_bars: bool = False,
    trades: bool = False,
    quotes: bool = False,
    books: bool = False,
) -> list[str]:
    """The wildcard topics of the channels switched on."""
    channels = {"XA": minute_bars, "XAS": second_bars, "XT": trades, "XQ": quotes, "XL2": books}
    return [f"{channel}.*" for channel, on in channels.items() if on]


def topic_predicate(topics: Iterable[str]) -> Column:
    """Whether an event is on one of the topics, as comparisons that reach a Parquet scan."""
    pairs: dict[str, set[str]] = {}
    for topic in topics:
        channel, dot, pair = topic.partition(".")
        if not dot:
            raise ValueError(f"topic {topic!r} is not CHANNEL.PAIR")
        pairs.setdefault(channel, set()).add(pair)
    selected = F.lit(False)
    for channel, names in pairs.items():
        on_channel = F.col("event_type") == channel
        if "*" not in names:
            on_channel = on_channel & F.col("pair").isin(*sorted(names))
        selected = selected | on_channel
    return selected


def topic_filter(events: DataFrame, topics: Iterable[str] = DEFAULT_TOPICS) -> DataFrame:
    """Events of any family that are on one of the topics."""
    return events.where(topic_predicate(topics))


def topic_join(events: DataFrame, topics: DataFrame, **size_limits) -> DataFrame:
    """``topic_filter`` for a table of topics (column ``topic``) too long to write out.  The events are read once."""
    dot = F.instr("topic", ".")
    malformed = F.raise_error(F.concat(F.lit("topic "), F.coalesce("topic", F.lit("null")), F.lit(" is not CHANNEL.PAIR")))
    channel = F.when(dot > 0, F.substring_index("topic", ".", 1)).otherwise(malformed)
    wanted = topics.select(channel.alias("event_type"), F.expr("substr(topic, instr(topic, '.') + 1)").alias("pair")).distinct()
    # At most one wildcard per event type, so this list is short whatever the table holds.
    known = F.when((F.col("pair") == "*") & F.col("event_type").isin("XA", "XAS", "XT", "XQ", "XL2"), F.col("event_type"))
    channels = wanted.agg(F.collect_set(known).alias("channels")).first()["channels"]
    named = wanted.where(F.col("pair") != "*").withColumn("_named", F.lit(True))
    marked = lookup_join(events, named, ["event_type", "pair"], "left", **size_limits)
    selected = F.col("_named").isNotNull()
    if channels:
        selected = selected | F.col("event_type").isin(*sorted(channels))
    return marked.where(selected).select(*events.columns)
