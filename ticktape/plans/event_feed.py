"""A market feed made from an events table (``event_id, ts, user_id, event_type, value``).

Used where no recorded feed is at hand: every event becomes a trade, a quote and a book, trades are rolled
up into bars, and all of them can be put on the wire as JSON frames.  Everything is derived from the rows
given, so the feed grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticktape import schemas as S
from ticktape.sources.frames import spread

HOUR_MS, MINUTE_MS, SECOND_MS = 3_600_000, 60_000, 1_000
PAIR_OF_EVENT = {"purchase": "BTC-USD", "click": "ETH-USD", "view": "LINK-USD", "signup": "SOL-USD"}
OTHER_PAIR = "DOGE-USD"


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def trades(events: DataFrame) -> DataFrame:
    """One trade per event; ``ingest_seq`` is the event id."""
    # Wall-clock time as UTC, whatever the session zone.
    since_epoch = "CAST(ts AS TIMESTAMP_NTZ) - TIMESTAMP_NTZ'1970-01-01 00:00:00'"
    millis = F.floor(F.expr(f"CAST(CAST({since_epoch} AS INTERVAL SECOND) AS DECIMAL(18, 6)) * 1000")).cast("long")
    pair = F.lit(OTHER_PAIR)
    for name, p in PAIR_OF_EVENT.items():
        pair = F.when(F.col("event_type") == name, F.lit(p)).otherwise(pair)
    event_id = F.col("event_id")
    return events.select(
        F.lit("XT").alias("event_type"),
        pair.alias("pair"),
        F.col("value").alias("price"),
        millis.alias("timestamp"),
        ((event_id % 100).cast("double") / F.lit(10.0)).alias("size"),
        F.array(event_id % 3).alias("conditions"),
        F.when(event_id % 7 != 0, event_id.cast("string")).alias("trade_id"),
        F.col("user_id").alias("exchange_id"),
        (millis + 5).alias("received_timestamp"),
        event_id.alias("ingest_seq"),
    )


def _quote_fields() -> list[Column]:
    price, size = F.col("price"), F.col("size")
    return [
        F.lit("XQ").alias("event_type"),
        F.col("pair"),
        (price - 0.5).alias("bid_price"),
        size.alias("bid_size"),
        (price + 0.5).alias("ask_price"),
        (size + 1.0).alias("ask_size"),
        F.col("timestamp"),
        F.col("exchange_id"),
        F.col("received_timestamp"),
    ]


def _book_fields() -> list[Column]:
    price, size = F.col("price"), F.col("size")
    return [
        F.lit("XL2").alias("event_type"),
        F.col("pair"),
        F.col("timestamp"),
        F.col("received_timestamp"),
        F.col("exchange_id"),
        F.array(F.array(price - 0.5, size), F.array(price - 1.0, size)).alias("bid_prices"),
        F.array(F.array(price + 0.5, size)).alias("ask_prices"),
    ]


def quotes(trade_rows: DataFrame) -> DataFrame:
    """One quote around each trade."""
    return trade_rows.select(*_quote_fields(), "ingest_seq")


def books(trade_rows: DataFrame) -> DataFrame:
    """One book around each trade."""
    return trade_rows.select(*_book_fields(), "ingest_seq")


def bars(trade_rows: DataFrame, width_ms: int = MINUTE_MS, code: str = S.MINUTE_BAR) -> DataFrame:
    """Bars of the trades.

    A bar arrives with its last trade: second bars get even and minute bars odd ``ingest_seq``.
    """
    start = F.floor(F.col("timestamp") / width_ms) * width_ms
    price, seq = F.col("price"), F.col("ingest_seq")
    return (
        trade_rows.groupBy("pair", start.alias("start"))
        .agg(
            F.min_by(price, seq).alias("open"),
            F.max_by(price, seq).alias("close"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.count(F.lit(1)).alias("n"),
            F.max(seq).alias("last_seq"),
        )
        .select(
            F.lit(code).alias("event_type"),
            "pair",
            "open",
            "close",
            "high",
            "low",
            F.col("n").cast("double").alias("volume"),
            F.col("start").alias("timestamp"),
            (F.col("start") + width_ms).alias("end_time"),
            ((F.col("high") + F.col("low")) / 2.0).alias("vw"),
            F.col("n").alias("avg_trade_size"),
            (F.col("last_seq") * 2 + (1 if code == S.MINUTE_BAR else 0)).alias("ingest_seq"),
        )
    )


def wire(event: Column, family: S.Family) -> Column:
    """An event struct as the JSON object the feed would send (NULL fields are left out)."""
    return F.to_json(F.struct(*[event[f.column].alias(f.key) for f in family.fields]))


def family_frames(events: DataFrame, family: S.Family) -> DataFrame:
    """One frame per event."""
    return events.select("ingest_seq", F.struct(*family.columns).alias("e")).select(
        "ingest_seq", wire(F.col("e"), family).alias("frame")
    )


def mixed_frames(trade_rows: DataFrame) -> DataFrame:
    """Each trade with its quote and book: for even event ids as one array frame, else as three frames."""
    events = spread(trade_rows).select(
        "ingest_seq",
        F.struct(*S.TRADE.columns).alias("t"),
        F.struct(*_quote_fields()).alias("q"),
        F.struct(*_book_fields()).alias("b"),
    )
    texts = events.select(
        "ingest_seq",
        F.array(wire(F.col("t"), S.TRADE), wire(F.col("q"), S.QUOTE), wire(F.col("b"), S.BOOK)).alias("texts"),
    )
    together = F.array(F.concat(F.lit("["), F.array_join("texts", ","), F.lit("]")))
    frames = F.when(F.col("ingest_seq") % 2 == 0, together).otherwise(F.col("texts"))
    return texts.select("ingest_seq", F.posexplode(frames).alias("k", "frame")).select(
        (F.col("ingest_seq") * 4 + F.col("k")).alias("ingest_seq"), "frame"
    )


def damaged_frames(trade_rows: DataFrame) -> DataFrame:
    """Each trade as a frame with one of eleven forms, most of them faulty; see ``DAMAGE``."""
    text = wire(F.col("t"), S.TRADE)
    rows = spread(trade_rows).select("ingest_seq", F.struct(*S.TRADE.columns).alias("t")).select("ingest_seq", text.alias("good"))
    good, form = F.col("good"), F.col("ingest_seq") % len(DAMAGE)
    frame = F.lit(None).cast("string")
    for i, damage in enumerate(DAMAGE.values()):
        frame = F.when(form == i, damage(good)).otherwise(frame)
    return rows.select("ingest_seq", frame.alias("frame"))


DAMAGE = {
    "none": lambda text: text,
    "cut short": lambda text: F.substring(text, 1, 30),
    "text after it": lambda text: F.concat(text, F.lit(" zzz")),
    "closing bracket after it": lambda text: F.concat(text, F.lit("] z")),
    "status message next to it": lambda text: F.concat(F.lit("["), text, F.lit(',{"ev":"status"}]')),
    "lower-case event code": lambda text: F.replace(text, F.lit('"XT"'), F.lit('"xt"')),
    "received time missing": lambda text: F.regexp_replace(text, ',"r":[0-9]+', ""),
    "time as a float": lambda text: F.regexp_replace(text, '"t":([0-9]+)', '"t":$1.0'),
    "price as a string": lambda text: F.regexp_replace(text, '"p":([-0-9.E]+)', '"p":"$1"'),
    "price repeated": lambda text: F.regexp_replace(text, '"p":([-0-9.E]+)', '"p":$1,"p":null'),
    "inside a string": lambda text: F.concat(F.lit('["'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"]')),
}
