"""Event families, their wire keys and their table columns.

Four table shapes carry the five event types: minute and second bars share one shape and are told
apart by ``event_type``.  Prices and sizes stay DOUBLE and epoch milliseconds stay BIGINT, exactly as
the feed sends them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

LONGS = T.ArrayType(T.LongType())
LEVELS = T.ArrayType(T.ArrayType(T.DoubleType()))


@dataclass(frozen=True)
class Field:
    """One event field: its key on the wire, its table column and its type."""

    key: str
    column: str
    type: T.DataType
    optional: bool = False


@dataclass(frozen=True)
class Family:
    """One table shape and the event types stored in it."""

    name: str
    event_types: tuple[str, ...]
    fields: tuple[Field, ...]

    @property
    def columns(self) -> list[str]:
        return [f.column for f in self.fields]

    @property
    def types(self) -> dict[str, T.DataType]:
        """Type of each wire key."""
        return {f.key: f.type for f in self.fields}

    @property
    def optional_keys(self) -> list[str]:
        return [f.key for f in self.fields if f.optional]

    @property
    def table_schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.column, f.type, f.optional) for f in self.fields])


_STR, _DBL, _INT = T.StringType(), T.DoubleType(), T.LongType()

# The feed's event codes, wire keys and the table columns they are stored under.
TRADE = Family(
    "trade",
    ("XT",),
    (
        Field("ev", "event_type", _STR),
        Field("pair", "pair", _STR),
        Field("p", "price", _DBL),
        Field("t", "timestamp", _INT),
        Field("s", "size", _DBL),
        Field("c", "conditions", LONGS),
        Field("i", "trade_id", _STR, optional=True),
        Field("x", "exchange_id", _INT),
        Field("r", "received_timestamp", _INT),
    ),
)

QUOTE = Family(
    "quote",
    ("XQ",),
    (
        Field("ev", "event_type", _STR),
        Field("pair", "pair", _STR),
        Field("bp", "bid_price", _DBL),
        Field("bs", "bid_size", _DBL),
        Field("ap", "ask_price", _DBL),
        Field("as", "ask_size", _DBL),
        Field("t", "timestamp", _INT),
        Field("x", "exchange_id", _INT),
        Field("r", "received_timestamp", _INT),
    ),
)

BAR = Family(
    "bar",
    ("XA", "XAS"),
    (
        Field("ev", "event_type", _STR),
        Field("pair", "pair", _STR),
        Field("o", "open", _DBL),
        Field("c", "close", _DBL),
        Field("h", "high", _DBL),
        Field("l", "low", _DBL),
        Field("v", "volume", _DBL),
        Field("s", "timestamp", _INT),
        Field("e", "end_time", _INT),
        Field("vw", "vw", _DBL),
        Field("z", "avg_trade_size", _INT),
    ),
)

BOOK = Family(
    "book",
    ("XL2",),
    (
        Field("ev", "event_type", _STR),
        Field("pair", "pair", _STR),
        Field("t", "timestamp", _INT),
        Field("r", "received_timestamp", _INT),
        Field("x", "exchange_id", _INT),
        Field("b", "bid_prices", LEVELS),
        Field("a", "ask_prices", LEVELS),
    ),
)

MINUTE_BAR, SECOND_BAR = "XA", "XAS"
# End of fixed values.

FAMILIES: dict[str, Family] = {f.name: f for f in (TRADE, QUOTE, BAR, BOOK)}
EVENT_TYPES: tuple[str, ...] = tuple(t for f in FAMILIES.values() for t in f.event_types)

# Columns that say where an event came from.  They travel next to the event and are not part of it.
ARRIVAL_TYPES = {"ingest_ts": T.TimestampType(), "ingest_src": T.StringType(), "ingest_seq": T.LongType(), "pos": T.IntegerType()}
ARRIVAL_COLUMNS = tuple(ARRIVAL_TYPES)

# Reject reasons.
BAD_JSON = "bad_json"
NAME_TOO_LONG = "name_too_long"
#: A landed file that cannot be read to its end; ``raw`` is its path.
UNREADABLE_FILE = "unreadable_file"
UNKNOWN_EVENT_TYPE = "unknown_event_type"
SCHEMA_MISMATCH = "schema_mismatch"

FILTER_CONFIG_SCHEMA = T.StructType(
    [
        T.StructField("pair", T.StringType()),
        T.StructField(
            "criteria",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("field", T.StringType()),
                        T.StructField("operation", T.StringType()),
                        T.StructField(
                            "value",
                            T.StructType(
                                [
                                    T.StructField("Number", T.DoubleType()),
                                    T.StructField("Text", T.StringType()),
                                ]
                            ),
                        ),
                    ]
                )
            ),
        ),
    ]
)
#: A log of changes to a configuration; NULL criteria withdraw the pair's entry.
FILTER_CHANGES_SCHEMA = T.StructType([T.StructField("effective_from", T.LongType()), *FILTER_CONFIG_SCHEMA.fields])


def arrival_columns(columns) -> list[str]:
    """The arrival columns present in ``columns``, in arrival-order significance."""
    return [c for c in ARRIVAL_COLUMNS if c in columns]
