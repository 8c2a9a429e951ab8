"""Frames to typed events: split, dispatch on the event code, strict typed decode, rejects.

One JSON scan splits a frame into elements and one more reads the fields of the elements that are wanted.
Both scans sit in generators, through which Spark does not push filters, so none runs twice.  No shuffle,
no Python.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticktape import schemas as S
from ticktape.functions import strict_json as J

_EVENT_KEY = "ev"


def split_frames(frames: DataFrame) -> DataFrame:
    """One row per element: the arrival columns, ``pos``, ``raw``, ``readable`` and the event ``code``.

    ``frames`` needs a ``frame`` column; its ``ingest_*`` columns are carried along.  An array frame gives
    its elements in order, any other JSON value gives itself, ``[]`` gives nothing, and a frame that is not
    JSON gives one row with ``readable = false``.  ``code`` is NULL unless the element is an object that
    names a known event type.
    """
    carried = S.arrival_columns(frames.columns)
    frame, elements = F.col("frame"), F.col("elements")
    split = (
        frames.select(*carried, J.with_signed_zeros(frame).alias("frame"))
        .select(*carried, "frame", J.sealed_parts(frame).alias("parts"))
        .select(*carried, "frame", J.unsealed(frame, F.col("parts")).alias("elements"))
        .select(
            *carried, "frame", "elements",
            J.is_readable(frame, elements).alias("readable"),
            J.object_flags(frame).alias("flags"),
        )
    )
    pieces = F.when(F.col("readable"), elements).otherwise(F.array(frame))
    raw = F.col("raw")
    is_object = F.coalesce(F.get("flags", F.col("pos")), raw.startswith("{"))
    named = F.when(F.col("readable") & is_object, F.expr(J.code_by_text("raw", _EVENT_KEY, S.EVENT_TYPES)))
    repeated = F.expr(f"named IS NOT NULL AND {J.key_is_repeated('raw', _EVENT_KEY)}")
    code = F.when(repeated, J.code_by_parse(raw, _EVENT_KEY, S.EVENT_TYPES)).otherwise(F.col("named"))
    return (
        split.select(*carried, "readable", "flags", F.posexplode(pieces).alias("pos", "raw"))
        .select(*carried, "pos", "raw", "readable", named.alias("named"))
        .select(*carried, "pos", "raw", "readable", code.alias("code"))
    )


def read_fields(elements: DataFrame, families: Iterable[S.Family]) -> DataFrame:
    """``split_frames`` rows plus one struct per family, filled in for that family's elements only."""
    structs = [
        F.when(F.col("code").isin(*f.event_types), J.typed_fields("raw", f.types, f.optional_keys)).alias(f.name)
        for f in families
    ]
    return elements.select(*elements.columns, F.inline(F.array(F.struct(*structs))))


def _fits(family: S.Family) -> str:
    """SQL text: whether the family's struct is a complete event."""
    return f"({_named(family)} AND {J.is_complete('raw', family.name, family.types, family.optional_keys)})"


def _named(family: S.Family) -> str:
    """SQL text: whether the event code stands in the element itself, not only in an object inside it."""
    return f"coalesce({family.name}.{_EVENT_KEY} = code, false)"


def event_fields(family: S.Family) -> list[Column]:
    return [F.col(family.name)[f.key].alias(f.column) for f in family.fields]


def decode_family(elements: DataFrame, family: S.Family, event_types=None) -> DataFrame:
    """Typed events of one family (of ``event_types`` only, if given) from ``split_frames`` rows."""
    wanted = elements.where(F.col("code").isin(*(event_types or family.event_types)))
    carried = S.arrival_columns(elements.columns)
    return read_fields(wanted, [family]).where(_fits(family)).select(*carried, *event_fields(family))


def _reason(families: Iterable[S.Family] = tuple(S.FAMILIES.values())) -> Column:
    """Why an element with its family structs gives no event; NULL when it gives one."""
    families = tuple(families)
    named = " OR ".join(_named(f) for f in families)
    good = " OR ".join(_fits(f) for f in families)
    found = F.expr(
        f"CASE WHEN NOT readable THEN '{S.BAD_JSON}' WHEN code IS NULL OR NOT ({named}) THEN '{S.UNKNOWN_EVENT_TYPE}' "
        f"WHEN NOT ({good}) THEN '{S.SCHEMA_MISMATCH}' END"
    )
    return F.when(~F.col("readable") & J.has_long_name(F.col("raw")), S.NAME_TOO_LONG).otherwise(found)


def rejects(elements: DataFrame) -> DataFrame:
    """Every frame or element that gives no event, with the reason."""
    carried = S.arrival_columns(elements.columns)
    parsed = read_fields(elements, S.FAMILIES.values())
    return parsed.select(*carried, "raw", _reason().alias("reason")).where(F.col("reason").isNotNull())


@dataclass(frozen=True)
class Decoded:
    """The typed streams of one set of frames.  Each is a separate lazy plan over the same frames."""

    trades: DataFrame
    quotes: DataFrame
    bars: DataFrame
    books: DataFrame
    rejects: DataFrame

    def family(self, name: str) -> DataFrame:
        return {"trade": self.trades, "quote": self.quotes, "bar": self.bars, "book": self.books}[name]


def decode(frames: DataFrame) -> Decoded:
    """All families of ``frames``.

    To use more than one of them on a large input, write it once with ``stage_events`` instead: every
    stream here splits the frames on its own.
    """
    elements = split_frames(frames)
    return Decoded(
        trades=decode_family(elements, S.TRADE),
        quotes=decode_family(elements, S.QUOTE),
        bars=decode_family(elements, S.BAR),
        books=decode_family(elements, S.BOOK),
        rejects=rejects(elements),
    )


def stage_events(frames: DataFrame, families: Iterable[S.Family] = tuple(S.FAMILIES.values())) -> DataFrame:
    """All events of ``families`` and all rejects of ``frames`` in one pass, ready to be written partitioned by ``family``.

    ``family`` is an event family or ``reject``; the struct of that name (or ``raw`` and ``reason``) holds
    the payload and the others are NULL, which costs next to nothing in a columnar file.  Elements that name an event
    type of another family are passed over: they are neither read nor judged.
    """
    families = tuple(families)
    elements = split_frames(frames)
    carried = S.arrival_columns(elements.columns)
    codes = [code for f in families for code in f.event_types]
    if len(codes) < len(S.EVENT_TYPES):
        elements = elements.where(F.col("code").isNull() | F.col("code").isin(*codes))
    reason = F.col("reason")
    kind = F.lit("reject")
    for f in families:
        kind = F.when(reason.isNull() & F.col("code").isin(*f.event_types), F.lit(f.name)).otherwise(kind)
    payload = [
        F.when(reason.isNull() & F.col(f.name).isNotNull(), F.struct(*event_fields(f))).alias(f.name) for f in families
    ]
    parsed = read_fields(elements, families).withColumn("reason", _reason(families))
    return parsed.select(
        *carried, kind.alias("family"), *payload, F.when(reason.isNotNull(), F.col("raw")).alias("raw"), "reason"
    )


def staged_family(staged: DataFrame, family: S.Family) -> DataFrame:
    """Typed events of one family out of a staged table (partition and column pruning apply)."""
    carried = S.arrival_columns(staged.columns)
    return staged.where(F.col("family") == family.name).select(*carried, f"{family.name}.*")
