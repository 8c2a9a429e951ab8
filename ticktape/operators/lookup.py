"""Joining a large stream to a keyed side table of unknown size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticktape import schemas as S

MAX_BROADCAST_BYTES = 32 * 1024 * 1024
SALTS = 64


def text_bytes(df: DataFrame) -> int:
    """Size of a table as JSON text, measured by one distributed aggregate."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*df.columns))).cast("long"))
    return df.agg(F.coalesce(size, F.lit(0)).alias("n")).first()["n"]


def lookup_join(
    df: DataFrame,
    table: DataFrame,
    keys: list[str],
    how: str,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    salts: int | None = None,
) -> DataFrame:
    """``df`` joined to a ``table``: ``left`` if that has at most one row per key, else ``left_semi``, ``left_anti`` or ``inner``.

    A table measured to be small is broadcast; a larger one is shuffled.  Adaptive execution then splits
    the partition of a key that holds much of ``df`` into as many tasks as its size asks for.  Where it does
    not run (switched off, or on a stream) each key is copied to ``salts`` partitions instead.
    """
    if text_bytes(table) <= max_broadcast_bytes:
        return df.join(F.broadcast(table), keys, how)
    if salts is None:
        salts = 1 if splits_skew(df) else SALTS
    if salts == 1:
        return df.join(table.hint("merge"), keys, how)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    return df.withColumn("_salt", _salt(df, salts)).join(salted, [*keys, "_salt"], how).drop("_salt")


def splits_skew(df: DataFrame) -> bool:
    """Whether adaptive execution will split skewed join partitions of a query on ``df``."""
    settings = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled")
    return not df.isStreaming and all(df.sparkSession.conf.get(s) == "true" for s in settings)


def _salt(df: DataFrame, salts: int) -> Column:
    """A salt computed from the row, so that a task run again gives the same one."""
    spread = S.arrival_columns(df.columns) or df.columns
    return F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
