"""Saved filter configurations: JSON lines of ``{"pair": ..., "criteria": [{field, operation, value}]}``.

``value`` is ``{"Number": x}`` or ``{"Text": "s"}``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticktape import schemas as S

_STRICT = {"mode": "FAILFAST", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


class FilterConfigError(ValueError):
    """The configuration has a malformed or repeated entry."""


def load_filter_config(spark: SparkSession, path: str) -> DataFrame:
    """The configuration as a table, checked: complete entries only and each pair once."""
    config = spark.read.schema(S.FILTER_CONFIG_SCHEMA).options(**_STRICT).json(path)
    check_filter_config(config)
    return config


def save_filter_config(config: DataFrame, path: str, mode: str = "error") -> None:
    check_filter_config(config)
    config.write.mode(mode).json(path)


def load_filter_changes(spark: SparkSession, path: str) -> DataFrame:
    """A log of changes (``effective_from, pair, criteria``; see ``operators.config_versions``), checked."""
    changes = spark.read.schema(S.FILTER_CHANGES_SCHEMA).options(**_STRICT).json(path)
    check_filter_changes(changes)
    return changes


def save_filter_changes(changes: DataFrame, path: str) -> None:
    """Append changes to a log, later than all that it holds, so that no event is judged anew."""
    check_filter_changes(changes)
    try:
        known = load_filter_changes(changes.sparkSession, path)
    except AnalysisException:  # the log begins
        known = changes.limit(0)
    newest = known.agg(F.max("effective_from").alias("at")).first()["at"]
    first = changes.agg(F.min("effective_from").alias("at")).first()["at"]
    if newest is not None and first is not None and first <= newest:
        raise FilterConfigError(f"a change at {first} is not later than the log, which ends at {newest}")
    changes.write.mode("append").json(path)


def check_filter_changes(changes: DataFrame) -> None:
    """Entries are complete, but for withdrawn ones, and a pair has one change at a place."""
    entries = changes.withColumn("criteria", F.coalesce("criteria", F.array().cast(changes.schema["criteria"].dataType)))
    check_criteria(entries, ["pair", "effective_from"])


def check_filter_config(config: DataFrame) -> None:
    check_criteria(config, ["pair"])


def check_criteria(entries: DataFrame, keys: list[str], may_be_null: tuple[str, ...] = ()) -> None:
    """Entries are complete, and each combination of ``keys`` has one."""

    def incomplete(c):
        one_value = c["value"]["Number"].isNotNull() != c["value"]["Text"].isNotNull()
        return ~F.coalesce(c["field"].isNotNull() & c["operation"].isNotNull() & one_value, F.lit(False))

    bad = F.col("criteria").isNull() | F.exists("criteria", incomplete)
    for key in keys:
        bad = bad if key in may_be_null else bad | F.col(key).isNull()
    per_key = entries.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(bad).alias("bad"))
    found = per_key.agg(F.max("n").alias("n"), F.max("bad").alias("bad")).first()
    if found["bad"]:
        raise FilterConfigError(f"an entry lacks its {', '.join(keys)}, criteria, field, operation or one value")
    if (found["n"] or 0) > 1:
        raise FilterConfigError(f"a {' and '.join(keys)} has more than one entry")
