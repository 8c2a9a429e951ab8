"""A log of finished writes, so that readers see whole runs and batches only, and an older answer can be had again.

Beside the tables of a root lies ``commits``: one small file per finished run and batch, written after all rows are in place.  It names
every table that the batch wrote, so tables that belong together become visible together.  A reader takes the log first and the
tables second: what a writer leaves that died halfway, or has not finished yet, is not in the log and is not read.

A batch that is in the log is never written again, which makes a repeated micro-batch harmless; one that is not may be overwritten,
as nobody has seen it.  ``at`` rises with every entry, so ``as_of`` one of them gives the tables as they were then.  Two writers that
finish in the same instant may take the same ``at``; both entries count then.
"""

from __future__ import annotations

import time
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "name STRING, run STRING, batch_id BIGINT, at BIGINT"


def place(path: str) -> tuple[str, str]:
    """The root and the name of a table's path."""
    root, _, name = path.rstrip("/").rpartition("/")
    return root, name


def entries(spark: SparkSession, root: str, as_of: int | None = None) -> DataFrame | None:
    """The log of a root, up to ``as_of``; None where nothing has been logged."""
    try:
        log = spark.read.schema(_SCHEMA).json(f"{root.rstrip('/')}/commits")
    except AnalysisException:  # no log yet
        return None
    return log if as_of is None else log.where(F.col("at") <= as_of)


def newest(spark: SparkSession, root: str) -> int:
    """The ``at`` of the newest entry, 0 without any: what to pass as ``as_of`` to get this answer again."""
    log = entries(spark, root)
    return 0 if log is None else log.agg(F.coalesce(F.max("at"), F.lit(0))).first()[0]


def record(spark: SparkSession, root: str, names: Iterable[str], run: str, batch_id: int) -> None:
    """Notes that a batch of a run is whole in the tables ``names``; one file, so all of them at once."""
    at = max(time.time_ns() // 1000, newest(spark, root) + 1)
    rows = spark.createDataFrame([(name, run, batch_id, at) for name in names], _SCHEMA)
    rows.coalesce(1).write.mode("append").json(f"{root.rstrip('/')}/commits")


def is_done(spark: SparkSession, root: str, names: Iterable[str], run: str, batch_id: int) -> bool:
    """Whether the batch is in the log for all of ``names``."""
    log = entries(spark, root)
    if log is None:
        return False
    found = log.where((F.col("run") == run) & (F.col("batch_id") == batch_id)).select("name").distinct().collect()
    return set(names) <= {r["name"] for r in found}


def visible(rows: DataFrame, path: str, as_of: int | None = None) -> DataFrame:
    """The rows of a table (with its partition columns) whose run and batch are in the log; all of them where there is no log.

    The log is read by the plan before the table: its entries prune the table's folders.
    """
    root, name = place(path)
    log = entries(rows.sparkSession, root, as_of)
    if log is None or (as_of is None and log.where(F.col("name") == name).isEmpty()):
        return rows
    done = log.where(F.col("name") == name).select("run", F.col("batch_id").cast("int").alias("batch_id")).distinct()
    return rows.join(F.broadcast(done), ["run", "batch_id"], "left_semi")


def adopt(spark: SparkSession, path: str) -> None:
    """Notes all that a table holds now, for tables from before there was a log."""
    root, name = place(path)
    for r in spark.read.parquet(path).select("run", "batch_id").distinct().collect():
        record(spark, root, [name], r["run"], r["batch_id"])
