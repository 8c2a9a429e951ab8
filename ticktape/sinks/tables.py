"""Append-only event tables: Parquet partitioned by run, batch and event date, or any JDBC table.

A row holds the family's table columns, the arrival columns and, for filter matches, ``filter_id``.  The
run, the arrival columns and ``filter_id`` identify a row, so no serial number is made up.

Every writer, batch or stream, writes ``run=<run>/batch_id=<n>/`` below the table's folder, so any number of them
may share one.  A batch job is a run of its own; a stream's run is kept in its checkpoint, so that a micro-batch that
is run again meets what it wrote and a new checkpoint never touches an older one's rows.  What is whole is noted in a log
(``commits``), and ``read_table`` and its like give nothing else.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ticktape import schemas as S
from ticktape.sinks import commits
from ticktape.sources import frames as frame_sources

_DAY_MS = 86_400_000
_OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
_STAGED_ROW_GROUP = 32 * 1024 * 1024
# 0001-01-01 and 9999-12-31 in epoch days, the dates a partition can be named after.
_FIRST_DAY, _LAST_DAY = -719162, 2932896


def event_date(timestamp_ms: Column) -> Column:
    """UTC date of an epoch-millisecond column, whatever the session zone; NULL outside years 1 to 9999."""
    day = F.floor(timestamp_ms / _DAY_MS)
    return F.when(day.between(_FIRST_DAY, _LAST_DAY), F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int")))


def table_rows(events: DataFrame, family: S.Family, conditions: str = "keep") -> DataFrame:
    """Events as table rows.  A missing value in a required column is an error.

    ``conditions='as_run'`` stores trades with the plain trade code and no conditions.
    """
    if conditions not in ("keep", "as_run"):
        raise ValueError(f"conditions must be 'keep' or 'as_run', not {conditions!r}")
    columns = []
    for f in family.fields:
        value = F.col(f.column)
        if conditions == "as_run" and family is S.TRADE and f.column == "conditions":
            value = F.array().cast(S.LONGS)
        elif conditions == "as_run" and family is S.TRADE and f.column == "event_type":
            value = F.lit(S.TRADE.event_types[0])
        elif not f.optional:
            missing = F.raise_error(F.lit(f"{family.name}.{f.column} must not be null"))
            value = F.when(value.isNull(), missing).otherwise(value)
        columns.append(value.alias(f.column))
    extra = S.arrival_columns(events.columns) + [c for c in ("filter_id",) if c in events.columns]
    return events.select(*columns, *extra, event_date(F.col("timestamp")).alias("event_date"))


def table_path(root: str, family: S.Family) -> str:
    return f"{root.rstrip('/')}/{family.name}s"


def new_run() -> str:
    """The name of a run that nobody has used yet."""
    return f"r-{uuid.uuid4().hex}"


def stream_run(spark: SparkSession, checkpoint: str) -> str:
    """The run of a checkpoint: made up once and kept inside it."""
    path = f"{checkpoint.rstrip('/')}/run"
    try:
        return spark.read.schema("run STRING").json(path).first()["run"]
    except AnalysisException:  # the checkpoint is new
        run = new_run()
        spark.createDataFrame([(run,)], "run STRING").coalesce(1).write.json(path)
        return run


def append(
    rows: DataFrame, path: str, run: str | None = None, batch_id: int = 0, by: str | None = "event_date", commit: bool = True,
    row_group: int | None = None,
) -> None:
    """Rows of one run and batch, partitioned by ``by``, in row groups of ``row_group`` bytes, noted in the log when they are in place.

    A batch that the log holds is not written again.  With ``commit=False`` the caller notes it, together with other tables.
    """
    spark, (root, name) = rows.sparkSession, commits.place(path)
    if commit and run is not None and commits.is_done(spark, root, [name], run, batch_id):
        return
    run = run or new_run()
    writer = rows.write.mode("overwrite")
    if by is not None:
        writer = writer.partitionBy(by)
    if row_group is not None:
        writer = writer.option("parquet.block.size", row_group)
    writer.parquet(f"{path.rstrip('/')}/run={run}/batch_id={batch_id}")
    if commit:
        commits.record(spark, root, [name], run, batch_id)


def write_table(
    events: DataFrame, family: S.Family, root: str, conditions: str = "keep", run: str | None = None, batch_id: int = 0,
    rebalance: bool = True, commit: bool = True,
) -> None:
    """Append events to the family's table.

    ``rebalance`` lets Spark even out the files: small dates share a task, a large one is split over many.
    """
    rows = table_rows(events, family, conditions)
    append(rows.hint("rebalance", "event_date") if rebalance else rows, table_path(root, family), run, batch_id, commit=commit)


def read_table(spark: SparkSession, family: S.Family, root: str, as_of: int | None = None) -> DataFrame:
    """The family's table, as written by all finished runs, or by those that had finished ``as_of`` an entry of the log.  Columns
    that a run did not have are NULL."""
    arrival = [T.StructField(c, S.ARRIVAL_TYPES[c]) for c in S.ARRIVAL_COLUMNS]
    schema = T.StructType([*family.table_schema.fields, *arrival, T.StructField("filter_id", T.StringType())])
    path = table_path(root, family)
    return commits.visible(spark.read.schema(schema).parquet(path), path, as_of)


def read_appended(spark: SparkSession, path: str, as_of: int | None = None) -> DataFrame:
    """Alerts, rejects or any other table that ``append`` wrote: its finished runs and batches."""
    return commits.visible(spark.read.parquet(path), path, as_of)


def for_each(frames: DataFrame, checkpoint: str, write: Callable[[DataFrame, str, int], None]) -> DataStreamWriter:
    """A stream whose micro-batches ``write`` gets, each with the checkpoint's run and its own number."""

    def one(batch: DataFrame, batch_id: int) -> None:
        write(batch, stream_run(batch.sparkSession, checkpoint), batch_id)

    return frames.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)


def stream_table(
    events: DataFrame, family: S.Family, root: str, checkpoint: str, conditions: str = "keep"
) -> DataStreamWriter:
    """Append a stream of events to the family's table, exactly once.  Add a trigger and start it."""

    def write(batch: DataFrame, run: str, batch_id: int) -> None:
        write_table(batch, family, root, conditions, run, batch_id, rebalance=False)

    return for_each(events, checkpoint, write)


def write_staged(staged: DataFrame, path: str, run: str | None = None, batch_id: int = 0, commit: bool = True) -> None:
    """Write ``stage_events`` output: every family and the rejects of one pass over the frames.

    A task keeps a file open for each family, so that it need not sort its rows by family, which holds all of them.  Row groups
    are smaller in turn.
    """
    with _files_open_at_once(staged.sparkSession, len(S.FAMILIES) + 1):
        append(staged, path, run, batch_id, by="family", commit=commit, row_group=_STAGED_ROW_GROUP)


@contextmanager
def _files_open_at_once(spark: SparkSession, n: int) -> Iterator[None]:
    """Writes meanwhile sort by partition only from the ``n``-th file of a task on."""
    before = spark.conf.get(_OPEN_FILES, None)
    spark.conf.set(_OPEN_FILES, n + 1)
    try:
        yield
    finally:
        spark.conf.unset(_OPEN_FILES) if before is None else spark.conf.set(_OPEN_FILES, before)


def write_alerts(
    alerts: DataFrame, path: str, run: str | None = None, batch_id: int = 0, rebalance: bool = True, commit: bool = True
) -> None:
    """Publish alerts, or any measured bars, to a table by UTC date."""
    dated = alerts.withColumn("event_date", event_date(F.col("timestamp")))
    append(dated.hint("rebalance", "event_date") if rebalance else dated, path, run, batch_id, commit=commit)


def write_rejects(
    staged: DataFrame, root: str, run: str | None = None, batch_id: int = 0, commit: bool = True, lost: DataFrame | None = None
) -> None:
    """The rejects among ``stage_events`` rows, with their reason, and the files that were ``lost``."""
    columns = [*S.arrival_columns(staged.columns), "raw", "reason"]
    rows = staged.where(F.col("family") == "reject").select(*columns)
    rows = rows if lost is None else rows.unionByName(lost, allowMissingColumns=True)
    append(rows, f"{root.rstrip('/')}/rejects", run, batch_id, None, commit)


def note_lost_files(spark: SparkSession, path: str, root: str, read=frame_sources.read_frame_table) -> int:
    """Adds the damaged files under ``path`` that ``rejects`` does not name yet, for streams that read on over them; their number."""
    lost = frame_sources.lost_rows(spark, frame_sources.unreadable_files(spark, frame_sources.landed_files(spark, path), read))
    rejects = f"{root.rstrip('/')}/rejects"
    try:
        known = read_appended(spark, rejects).where(F.col("reason") == S.UNREADABLE_FILE).select("raw").distinct()
        lost = lost.join(known, "raw", "left_anti")
    except AnalysisException:  # no rejects so far
        pass
    files = [r["raw"] for r in lost.collect()]
    if files:
        append(frame_sources.lost_rows(spark, files), rejects, by=None)
    return len(files)


def database_rows(events: DataFrame, family: S.Family, conditions: str = "keep") -> DataFrame:
    """Table rows for a SQL database: table columns only, arrays as JSON text."""
    rows = table_rows(events, family, conditions)
    return rows.select(
        *[
            (F.to_json(F.col(f.column)) if isinstance(f.type, T.ArrayType) else F.col(f.column)).alias(f.column)
            for f in family.fields
        ]
    )


def write_jdbc(
    events: DataFrame, family: S.Family, url: str, table: str, properties: dict | None = None, conditions: str = "keep"
) -> None:
    """Append events to a database table.  Needs the database's JDBC driver on the class path.

    For PostgreSQL JSONB columns add ``{"stringtype": "unspecified"}`` to ``properties``.
    """
    database_rows(events, family, conditions).write.mode("append").jdbc(url, table, properties=properties or {})
