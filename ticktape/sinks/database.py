"""Events into a SQL database exactly once, in two phases, with a ledger of batches.

Tasks insert their rows into ``<table>_staged``, each attempt under an id of its own.  When all have ended, one transaction moves the
rows of the attempts that count to the table, notes (run, batch) in ``<table>_ledger`` and empties the staged rows of the batch.  So
readers of the table see a whole batch or none; a task that is run again, or twice at once, leaves its rows once; a batch
that the ledger holds is not written again, whether it is repeated because the driver died before or after Spark noted it.

Connections come from a function without arguments that gives a DB-API connection, as tasks open their own.  ``marker`` is how
the driver writes a parameter (``?`` or ``%s``).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.streaming import DataStreamWriter

from ticktape import schemas as S
from ticktape.sinks import tables

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)?")
#: Rows of one insert call.
_TOGETHER = 1000


@dataclass(frozen=True)
class DatabaseTable:
    """A table that exists, with the side tables that make writing to it repeatable."""

    connect: Callable[[], Any]
    name: str
    marker: str = "?"

    def __post_init__(self):
        if not _NAME.fullmatch(self.name):
            raise ValueError(f"not a table name: {self.name!r}")

    def prepare(self) -> None:
        """Make the side tables where they are missing."""
        self._transaction([
            (
                f"CREATE TABLE IF NOT EXISTS {self.name}_staged AS SELECT CAST('' AS VARCHAR(200)) AS of_run, CAST(0 AS BIGINT) AS of_batch, "
                f"CAST('' AS VARCHAR(40)) AS of_attempt, t.* FROM {self.name} t WHERE 1 = 0",
                (),
            ),
            (f"CREATE TABLE IF NOT EXISTS {self.name}_ledger (run VARCHAR(200) NOT NULL, batch_id BIGINT NOT NULL, PRIMARY KEY (run, batch_id))", ()),
        ])

    def is_done(self, run: str, batch_id: int) -> bool:
        connection = self.connect()
        try:
            cursor = connection.cursor()
            cursor.execute(f"SELECT 1 FROM {self.name}_ledger WHERE run = {self.marker} AND batch_id = {self.marker}", (run, batch_id))
            return cursor.fetchone() is not None
        finally:
            connection.close()

    def write(self, rows: DataFrame, run: str, batch_id: int) -> None:
        """Add the rows as one batch, unless the ledger holds it.  The columns are found by their names."""
        self.prepare()
        if self.is_done(run, batch_id):
            return
        source = _source(self, run, batch_id)
        rows.sparkSession.dataSource.register(source)
        rows.write.format(source.name()).mode("append").save()

    def stage(self, columns: list[str], rows, run: str, batch_id: int) -> str:
        """A task's rows under a new attempt, which is returned."""
        attempt, connection = uuid.uuid4().hex, self.connect()
        try:
            cursor, waiting = connection.cursor(), []
            names, values = ", ".join(columns), ", ".join([self.marker] * (3 + len(columns)))
            insert = f"INSERT INTO {self.name}_staged (of_run, of_batch, of_attempt, {names}) VALUES ({values})"
            for row in rows:
                waiting.append((run, batch_id, attempt, *row))
                if len(waiting) == _TOGETHER:
                    cursor.executemany(insert, waiting)
                    waiting = []
            if waiting:
                cursor.executemany(insert, waiting)
            connection.commit()
            return attempt
        finally:
            connection.close()

    def finish(self, columns: list[str], attempts: list[str], run: str, batch_id: int) -> None:
        """Move what counts to the table and note the batch, all or nothing."""
        m, names, batch = self.marker, ", ".join(columns), (run, batch_id)
        # The ledger first: of two writers of one batch the second fails here and leaves nothing.
        steps = [(f"INSERT INTO {self.name}_ledger (run, batch_id) VALUES ({m}, {m})", batch)]
        move = f"INSERT INTO {self.name} ({names}) SELECT {names} FROM {self.name}_staged WHERE of_run = {m} AND of_batch = {m} AND of_attempt = {m}"
        steps += [(move, (*batch, attempt)) for attempt in attempts]
        try:
            self._transaction([*steps, self._discard(run, batch_id)])
        except Exception:
            if not self.is_done(run, batch_id):
                raise
            self.discard(run, batch_id)

    def discard(self, run: str, batch_id: int) -> None:
        """Empty the staged rows of a batch that was given up or is in the table already."""
        self._transaction([self._discard(run, batch_id)])

    def _discard(self, run: str, batch_id: int) -> tuple[str, tuple]:
        return f"DELETE FROM {self.name}_staged WHERE of_run = {self.marker} AND of_batch = {self.marker}", (run, batch_id)

    def _transaction(self, steps: list[tuple[str, tuple]]) -> None:
        connection = self.connect()
        try:
            cursor = connection.cursor()
            for sql, values in steps:
                cursor.execute(sql, values)
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        finally:
            connection.close()


@dataclass
class Staged(WriterCommitMessage):
    """What a task that ended left."""

    attempt: str


def _source(table: DatabaseTable, run: str, batch_id: int) -> type[DataSource]:
    """A sink for one batch; it takes its settings along, as options could only be texts."""

    class Writer(DataSourceWriter):
        def __init__(self, schema):
            self.columns = schema.fieldNames()

        def write(self, iterator):
            return Staged(table.stage(self.columns, iterator, run, batch_id))

        def commit(self, messages):
            table.finish(self.columns, [m.attempt for m in messages if m is not None], run, batch_id)

        def abort(self, messages):
            table.discard(run, batch_id)

    class Sink(DataSource):
        @classmethod
        def name(cls):
            return "ticktape_database"

        def writer(self, schema, overwrite):
            return Writer(schema)

    return Sink


def write_events(events: DataFrame, family: S.Family, table: DatabaseTable, run: str, batch_id: int = 0, conditions: str = "keep") -> None:
    """Events of a family as one batch: table columns, arrays as JSON text."""
    table.write(tables.database_rows(events, family, conditions), run, batch_id)


def stream_events(
    events: DataFrame, family: S.Family, table: DatabaseTable, checkpoint: str, conditions: str = "keep"
) -> DataStreamWriter:
    """A stream of events into a database table, exactly once.  Add a trigger and start it."""
    return tables.for_each(events, checkpoint, lambda batch, run, batch_id: write_events(batch, family, table, run, batch_id, conditions))
