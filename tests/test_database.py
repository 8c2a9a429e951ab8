"""Batches into a database once each, on a database file that needs no server."""

import sqlite3

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from ticktape import schemas as S
from ticktape.plans import event_feed as feed
from ticktape.sinks import database, tables

COLUMNS = S.TRADE.columns


@pytest.fixture
def trade_table(tmp_path):
    path = str(tmp_path / "trades.db")
    table = database.DatabaseTable(lambda: sqlite3.connect(path, timeout=120), "trades")
    connection = table.connect()
    connection.execute(f"CREATE TABLE trades (id INTEGER PRIMARY KEY, {', '.join(COLUMNS)})")
    connection.close()
    return table


def _rows(table, sql=f"SELECT {', '.join(COLUMNS)} FROM trades"):
    connection = table.connect()
    try:
        return sorted(connection.execute(sql).fetchall(), key=repr)
    finally:
        connection.close()


def _expected(trades, times=1):
    return sorted([tuple(r) for r in tables.database_rows(trades, S.TRADE).collect()] * times, key=repr)


def test_a_batch_written_twice_is_there_once(spark, sf_dir, trade_table):
    trades = feed.trades(feed.read_events(spark, sf_dir)).repartition(6)
    for run, batch in (("r", 0), ("r", 0), ("r", 1), ("s", 0), ("r", 1)):
        database.write_events(trades, S.TRADE, trade_table, run, batch)
    assert _rows(trade_table) == _expected(trades, 3)
    assert _rows(trade_table, "SELECT * FROM trades_ledger") == [("r", 0), ("r", 1), ("s", 0)]
    assert _rows(trade_table, "SELECT * FROM trades_staged") == []


def test_attempts_that_do_not_count_leave_nothing(spark, sf_dir, trade_table):
    """A task's first attempt stages its rows and dies; a driver died between the phases before."""
    trade_table.prepare()
    plain = [("XT", "A", 1.0, 1, 1.0, "[]", None, 1, 1)]
    trade_table.stage(COLUMNS, plain, "r", 0)
    lost = trade_table.stage(COLUMNS, plain * 3, "r", 0)
    kept = trade_table.stage(COLUMNS, plain * 2500, "r", 0)
    assert lost != kept and _rows(trade_table) == []
    trade_table.finish(COLUMNS, [kept], "r", 0)
    assert _rows(trade_table) == plain * 2500
    # A second writer of the batch, past the first look at the ledger.
    again = trade_table.stage(COLUMNS, plain, "r", 0)
    trade_table.finish(COLUMNS, [again], "r", 0)
    assert _rows(trade_table) == plain * 2500 and _rows(trade_table, "SELECT * FROM trades_staged") == []


def test_a_failing_batch_shows_nothing_and_can_be_repeated(spark, sf_dir, trade_table):
    trades = feed.trades(feed.read_events(spark, sf_dir)).repartition(4)

    @F.udf("double")
    def broken(size):
        if TaskContext.get().partitionId() == 2:
            raise ValueError("lost")
        return size

    with pytest.raises(Exception, match="lost"):
        database.write_events(trades.withColumn("size", broken("size")), S.TRADE, trade_table, "r", 0)
    assert _rows(trade_table) == [] and not trade_table.is_done("r", 0)
    database.write_events(trades, S.TRADE, trade_table, "r", 0)
    assert _rows(trade_table) == _expected(trades)


def test_a_move_that_fails_halfway_is_undone(spark, trade_table):
    trade_table.prepare()
    attempt = trade_table.stage(COLUMNS, [("XT", "A", 1.0, 1, 1.0, "[]", None, 1, 1)], "r", 0)
    with pytest.raises(sqlite3.Error):
        trade_table.finish([*COLUMNS, "no_such_column"], [attempt], "r", 0)
    assert _rows(trade_table) == [] and not trade_table.is_done("r", 0)


def test_a_stream_whose_last_batch_is_repeated(spark, sf_dir, trade_table, tmp_path):
    """The database has the batch, the checkpoint does not say so: the stream writes it again."""
    trades = feed.trades(feed.read_events(spark, sf_dir))
    landed, checkpoint = str(tmp_path / "landed"), str(tmp_path / "checkpoint")
    trades.repartition(3).write.parquet(landed)
    stream = spark.readStream.schema(trades.schema).option("maxFilesPerTrigger", 1).parquet(landed)

    def run():
        query = database.stream_events(stream, S.TRADE, trade_table, checkpoint).trigger(availableNow=True).start()
        query.awaitTermination(300)

    run()
    last = max(int(p.name) for p in (tmp_path / "checkpoint" / "commits").iterdir() if p.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        (tmp_path / "checkpoint" / "commits" / name).unlink(missing_ok=True)
    run()
    assert last == 2 and _rows(trade_table) == _expected(trades)


def test_empty_batches_and_names(spark, sf_dir, trade_table):
    none = feed.trades(feed.read_events(spark, sf_dir)).limit(0)
    database.write_events(none, S.TRADE, trade_table, "r", 0)
    assert _rows(trade_table) == [] and trade_table.is_done("r", 0)
    with pytest.raises(ValueError):
        database.DatabaseTable(trade_table.connect, "trades; DROP TABLE trades")
