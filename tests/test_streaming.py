"""Streams give what the batch operators give, also over several micro-batches and after a restart."""

import pytest
from pyspark.sql import functions as F
from test_decode import TRADE

from ticktape import schemas as S
from ticktape.operators import decode, filters
from ticktape.operators.price_action import price_action
from ticktape.plans import market
from ticktape.sinks import tables
from ticktape.plans import event_feed as feed
from ticktape.sources import frames as frame_sources
from ticktape.streaming import prices, trades, workdir


def _rows(df):
    return sorted(map(repr, df.collect()))


def _run(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_trade_stream_equals_batch(spark, sf_dir, tmp_path):
    frames = feed.mixed_frames(feed.trades(feed.read_events(spark, sf_dir)))
    landed, root = str(tmp_path / "landed"), str(tmp_path / "root")
    frames.repartition(6).select("frame").write.text(landed)
    stream = lambda: trades.persist_matches(
        frame_sources.stream_text_frames(spark, landed, max_files=2), root, str(tmp_path / "checkpoint")
    )
    assert len(_run(stream()).recentProgress) >= 3
    columns = [*S.TRADE.columns, "filter_id"]
    batch = market.trade_matches(frames).select(*columns)
    assert _rows(tables.read_table(spark, S.TRADE, root).select(*columns)) == _rows(batch)
    # Nothing new has landed, so a second run adds nothing; a new file is picked up once.
    _run(stream())
    assert tables.read_table(spark, S.TRADE, root).count() == batch.count()
    spark.createDataFrame([(TRADE,)], "frame string").write.mode("append").text(landed)
    _run(stream())
    assert tables.read_table(spark, S.TRADE, root).count() == batch.count() + 1


@pytest.mark.parametrize("limits", [{}, {"max_broadcast_bytes": 0}, {"max_broadcast_bytes": 0, "salts": 4}])
def test_trade_stream_with_a_config_table(spark, sf_dir, tmp_path, limits):
    frames = feed.mixed_frames(feed.trades(feed.read_events(spark, sf_dir)))
    frames.write.parquet(str(tmp_path / "landed"))
    chosen = {"table": filters.table_filter(filters.criteria_table(spark, filters.DEFAULT_CRITERIA), **limits)}
    landed = frame_sources.stream_frame_table(spark, str(tmp_path / "landed"))
    _run(trades.persist_matches(landed, str(tmp_path / "root"), str(tmp_path / "checkpoint"), chosen))
    columns = [*S.TRADE.columns, "ingest_seq"]
    stored = tables.read_table(spark, S.TRADE, str(tmp_path / "root"))
    assert _rows(stored.select(*columns)) == _rows(market.trade_matches(frames).select(*columns))


def _land_bars(spark, bars, path, low, high):
    part = bars.where((F.col("ingest_seq") >= low) & (F.col("ingest_seq") < high))
    feed.family_frames(part, S.BAR).write.mode("append").parquet(path)


def _price_stream(spark, tmp_path, **options):
    landed = frame_sources.stream_frame_table(spark, str(tmp_path / "landed"), max_files=1000)
    bars = decode.decode_family(decode.split_frames(landed), S.BAR)
    return prices.price_action_stream(bars, str(tmp_path / "out"), str(tmp_path / "checkpoint"), 50.0, **options)


def test_price_stream_carries_prices(spark, sf_dir, tmp_path):
    trade_rows = feed.trades(feed.read_events(spark, sf_dir))
    bars = feed.bars(trade_rows).unionByName(feed.bars(trade_rows, feed.SECOND_MS, S.SECOND_BAR)).cache()
    end = bars.agg(F.max("ingest_seq")).first()[0] + 1
    cuts = [0, end // 5, end // 2, end // 2 + 1, end]
    for low, high in zip(cuts, cuts[1:]):
        _land_bars(spark, bars, str(tmp_path / "landed"), low, high)
        _run(_price_stream(spark, tmp_path))
    columns = ["event_type", "pair", "timestamp", "last", "direction", "pct", "kind"]
    got = prices.read_price_action(spark, str(tmp_path / "out"))
    assert got.select("batch_id").distinct().count() == 4
    assert _rows(got.select(*columns)) == _rows(price_action(bars, 50.0).select(*columns))


def test_a_repeated_micro_batch_changes_nothing(spark, sf_dir, tmp_path):
    """As when a batch has written its output but the stream stopped before noting so."""
    import glob
    import os

    bars = feed.bars(feed.trades(feed.read_events(spark, sf_dir))).cache()
    end = bars.agg(F.max("ingest_seq")).first()[0] + 1
    for low, high in ((0, end // 2), (end // 2, end)):
        _land_bars(spark, bars, str(tmp_path / "landed"), low, high)
        _run(_price_stream(spark, tmp_path))
    before = _rows(prices.read_price_action(spark, str(tmp_path / "out")))
    for file in glob.glob(str(tmp_path / "checkpoint" / "commits" / "*1*")) + glob.glob(
        str(tmp_path / "checkpoint" / "commits" / ".*1*")
    ):
        os.remove(file)
    _run(_price_stream(spark, tmp_path))
    assert _rows(prices.read_price_action(spark, str(tmp_path / "out"))) == before


def test_price_stream_per_bar(spark, sf_dir, tmp_path):
    bars = feed.bars(feed.trades(feed.read_events(spark, sf_dir)))
    _land_bars(spark, bars, str(tmp_path / "landed"), 0, 1 << 62)
    _run(_price_stream(spark, tmp_path, scope="bar"))
    assert _rows(prices.read_price_action(spark, str(tmp_path / "out")).select("pair", "timestamp", "last", "pct")) == _rows(
        price_action(bars, 50.0, scope="bar").select("pair", "timestamp", "last", "pct")
    )


def test_price_stream_needs_an_order(spark, tmp_path):
    (tmp_path / "landed").mkdir()
    frames = frame_sources.stream_text_frames(spark, str(tmp_path / "landed"))
    with pytest.raises(ValueError):
        prices.price_action_stream(decode.decode_family(decode.split_frames(frames), S.BAR), "out", "checkpoint")


def test_shared_folder_comes_from_the_session(spark):
    assert workdir.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert workdir.new_folder(spark, "x") != workdir.new_folder(spark, "x")


def _tasks_with_rows(df):
    return df.select(F.spark_partition_id()).distinct().count()


def test_a_single_row_group_is_dealt_out(spark, tmp_path):
    """Many splits, all but one of them empty."""
    path = str(tmp_path / "frames")
    spark.range(20_000).selectExpr("id AS ingest_seq", "sha2(string(id), 256) AS frame").coalesce(1).write.parquet(path)
    settings = {"spark.sql.files.maxPartitionBytes": "100k", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        cores = spark.sparkContext.defaultParallelism
        assert spark.read.parquet(path).rdd.getNumPartitions() >= cores and _tasks_with_rows(spark.read.parquet(path)) == 1
        rows = frame_sources.read_frame_table(spark, path)
        assert _tasks_with_rows(rows) >= cores and rows.count() == 20_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_micro_batch_of_one_file_is_decoded_by_many_tasks(spark, sf_dir, tmp_path, monkeypatch):
    feed.family_frames(feed.trades(feed.read_events(spark, sf_dir)), S.TRADE).coalesce(1).write.parquet(f"{tmp_path}/landed")
    seen, stage_events = [], decode.stage_events

    def noted(frames, *a):
        seen.append(_tasks_with_rows(frames))
        return stage_events(frames, *a)

    monkeypatch.setattr(decode, "stage_events", noted)
    landed = frame_sources.stream_frame_table(spark, f"{tmp_path}/landed")
    trades.persist_all(landed, f"{tmp_path}/root", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 1 and seen[0] > 1
