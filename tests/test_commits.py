"""Readers see finished runs and batches only, and an older answer can be had again."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from ticktape import schemas as S
from ticktape.operators import decode
from ticktape.plans import event_feed as feed
from ticktape.sinks import commits, tables
from ticktape.sources import frames as frame_sources
from ticktape.streaming import prices, trades


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    return feed.trades(feed.read_events(spark, sf_dir)).where("ingest_seq < 60").withColumn("pos", F.lit(0)).cache()


def _seen(spark, root, as_of=None):
    return sorted(r["ingest_seq"] for r in tables.read_table(spark, S.TRADE, root, as_of).select("ingest_seq").collect())


def test_a_writer_that_dies_halfway_leaves_no_visible_row(spark, events, tmp_path):
    root = str(tmp_path)
    tables.write_table(events.where("ingest_seq < 10"), S.TRADE, root, run="a")
    torn = events.where("ingest_seq >= 10").withColumn("price", F.when(F.col("ingest_seq") < 40, F.col("price")))
    with pytest.raises(Exception):  # a null in a required column stops the job
        tables.write_table(torn.repartition(8), S.TRADE, root, run="b")
    tables.write_table(events.where("ingest_seq >= 50"), S.TRADE, root, run="b", commit=False)
    assert _seen(spark, root) == list(range(10))
    tables.write_table(events.where("ingest_seq >= 10"), S.TRADE, root, run="b")
    assert _seen(spark, root) == list(range(60))


def test_an_older_answer_is_repeated(spark, events, tmp_path):
    root, answers = str(tmp_path), []
    for n in range(3):
        tables.write_table(events.where(F.col("ingest_seq") % 3 == n), S.TRADE, root, run="s", batch_id=n)
        answers.append((commits.newest(spark, root), _seen(spark, root)))
    assert [len(a) for _, a in answers] == [20, 40, 60] and [at for at, _ in answers] == sorted({at for at, _ in answers})
    for at, answer in answers:
        assert _seen(spark, root, at) == answer
    assert _seen(spark, root, answers[0][0] - 1) == []


def test_a_finished_batch_is_not_written_again(spark, events, tmp_path):
    root = str(tmp_path)
    tables.write_table(events, S.TRADE, root, run="a", batch_id=4)
    files = sorted(glob.glob(f"{root}/trades/run=a/batch_id=4/**/*.parquet", recursive=True))
    tables.write_table(events.where("false"), S.TRADE, root, run="a", batch_id=4)
    assert sorted(glob.glob(f"{root}/trades/run=a/batch_id=4/**/*.parquet", recursive=True)) == files
    assert commits.is_done(spark, root, ["trades"], "a", 4) and not commits.is_done(spark, root, ["trades", "alerts"], "a", 4)


def test_tables_from_before_the_log(spark, events, tmp_path):
    path = f"{tmp_path}/trades"
    tables.append(tables.table_rows(events, S.TRADE), path, "old", 0, commit=False)
    assert _seen(spark, str(tmp_path)) == list(range(60))  # no log: all there is
    commits.adopt(spark, path)
    tables.write_table(events.where("false"), S.TRADE, str(tmp_path), run="new")
    assert _seen(spark, str(tmp_path)) == list(range(60))


def test_unfinished_folders_are_pruned_not_read(spark, events, tmp_path):
    root = str(tmp_path)
    tables.write_table(events, S.TRADE, root, run="a")
    tables.write_table(events, S.TRADE, root, run="b", commit=False)
    plan = tables.read_table(spark, S.TRADE, root)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()


def test_one_stream_feeds_all_tables_or_none(spark, sf_dir, tmp_path, monkeypatch):
    """A micro-batch that fails in its last table shows in none of them, and once it is run again in all."""
    trade_rows = feed.trades(feed.read_events(spark, sf_dir)).where("ingest_seq < 200")
    bars = feed.bars(trade_rows, feed.SECOND_MS, S.SECOND_BAR)
    all_frames = feed.family_frames(trade_rows, S.TRADE).unionByName(feed.family_frames(bars, S.BAR))
    all_frames.coalesce(1).write.parquet(f"{tmp_path}/landed")
    root, checkpoint = f"{tmp_path}/root", f"{tmp_path}/checkpoint"

    def run():
        landed = frame_sources.stream_frame_table(spark, f"{tmp_path}/landed")
        query = trades.persist_all(landed, root, checkpoint, topic_names=None, threshold=5.0, store=(S.BAR,)).trigger(availableNow=True).start()
        query.awaitTermination()

    with monkeypatch.context() as broken:
        broken.setattr(tables, "write_rejects", lambda *a, **k: 1 / 0)
        with pytest.raises(Exception):
            run()
    assert os.path.isdir(f"{root}/trades") and commits.entries(spark, root) is None
    run()
    assert {r["name"] for r in commits.entries(spark, root).collect()} == {"trades", "alerts", "bars", "rejects"}
    stored = tables.read_table(spark, S.BAR, root)
    assert stored.count() == bars.count() and tables.read_table(spark, S.TRADE, root).count() > 0
    plan = decode.stage_events(all_frames, (S.TRADE, S.BAR))
    assert plan.where("family = 'bar'").count() == bars.count()
    run()
    assert tables.read_table(spark, S.BAR, root).count() == bars.count()
    assert prices.read_price_action(spark, f"{root}/alerts").count() == tables.read_appended(spark, f"{root}/alerts").count()
