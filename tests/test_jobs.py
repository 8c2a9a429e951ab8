"""The command-line jobs and the remaining sinks."""

import json

import pytest
from test_decode import BOOK, MINUTE, QUOTE, TRADE

from ticktape import __main__ as jobs
from ticktape import schemas as S
from ticktape.operators.price_action import alerts, price_action
from ticktape.sinks import publish, tables


def _land(tmp_path, lines):
    (tmp_path / "landed").mkdir()
    (tmp_path / "landed" / "a.txt").write_text("\n".join(lines))
    return str(tmp_path / "landed")


def test_batch_job_with_a_saved_config(spark, tmp_path):
    config = tmp_path / "config.json"
    config.write_text('{"pair":"BTC-USD","criteria":[{"field":"price","operation":"<","value":{"Number":100}}]}')
    frames = _land(tmp_path, [TRADE, TRADE.replace("45000.5", "45"), TRADE.replace("BTC-USD", "DOGE-USD"), MINUTE])
    root = str(tmp_path / "root")
    jobs.main(["batch", "--frames", frames, "--root", root, "--config", str(config), "--threshold", "1", "--topics"])
    stored = tables.read_table(spark, S.TRADE, root).select("pair", "price").collect()
    assert sorted(map(tuple, stored)) == [("BTC-USD", 45.0), ("DOGE-USD", 45000.5)]
    assert spark.read.parquet(f"{root}/alerts").count() == 1


def test_trade_job(spark, tmp_path):
    frames, root = _land(tmp_path, [TRADE, TRADE.replace("BTC-USD", "DOGE-USD"), "oops"]), str(tmp_path / "root")
    jobs.main(["trades", "--frames", frames, "--root", root, "--checkpoint", str(tmp_path / "checkpoint"),
               "--conditions", "as_run"])
    row = tables.read_table(spark, S.TRADE, root).collect()
    assert [(r.pair, r.conditions, r.filter_id) for r in row] == [("BTC-USD", [], "default")]
    assert [(r.raw, r.reason) for r in spark.read.parquet(f"{root}/rejects").collect()] == [("oops", "bad_json")]


def test_stage_job(spark, tmp_path):
    frames, root = _land(tmp_path, [f"[{TRADE},{QUOTE}]", MINUTE, BOOK, "oops"]), str(tmp_path / "root")
    jobs.main(["stage", "--frames", frames, "--root", root, "--checkpoint", str(tmp_path / "checkpoint"), "--families", "quote", "bar", "--topics"])
    assert tables.read_table(spark, S.QUOTE, root).count() == tables.read_table(spark, S.BAR, root).count() == 1
    assert not (tmp_path / "root" / "books").exists()


def test_streamed_rows_have_places_of_their_own(spark, tmp_path):
    """Equal frames in one landed file, and a second stream over the same files."""
    frames, root = _land(tmp_path, [TRADE, TRADE, f"[{TRADE},{TRADE}]"]), str(tmp_path / "root")
    for n in (1, 2):
        jobs.main(["trades", "--frames", frames, "--root", root, "--checkpoint", str(tmp_path / f"checkpoint-{n}")])
    stored = tables.read_table(spark, S.TRADE, root)
    assert stored.count() == 8
    assert stored.select("run", "ingest_ts", "ingest_src", "ingest_seq", "pos", "filter_id").distinct().count() == 8


def test_ordered_text_in_blocks_equals_the_batch(spark, tmp_path):
    closes = [100.0 + (i * 37 % 101) for i in range(400)]
    frames, root = _land(tmp_path, [MINUTE.replace('"c":101.5', f'"c":{c}') for c in closes]), str(tmp_path / "root")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        jobs.main(["alerts", "--frames", frames, "--root", root, "--checkpoint", str(tmp_path / "checkpoint"), "--threshold", "5"])
        jobs.main(["batch", "--frames", frames, "--root", f"{root}-batch", "--threshold", "5"])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got, want = (sorted((r["last"], r["close"], r.kind) for r in spark.read.parquet(f"{r}/alerts").collect()) for r in (root, f"{root}-batch"))
    steps = list(zip([100.0, *closes], closes))
    assert got == want == sorted((a, b, "spike" if b > a else "drop") for a, b in steps if abs(b - a) / a * 100 > 5)
    assert spark.read.parquet(f"{root}/alerts").select("ingest_src").distinct().count() > 5


def test_watch_prints_a_stream(spark, tmp_path):
    frames = _land(tmp_path, ["a", "b"])
    query = publish.watch(spark.readStream.text(frames)).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sum(p["numInputRows"] for p in query.recentProgress) == 2


def test_alert_job_on_text_files_in_order(spark, tmp_path):
    import os

    closes = [150.0, 75.0, 75.0, 300.0, 100.0, 101.0]
    texts = [MINUTE.replace('"c":101.5', f'"c":{c}') for c in closes]
    frames, root = _land(tmp_path, texts[:4]), str(tmp_path / "root")
    later = tmp_path / "landed" / "b.txt"
    later.write_text("\n".join(texts[4:]) + "\n")
    os.utime(later, (2_000_000_000, 2_000_000_000))
    jobs.main(["alerts", "--frames", frames, "--root", root, "--checkpoint", str(tmp_path / "checkpoint"),
               "--threshold", "5", "--max-files", "1"])
    rows = spark.read.parquet(f"{root}/alerts").orderBy("ingest_ts", "ingest_seq").collect()
    assert [(r.batch_id, r.kind, r["last"], r.close) for r in rows] == [
        (0, "spike", 100.0, 150.0), (0, "drop", 150.0, 75.0), (0, "spike", 75.0, 300.0), (1, "drop", 300.0, 100.0)
    ]


def test_alert_job_on_a_table(spark, tmp_path):
    path, root = str(tmp_path / "landed"), str(tmp_path / "root")
    texts = [MINUTE, MINUTE.replace('"c":101.5', '"c":50'), MINUTE.replace('"c":101.5', '"c":50.1')]
    spark.createDataFrame(list(enumerate(texts)), "ingest_seq bigint, frame string").write.parquet(path)
    jobs.main(["alerts", "--table", "--frames", path, "--root", root, "--checkpoint", str(tmp_path / "checkpoint"), "--threshold", "1"])
    rows = spark.read.parquet(f"{root}/alerts").collect()
    assert sorted((r.kind, r["last"], r.close) for r in rows) == [("drop", 101.5, 50.0), ("spike", 100.0, 101.5)]


def test_streams_need_a_checkpoint():
    with pytest.raises(SystemExit):
        jobs.main(["trades", "--frames", "a", "--root", "b"])


def test_alert_messages(spark):
    bars = spark.createDataFrame([(1, "XA", "A", 100.0, 150.0, 5)], "ingest_seq long, event_type string, pair string, open double, close double, timestamp long")
    row = publish.alert_messages(alerts(price_action(bars, 1.0, scope="bar"))).first()
    assert row.key == "A"
    value = json.loads(row.value)
    assert (value["kind"], value["pct"], value["last"], value["close"]) == ("spike", 50.0, 100.0, 150.0)


def test_alerts_are_passed_on(spark, tmp_path):
    from ticktape.sources import frames as frame_sources
    from ticktape.streaming import trades

    frames = _land(tmp_path, [MINUTE.replace('"c":101.5', f'"c":{c}') for c in (101.5, 50, 50.1)])
    (tmp_path / "landed" / "quiet.txt").write_text(MINUTE.replace('"c":101.5', '"c":50.1'))
    sent = []
    landed = frame_sources.stream_text_frames(spark, frames, max_files=1)
    stream = trades.persist_alerts(
        landed, str(tmp_path / "root"), str(tmp_path / "checkpoint"), 1.0, also=lambda found: sent.append(publish.alert_messages(found).collect())
    )
    stream.trigger(availableNow=True).start().awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "root" / "alerts"))
    assert len(sent) == 2 and sum(map(len, sent)) == stored.count() >= 2
    assert {json.loads(m.value)["close"] for batch in sent for m in batch} == {r["close"] for r in stored.collect()}


def test_alerts_topic_needs_servers():
    with pytest.raises(SystemExit):
        jobs.main(["alerts", "--frames", "a", "--root", "b", "--checkpoint", "c", "--alerts-topic", "t"])
