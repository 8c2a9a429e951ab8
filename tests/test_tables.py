"""Tables, rejects of bad rows, staged writes, the end-to-end batch flow and its restart."""

import datetime

import pytest
from pyspark.sql import functions as F
from conftest import plan_of
from test_decode import BOOK, MINUTE, QUOTE, SECOND, TRADE

from ticktape import schemas as S
from ticktape.operators import decode, filters
from ticktape.plans import market, registry
from ticktape.sinks import tables
from ticktape.sources import frames as frame_sources


def _frames(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "ingest_seq bigint, frame string")


def test_every_family_round_trips(spark, tmp_path):
    decoded = decode.decode(_frames(spark, [f"[{TRADE},{QUOTE},{MINUTE}]", SECOND, BOOK]))
    for name, family in S.FAMILIES.items():
        events = decoded.family(name)
        tables.write_table(events, family, str(tmp_path))
        back = tables.read_table(spark, family, str(tmp_path))
        assert sorted(map(repr, back.select(*events.columns).collect())) == sorted(map(repr, events.collect()))
        assert {f.name: f.dataType for f in back.select(*family.columns).schema} == {
            f.name: f.dataType for f in family.table_schema
        }


def test_append_keeps_every_copy(spark, tmp_path):
    trades = decode.decode(_frames(spark, [TRADE, TRADE])).trades
    for _ in range(2):
        tables.write_table(trades, S.TRADE, str(tmp_path))
    assert tables.read_table(spark, S.TRADE, str(tmp_path)).count() == 4


def test_conditions_modes(spark):
    trades = decode.decode(_frames(spark, [TRADE])).trades
    assert tables.table_rows(trades, S.TRADE).first().conditions == [1]
    as_run = tables.table_rows(trades, S.TRADE, "as_run").first()
    assert as_run.conditions == [] and as_run.event_type == "XT" and as_run.price == 45000.5
    with pytest.raises(ValueError):
        tables.table_rows(trades, S.TRADE, "other")


def test_a_missing_required_value_is_an_error(spark):
    trades = decode.decode(_frames(spark, [TRADE])).trades
    bad = trades.withColumn("price", F.lit(None).cast("double"))
    with pytest.raises(Exception, match="trade.price must not be null"):
        tables.table_rows(bad, S.TRADE).collect()
    no_id = trades.withColumn("trade_id", F.lit(None).cast("string"))
    assert tables.table_rows(no_id, S.TRADE).first().trade_id is None


def test_event_date_is_utc_and_never_fails(spark):
    values = [0, -1, 1704067199999, 1704067200000, 2**63 - 1, -(2**63), 253402300799999, 253402300800000, -62135596800000]
    df = spark.createDataFrame([(v,) for v in values], "timestamp long")
    got = [r.d for r in df.select(tables.event_date(F.col("timestamp")).alias("d")).collect()]
    day = datetime.date
    assert got == [day(1970, 1, 1), day(1969, 12, 31), day(2023, 12, 31), day(2024, 1, 1), None, None,
                   day(9999, 12, 31), None, day(1, 1, 1)]


def test_database_rows(spark):
    row = tables.database_rows(decode.decode(_frames(spark, [BOOK])).books, S.BOOK).first()
    assert row.asDict() == {
        "event_type": "XL2", "pair": "BTC-USD", "timestamp": 1, "received_timestamp": 2, "exchange_id": 1,
        "bid_prices": "[[45000.0,1.0],[44999.5,2.0]]", "ask_prices": "[[45001.0,0.5]]",
    }


def test_batch_flow(spark, tmp_path):
    root = str(tmp_path)
    small = TRADE.replace('"s":0.5', '"s":0.1')
    doge = TRADE.replace("BTC-USD", "DOGE-USD")
    later = MINUTE.replace('"o":100.0,"c":101.5', '"o":50.0,"c":101.5')
    chosen = {"default": filters.parameterized(), "gate": filters.EventFilter(S.TRADE, filters.size_gate())}
    texts = [TRADE, f"[{small},{doge}]", MINUTE, SECOND, later, QUOTE, "oops"]
    market.run_batch(_frames(spark, texts), root, chosen, threshold=1.0)
    stored = tables.read_table(spark, S.TRADE, root).select("ingest_seq", "pos", "filter_id").collect()
    assert sorted(map(tuple, stored)) == [(0, 0, "default"), (0, 0, "gate"), (1, 0, "gate")]
    raised = spark.read.parquet(f"{root}/alerts").select("ingest_seq", "kind", "last", "close").collect()
    assert sorted(map(tuple, raised)) == [(2, "spike", 100.0, 101.5)]
    kinds = spark.read.parquet(f"{root}/staged").groupBy("family").count().collect()
    assert dict(map(tuple, kinds)) == {"trade": 3, "bar": 3, "reject": 1}  # no one here reads quotes
    assert [r.reason for r in spark.read.parquet(f"{root}/rejects").collect()] == ["bad_json"]


def test_staged_reads_are_pruned_and_pushed_down(spark, tmp_path):
    path = str(tmp_path / "staged")
    tables.write_staged(decode.stage_events(_frames(spark, [TRADE, QUOTE, MINUTE])), path)
    trades = decode.staged_family(spark.read.parquet(path), S.TRADE)
    plan = plan_of(trades.where(filters.criteria_predicate()).select("price"))
    assert "family#" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert "GreaterThan(trade.size,0.3)" in plan
    read = plan.split("ReadSchema:")[1]
    assert "trade:struct<" in read and "quote" not in read and "exchange_id" not in read


def test_a_null_frame_is_a_reject(spark):
    frames = spark.createDataFrame([(1, None)], "ingest_seq bigint, frame string")
    assert [r.reason for r in decode.decode(frames).rejects.collect()] == ["bad_json"]


def test_text_frames_keep_file_and_line_order(spark, tmp_path):
    landed = tmp_path / "landed"
    landed.mkdir()
    closes = list(range(1, 31))
    for n in range(3):
        lines = [MINUTE.replace('"c":101.5', f'"c":{c}.0') for c in closes[n * 10 : n * 10 + 10]]
        (landed / f"part-{n}.txt").write_text("\n".join(lines))
        import os

        os.utime(landed / f"part-{n}.txt", (1_700_000_000 + n, 1_700_000_000 + n))
    bars = market.bars_of(frame_sources.read_text_frames(spark, str(landed)))
    from ticktape.operators.price_action import price_action

    got = {r.close: r["last"] for r in price_action(bars, 1.0).collect()}
    assert got == {float(c): float(c - 1) if c > 1 else 100.0 for c in closes}


def test_kafka_records(spark):
    at = datetime.datetime(2024, 1, 1)
    raw = spark.createDataFrame([(bytearray(b"[]"), "t", 3, 41, at)], "value binary, topic string, partition int, offset long, timestamp timestamp")
    assert frame_sources.kafka_records(raw).first().asDict() == {
        "frame": "[]", "ingest_ts": at, "ingest_src": "t#0000000003", "ingest_seq": 41,
    }


def test_records_of_a_pair_in_two_partitions_are_ordered_by_time(spark):
    from ticktape.operators.price_action import price_action

    rows = []
    for i, close in enumerate([110.0, 121.0, 133.0, 146.0]):
        frame = MINUTE.replace('"c":101.5', f'"c":{close}')
        rows.append((bytearray(frame.encode()), "t", 1 - i % 2, i // 2, datetime.datetime(2024, 1, 1, 0, 0, i)))
    raw = spark.createDataFrame(rows, "value binary, topic string, partition int, offset long, timestamp timestamp")
    bars = market.bars_of(frame_sources.kafka_records(raw))
    assert {r.close: r["last"] for r in price_action(bars, 1.0).collect()} == {110.0: 100.0, 121.0: 110.0, 133.0: 121.0, 146.0: 133.0}


def test_staging_sorts_no_rows_by_family(spark, tmp_path, monkeypatch):
    """A sort would hold all rows of a task; while a file per family may stay open, Spark plans none."""
    option, written, append = "spark.sql.maxConcurrentOutputFileWriters", [], tables.append
    before = spark.conf.get(option)

    def noted(*a, **k):
        written.append(int(spark.conf.get(option)))
        append(*a, **k)

    monkeypatch.setattr(tables, "append", noted)
    path = str(tmp_path / "staged")
    tables.write_staged(decode.stage_events(_frames(spark, [TRADE, QUOTE, MINUTE, "oops"] * 3).coalesce(1)), path)
    assert written and written[0] > len(S.FAMILIES) + 1 and spark.conf.get(option) == before
    kinds = spark.read.parquet(path).groupBy("family").count().collect()
    assert dict(map(tuple, kinds)) == {"trade": 3, "quote": 3, "bar": 3, "reject": 3}


def test_matches_for_several_jobs_are_decoded_once(spark, sf_dir, monkeypatch):
    plans, write = [], tables.write_table

    def noted(events, *a, **k):
        plans.append(events._jdf.queryExecution().optimizedPlan().toString())
        write(events, *a, **k)

    monkeypatch.setattr(tables, "write_table", noted)
    registry.queries()["persist_half_written"](spark, sf_dir)
    assert len(plans) == 5 and not any("from_json" in p or "generate" in p.lower() for p in plans)
