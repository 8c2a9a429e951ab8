"""The price tracker against its worked example and a plain loop, in every bucketing."""

import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from ticktape.operators import price_action as price_actions
from ticktape.operators.price_action import Arrival, alerts, arrival_of, last_prices, price_action

DDL = "ingest_seq long, pos int, event_type string, pair string, open double, close double, timestamp long, end_time long"
INF = float("inf")

EXAMPLE = [("A", 10, 11), ("A", 11.5, 11), ("B", 5, 4), ("A", 9, 12), ("C", 0, 0), ("C", 0, 1)]


def _bars(spark, rows):
    data = [(i, 0, "XA" if i % 2 else "XAS", p, float(o), float(c), 60_000 * i, 60_000 * (i + 1)) for i, (p, o, c) in enumerate(rows)]
    return spark.createDataFrame(data, DDL).repartition(4)


def _track(rows, threshold, carried=()):
    """The tracker as a loop."""
    last, out = dict(carried), []
    for pair, o, c in rows:
        o, c = float(o), float(c)
        before = last.get(pair, o)
        change = c - before
        if before == 0.0:
            sign = math.copysign(1.0, before)
            ratio = math.nan if change == 0 or math.isnan(change) else math.copysign(INF, change) * sign
        else:
            ratio = change / before
        pct = ratio * 100.0
        direction = "up" if c > before else "down" if c < before else "same"
        kind = ("spike" if pct > 0 else "drop") if abs(pct) > threshold else None
        out.append((before, direction, pct, kind))
        last[pair] = c
    return out, last


def _rows(df):
    return [(r["last"], r["direction"], r["pct"], r["kind"]) for r in df.orderBy("ingest_seq", "pos").collect()]


def _same(a, b):
    return repr(a) == repr(b)


def test_worked_example(spark):
    got = _rows(price_action(_bars(spark, EXAMPLE), 1.0))
    assert [(g[0], g[1], g[3]) for g in got] == [
        (10.0, "up", "spike"), (11.0, "same", None), (5.0, "down", "drop"), (11.0, "up", "spike"), (0.0, "same", None),
        (0.0, "up", "spike"),
    ]
    assert math.isnan(got[4][2]) and got[5][2] == INF
    assert abs(got[0][2] - 10) < 1e-9 and abs(got[3][2] - 100 / 11) < 1e-9
    per_bar = _rows(price_action(_bars(spark, EXAMPLE), 1.0, scope="bar"))
    assert [(g[0], g[1], g[3]) for g in per_bar] == [
        (10.0, "up", "spike"), (11.5, "down", "drop"), (5.0, "down", "drop"), (9.0, "up", "spike"), (0.0, "same", None),
        (0.0, "up", "spike"),
    ]


@pytest.mark.parametrize("bits", [0, 2, 5, 20])
def test_random_bars_against_a_loop(spark, bits):
    rng = random.Random(bits)
    prices = [0.0, -0.0, 1.0, 1.000001, -2.0, 10.0, 1e308, 5e-324, 100.0]
    pairs = ["HOT"] * 5 + ["A", "B", "C"]
    rows = [(rng.choice(pairs), rng.choice(prices), rng.choice(prices)) for _ in range(600)]
    expected, last = _track(rows, 1.0)
    bars = _bars(spark, rows)
    arrival = arrival_of(bars, bucket_bits=bits)
    assert _same(_rows(price_action(bars, 1.0, arrival=arrival)), expected)
    assert {r["pair"]: r["last"] for r in last_prices(bars, arrival).collect()} == last


def test_carried_prices_continue_a_run(spark):
    rows = [("A", 1, 2), ("B", 3, 4), ("A", 9, 3), ("C", 1, 1)]
    carried = spark.createDataFrame([("A", 10.0), ("Z", 7.0)], "pair string, last double")
    expected, last = _track(rows, 1.0, {"A": 10.0, "Z": 7.0}.items())
    bars = _bars(spark, rows)
    for bits in (0, 20):
        arrival = arrival_of(bars, bucket_bits=bits)
        assert _same(_rows(price_action(bars, 1.0, arrival=arrival, carried=carried)), expected)
        assert {r["pair"]: r["last"] for r in last_prices(bars, arrival, carried).collect()} == last


def test_position_in_frame_and_source_order(spark):
    data = [(5, 1, "f1", 3.0), (5, 0, "f1", 2.0), (9, 0, "f0", 1.0), (4, 2, "f1", 9.0)]
    bars = spark.createDataFrame(
        [(s, p, src, "XA", "A", 100.0, c, 0, 0) for s, p, src, c in data],
        "ingest_seq long, pos int, ingest_src string, event_type string, pair string, open double, close double, timestamp long, end_time long",
    )
    got = {(r.ingest_src, r.ingest_seq, r.pos): r["last"] for r in price_action(bars, 1.0).collect()}
    assert got == {("f0", 9, 0): 100.0, ("f1", 4, 2): 1.0, ("f1", 5, 0): 9.0, ("f1", 5, 1): 2.0}


def test_order_by_bar_time_without_arrival_columns(spark):
    rows = [("A", i, i + 1) for i in range(50)]
    bars = _bars(spark, rows).drop("ingest_seq", "pos")
    own = Arrival((F.floor(F.col("end_time") / 600_000),), (F.col("end_time"), F.col("timestamp")))
    for arrival in (None, own):
        got = price_action(bars, 1.0, arrival=arrival).orderBy("end_time").collect()
        assert [r["last"] for r in got] == [0.0] + [float(i) for i in range(1, 50)]


def test_alerts(spark):
    rows = alerts(price_action(_bars(spark, EXAMPLE), 1.0)).orderBy("ingest_seq").collect()
    assert [(r.pair, r.kind) for r in rows] == [("A", "spike"), ("B", "drop"), ("A", "spike"), ("C", "spike")]
    assert rows[1].message == "B drop -20.00%: 5.0 -> 4.0"


def test_threshold_is_strict_and_scope_is_checked(spark):
    bars = _bars(spark, [("A", 100, 101)])
    assert alerts(price_action(bars, 1.0)).count() == 0
    assert alerts(price_action(bars, 0.999)).count() == 1
    with pytest.raises(ValueError):
        price_action(bars, 1.0, scope="day")


def test_plan_splits_pairs_and_reads_the_source_once(spark, tmp_path):
    _bars(spark, EXAMPLE * 50).write.parquet(str(tmp_path / "bars"))
    bars = spark.read.parquet(str(tmp_path / "bars"))
    measured = price_action(bars, 1.0, arrival=arrival_of(bars, bucket_bits=5))
    assert "Python" not in plan_of(measured) and "hashpartitioning(pair" in plan_of(measured)
    measured.collect()
    final = plan_of(measured).split("+- == Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final
    few = alerts(measured).select("pair", "kind")  # pruning must not part the two sides
    few.collect()
    final = plan_of(few).split("+- == Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final
    assert "Exchange" not in plan_of(price_action(spark.range(1).selectExpr("0D open", "1D close"), 1.0, scope="bar"))


@pytest.mark.parametrize("shape", ["sparse", "files"])
def test_buckets_follow_rows_and_not_their_numbers(spark, shape):
    """200,000 bars of one pair, their numbers far apart or each from a file of its own."""
    bars = spark.range(0, 200_000).selectExpr(
        "0 AS pos", "'XAS' AS event_type", "'HOT' AS pair", "CAST(id % 1000 AS DOUBLE) AS open", "CAST((id * 7) % 1000 AS DOUBLE) AS close",
        "id AS timestamp", "id AS end_time",
        *(["id * 200000 AS ingest_seq"] if shape == "sparse" else ["format_string('f%020d#0', id) AS ingest_src", "0L AS ingest_seq"]),
    )
    arrival = arrival_of(bars)
    sizes = [r["count"] for r in bars.groupBy("pair", *arrival.bucket).count().collect()]
    assert len(sizes) == 2 and max(sizes) <= 1 << 17  # two closes travel, not 200,000


def test_bounds_take_one_reading_of_the_source(spark, tmp_path):
    """Every row is read once while the bounds are cut."""
    spark.range(0, 50_000, 1, 4).selectExpr("id AS ingest_seq", "id % 7 AS x").write.parquet(str(tmp_path / "rows"))
    read = spark.sparkContext.accumulator(0)
    rows = spark.read.parquet(str(tmp_path / "rows"))

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    arrival = arrival_of(rows.mapInArrow(counted, "ingest_seq long, x long"), bucket_bits=10)
    assert read.value == 50_000
    sizes = [r["count"] for r in rows.groupBy(*arrival.bucket).count().collect()]
    assert len(sizes) == 64 and max(sizes) <= 1 << 10


@pytest.mark.parametrize("numbers", ["id", "id * id", "id - 9000000000000000000", "id DIV 3", "0"])
def test_a_second_level_of_buckets_keeps_the_order(spark, numbers, monkeypatch):
    monkeypatch.setattr(price_actions, "_MOST_QUANTILES", 8)
    bars = spark.range(0, 20_000).selectExpr(f"{numbers} AS ingest_seq", "CAST(id AS INT) AS pos")
    arrival = arrival_of(bars, bucket_bits=6)
    assert len(arrival.bucket) == 2
    placed = bars.groupBy(*[b.alias(f"b{i}") for i, b in enumerate(arrival.bucket)]).agg(
        F.min("ingest_seq").alias("low"), F.max("ingest_seq").alias("high"), F.count("*").alias("n")
    ).orderBy("b0", "b1").collect()
    assert all(a.high < b.low for a, b in zip(placed, placed[1:]))
    if numbers != "0":
        assert len(placed) > 40
    if numbers in ("id", "id - 9000000000000000000"):
        assert max(r.n for r in placed) <= 2 << 6


def test_a_hot_pair_is_spread_over_buckets(spark):
    bars = spark.range(0, 400_000).selectExpr(
        "id AS ingest_seq", "0 AS pos", "'XAS' AS event_type",
        "CASE WHEN id % 3 = 0 THEN concat('P', id % 997) ELSE 'HOT' END AS pair",
        "CAST(id % 1000 AS DOUBLE) AS open", "CAST((id * 7) % 1000 AS DOUBLE) AS close", "id AS timestamp", "id AS end_time",
    )
    arrival = arrival_of(bars, bucket_bits=14)
    split = price_action(bars, 1.0, arrival=arrival)
    whole = price_action(bars, 1.0, arrival=Arrival((F.lit(0),), (F.col("ingest_seq"),)))
    digest = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    assert digest(split) == digest(whole)
    biggest = bars.groupBy("pair", *arrival.bucket).count().agg(F.max("count")).first()[0]
    assert biggest <= 1 << 14
