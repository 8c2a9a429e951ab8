"""Per-pair criteria (compiled and joined), the fixed filters and the fan-out."""

import operator

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from ticktape import schemas as S
from ticktape.operators import filters, topics
from ticktape.sources import filter_config

NAN, INF = float("nan"), float("inf")
TRADE_DDL = "event_type string, pair string, price double, size double, ingest_seq bigint"


def _trades(spark, rows):
    return spark.createDataFrame([("XT", p, float(pr), float(s), i) for i, (p, pr, s) in enumerate(rows)], TRADE_DDL)


def _kept(df):
    return sorted(r.ingest_seq for r in df.select("ingest_seq").collect())


def _number(field, operation, value):
    return {"field": field, "operation": operation, "value": {"Number": value}}


def _text(field, operation, value):
    return {"field": field, "operation": operation, "value": {"Text": value}}


def _every_way(spark, trades, config):
    """The kept rows of the compiled, the broadcast, the shuffled and the salted form."""
    table = filters.criteria_table(spark, config)
    return [
        _kept(trades.where(filters.criteria_predicate(config))),
        _kept(filters.filter_events(trades, filters.table_filter(table))),
        _kept(filters.filter_events(trades, filters.table_filter(table, max_broadcast_bytes=0))),
        _kept(filters.filter_events(trades, filters.table_filter(table, max_broadcast_bytes=0, salts=4))),
    ]


def test_default_config(spark):
    rows = [("BTC-USD", 1, 0.3), ("BTC-USD", 1, 0.31), ("ETH-USD", 1, 2.0), ("ETH-USD", 1, 2.5), ("DOGE-USD", 1, 0.0),
            ("LINK-USD", 1, 2.0), ("LINK-USD", 1, 2.1), ("btc-usd", 1, 0.0), ("BTC-USD", 1, NAN), ("BTC-USD", 1, INF)]
    for kept in _every_way(spark, _trades(spark, rows), filters.DEFAULT_CRITERIA):
        assert kept == [1, 3, 4, 6, 7, 9]


CRITERIA = [
    ([], True),
    ([_number("price", "=", 0.3)], True),
    ([_number("price", "=", 0.31)], False),
    ([_number("price", ">=", 0.1)], False),
    ([_number("price", "!=", 9.0)], False),
    ([_number("price", "<", 0.4)], True),
    ([_number("pair", ">", 0.0)], False),
    ([_number("exchange_id", ">", 0.0)], False),
    ([_text("price", "=", "0.3")], False),
    ([_text("pair", "=", "P9")], True),
    ([_text("pair", "=", "p10")], False),
    ([_text("pair", "!=", "B")], True),
    ([_text("pair", "!=", "P12")], False),
    ([_text("pair", ">", "0")], False),
    ([_number("price", ">", 0.1), _number("size", ">", 5.0)], False),
    ([_number("price", ">", 0.1), _number("size", ">", 4.0)], True),
]


def test_criteria(spark):
    """One pair per case."""
    trades = _trades(spark, [(f"P{i}", 0.1 + 0.2, 5.0) for i in range(len(CRITERIA))])
    config = {f"P{i}": criteria for i, (criteria, _) in enumerate(CRITERIA)}
    for kept in _every_way(spark, trades, config):
        assert kept == [i for i, (_, keeps) in enumerate(CRITERIA) if keeps]


def test_comparisons_follow_ieee(spark):
    """One pair per operation and limit."""
    values = [0.0, -0.0, 1.0, -1.0, 0.3, 0.1 + 0.2, 1.0 + 2**-52, 1e300, INF, -INF, NAN, 5e-324, 2**-53]
    equal = lambda a, b: abs(a - b) < 2.220446049250313e-16
    config, rows, expected = {}, [], []
    for name, compare in ((">", operator.gt), ("<", operator.lt), ("=", equal)):
        for limit in (0.0, -0.0, 0.3, 1.0, 1e300):
            pair = f"{name}{limit}"
            config[pair] = [_number("price", name, limit)]
            expected += [len(rows) + i for i, v in enumerate(values) if compare(v, limit)]
            rows += [(pair, v, 1.0) for v in values]
    for kept in _every_way(spark, _trades(spark, rows), config):
        assert kept == expected


def test_the_form_of_a_filter_goes_by_the_size_of_its_config(spark):
    rows = [(f"P{i % 50}", i, i % 7) for i in range(2000)]
    config = {f"P{i}": [_number("size", ">", float(i % 5))] for i in range(40)}
    expected = [i for i, (p, _, s) in enumerate(rows) if p not in config or s > config[p][0]["value"]["Number"]]
    trades, table = _trades(spark, rows), filters.criteria_table(spark, config)
    compiled = filters.filter_events(trades, filters.configured(table))
    joined = filters.filter_events(trades, filters.configured(table, max_compiled=10))
    salted = filters.filter_events(trades, filters.configured(table, max_compiled=10, max_broadcast_bytes=10))
    assert "Join" not in plan_of(compiled)
    assert "BroadcastHashJoin" in plan_of(joined)
    for df in (compiled, joined, salted):
        assert _kept(df) == expected


def _hot_trades(spark):
    hot = F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("P"), (F.col("id") % 500).cast("string")))
    return spark.range(0, 60_000, 1, 12).select(
        hot.alias("pair"), F.lit("XT").alias("event_type"), F.lit(1.0).alias("price"),
        F.col("id").cast("double").alias("size"), F.col("id").alias("ingest_seq"),
    )


def test_a_hot_pair_is_spread_over_salts(spark):
    trades = _hot_trades(spark)
    config = filters.criteria_table(spark, {"HOT": [_number("size", ">", 100.0)]})
    salted = filters.filter_events(trades, filters.table_filter(config, max_broadcast_bytes=0, salts=16))
    assert salted.count() == trades.where("pair <> 'HOT' OR size > 100").count()
    from ticktape.operators.lookup import _salt

    per_salt = trades.where("pair = 'HOT'").groupBy(_salt(trades, 16).alias("s")).count().collect()
    assert len(per_salt) == 16 and max(r["count"] for r in per_salt) < 2 * 20_000 / 16


def test_a_hot_pair_is_split_by_adaptive_execution(spark):
    trades = _hot_trades(spark)
    config = filters.criteria_table(spark, {"HOT": [_number("size", ">", 100.0)]})
    limits = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    try:
        for key, value in limits.items():
            spark.conf.set(key, value)
        kept = filters.filter_events(trades, filters.table_filter(config, max_broadcast_bytes=0))
        rows = kept.collect()
        plan = plan_of(kept)
    finally:
        for key in limits:
            spark.conf.unset(key)
    assert "SortMergeJoin(skew=true)" in plan
    assert sorted(r.ingest_seq for r in rows) == _kept(trades.where("pair <> 'HOT' OR size > 100"))


def test_salts_step_in_without_adaptive_execution(spark):
    from ticktape.operators.lookup import splits_skew

    trades = _trades(spark, [("A", 1, 1.0)])
    assert splits_skew(trades)
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        config = filters.criteria_table(spark, {"A": [_number("size", ">", 2.0)]})
        kept = filters.filter_events(trades, filters.table_filter(config, max_broadcast_bytes=0))
        assert "_salt" in plan_of(kept) and kept.count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.skewJoin.enabled")


def test_price_movement(spark):
    rows = [("XA", 100, 101), ("XA", 100, 98), ("XA", 0, 1), ("XA", 0, 0), ("XA", -100, 100), ("XAS", 100, 150),
            ("XA", -0.0, 1), ("XA", 100, NAN), ("XA", 100, 102), ("XA", 0, -1)]
    bars = spark.createDataFrame([(i, e, float(o), float(c)) for i, (e, o, c) in enumerate(rows)],
                                 "ingest_seq long, event_type string, open double, close double")
    assert _kept(bars.where(filters.price_movement(1.0))) == [1, 2, 8, 9]


def test_size_gate(spark):
    rows = [("A", 1, 0.005), ("A", 1, 0.0051), ("B", 1, 1.0), ("B", 1, NAN), ("B", 1, INF)]
    assert _kept(_trades(spark, rows).where(filters.size_gate())) == [1, 2, 4]


def test_fan_out_is_a_bag(spark):
    rows = [("BTC-USD", 1, 0.5), ("BTC-USD", 1, 0.1), ("BTC-USD", 1, 0.001), ("DOGE-USD", 1, 0.0), ("BTC-USD", 1, 0.5)]
    chosen = {"f1": filters.parameterized(), "f2": filters.EventFilter(S.TRADE, filters.size_gate())}
    out = filters.fan_out(_trades(spark, rows), chosen, S.TRADE)
    got = sorted((r.ingest_seq, r.filter_id) for r in out.collect())
    assert got == [(0, "f1"), (0, "f2"), (1, "f2"), (3, "f1"), (4, "f1"), (4, "f2")]
    assert filters.fan_out(_trades(spark, rows), {}, S.TRADE).count() == 0
    assert filters.apply_filters({"trade": _trades(spark, rows)}, {}) == {}


def test_config_tables_in_a_fan_out(spark):
    trades = _trades(spark, [("A", 1, 0.5), ("A", 1, 2.0), ("B", 1, 0.5)])
    one = filters.criteria_table(spark, {"A": [_number("size", ">", 1.0)]})
    two = filters.criteria_table(spark, {"A": [_number("size", "<", 1.0)], "B": [_text("pair", "!=", "B")]})
    chosen = {"one": filters.table_filter(one), "two": filters.table_filter(two, max_broadcast_bytes=0, salts=2)}
    out = filters.fan_out(trades, chosen, S.TRADE)
    assert out.columns == [*trades.columns, "filter_id"]
    assert sorted((r.ingest_seq, r.filter_id) for r in out.collect()) == [(0, "two"), (1, "one"), (2, "one")]


def test_a_python_predicate_is_accepted(spark):
    @F.pandas_udf("boolean")
    def odd(seq: pd.Series) -> pd.Series:
        return seq % 2 == 1

    chosen = {
        "odd": filters.EventFilter(S.TRADE, lambda: odd(F.col("ingest_seq")), python=True),
        "gate": filters.EventFilter(S.TRADE, filters.size_gate()),
    }
    out = filters.fan_out(_trades(spark, [("A", 1, 1.0), ("A", 1, 0.0), ("A", 1, 2.0)]), chosen, S.TRADE)
    assert sorted((r.ingest_seq, r.filter_id) for r in out.collect()) == [(0, "gate"), (1, "odd"), (2, "gate")]


def test_filters_push_down_and_do_not_shuffle(spark, tmp_path):
    path = str(tmp_path / "trades")
    _trades(spark, [("BTC-USD", 1, 0.5)]).write.parquet(path)
    trades = spark.read.parquet(path)
    plan = plan_of(trades.where(filters.criteria_predicate()).select("price"))
    assert "Exchange" not in plan and "Python" not in plan
    pushed = plan.split("PushedFilters:")[1]
    assert "GreaterThan(size,0.3)" in pushed and "Not(In(pair" in pushed
    assert "event_type" not in plan.split("ReadSchema:")[1]
    fan = plan_of(filters.fan_out(trades, {"a": filters.EventFilter(S.TRADE, filters.size_gate(2.0))}, S.TRADE))
    assert "Exchange" not in fan and "GreaterThan(size,2.0)" in fan
    topic = plan_of(topics.topic_filter(trades, ["XT.BTC-USD", "XA.*"]))
    assert "EqualTo(event_type,XT)" in topic and "EqualTo(pair,BTC-USD)" in topic


def test_config_round_trip_and_checks(spark, tmp_path):
    path = str(tmp_path / "config")
    filter_config.save_filter_config(filters.criteria_table(spark, filters.DEFAULT_CRITERIA), path)
    loaded = filters.collect_criteria(filter_config.load_filter_config(spark, path))
    plain = {p: [{"field": c["field"], "operation": c["operation"], "value": {"Number": c["value"]["Number"]}} for c in cs]
             for p, cs in loaded.items()}
    assert plain == filters.DEFAULT_CRITERIA

    def load(name, *lines):
        file = tmp_path / f"{name}.json"
        file.write_text("\n".join(lines))
        return filter_config.load_filter_config(spark, str(file))

    good = '{"pair":"A","criteria":[{"field":"size","operation":">","value":{"Number":1}}]}'
    assert load("good", good).count() == 1
    assert load("empty", '{"pair":"A","criteria":[]}').count() == 1
    for name, lines in {
        "twice": [good, good],
        "no_value": ['{"pair":"A","criteria":[{"field":"size","operation":">","value":{"Other":1}}]}'],
        "two_values": ['{"pair":"A","criteria":[{"field":"pair","operation":"=","value":{"Number":1,"Text":"x"}}]}'],
        "no_pair": ['{"criteria":[]}'],
        "no_field": ['{"pair":"A","criteria":[{"operation":">","value":{"Number":1}}]}'],
    }.items():
        with pytest.raises(filter_config.FilterConfigError):
            load(name, *lines)


def test_topics(spark):
    rows = [("XT", "BTC-USD"), ("XA", "BTC-USD"), ("XAS", "BTC-USD"), ("XT", "SOL-USD"), ("XQ", "A.B"), ("XL2", "C")]
    events = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ingest_seq long, event_type string, pair string")
    cases = {
        ("XT.BTC-USD",): [0],
        ("XA.*",): [1],
        ("XAS.*", "XT.*"): [0, 2, 3],
        ("XT.*", "XT.BTC-USD"): [0, 3],
        ("XQ.A.B", "XL2.D"): [4],
        (): [],
    }
    for wanted, kept in cases.items():
        assert _kept(topics.topic_filter(events, wanted)) == kept
        table = spark.createDataFrame([(t,) for t in wanted] * 2, "topic string")
        assert _kept(topics.topic_join(events, table)) == kept
        assert _kept(topics.topic_join(events, table, max_broadcast_bytes=0, salts=3)) == kept
    assert topics.channel_topics(minute_bars=True, books=True) == ["XA.*", "XL2.*"]
    assert topics.channel_topics(True, True, True, True, True) == ["XA.*", "XAS.*", "XT.*", "XQ.*", "XL2.*"]
    with pytest.raises(ValueError):
        topics.topic_predicate(["XT"])


def test_a_pair_named_twice_is_an_error_in_every_form(spark):
    from ticktape.sources.filter_config import FilterConfigError

    one = filters.criteria_table(spark, filters.DEFAULT_CRITERIA)
    twice = one.unionByName(one.limit(1))
    forms = [
        lambda c: filters.configured(c), lambda c: filters.configured(c, max_compiled=0),
        lambda c: filters.configured(c, max_compiled=0, max_broadcast_bytes=0), lambda c: filters.table_filter(c),
        lambda c: filters.table_filter(c, max_broadcast_bytes=0), lambda c: filters.table_filter(c, max_broadcast_bytes=0, salts=4),
    ]
    for form in forms:
        form(one)
        with pytest.raises(FilterConfigError):
            form(twice)


def test_topic_tables_are_strict_and_read_the_events_once(spark, tmp_path):
    from conftest import plan_of
    from ticktape.operators import topics

    events = spark.createDataFrame([("XT", "A"), ("XA", "A"), ("XA", "B"), ("XQ", "*")], "event_type string, pair string")
    events.write.parquet(str(tmp_path / "events"))
    events = spark.read.parquet(str(tmp_path / "events"))
    wanted = lambda *names: spark.createDataFrame([(n,) for n in names], "topic string")
    for names in (["XA.*", "XT.A"], ["XA.B"], ["XT.*"], ["XA.*", "XA.A", "XZ.*"]):
        joined = topics.topic_join(events, wanted(*names))
        assert plan_of(joined).count("FileScan parquet [event_type") == 1
        assert sorted(joined.collect()) == sorted(topics.topic_filter(events, names).collect())
    with pytest.raises(Exception, match="topic XA is not CHANNEL.PAIR"):
        topics.topic_join(events, wanted("XA", "XT.A"))
