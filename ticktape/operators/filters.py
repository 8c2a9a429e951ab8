"""User filters over typed events, and the fan-out that applies several of them in one scan.

A filter is a boolean column over one event family.  Each filter looks at the unfiltered events: an event
that passes k filters comes out k times, each copy tagged with the filter's id.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticktape import schemas as S
from ticktape.functions import floats as N
from ticktape.operators.lookup import MAX_BROADCAST_BYTES, lookup_join
from ticktape.sources.filter_config import FilterConfigError

if TYPE_CHECKING:
    from ticktape.operators.filter_index import FilterIndex

# The filter configuration used when none is given, and the size gate's limit.
DEFAULT_CRITERIA = {
    "BTC-USD": [{"field": "size", "operation": ">", "value": {"Number": 0.3}}],
    "ETH-USD": [{"field": "size", "operation": ">", "value": {"Number": 2.0}}],
    "LINK-USD": [{"field": "size", "operation": ">", "value": {"Number": 2.0}}],
}
DEFAULT_SIZE_GATE = 0.005
NUMBER_FIELDS = ("price", "size")
TEXT_FIELDS = ("pair",)
# End of fixed values.

MAX_COMPILED_CRITERIA = 200


@dataclass(frozen=True)
class EventFilter:
    """A filter as applied: the family it reads and its predicate (a column, or a callable giving one).

    ``prepare`` may add columns the predicate needs.  Set ``python`` for a predicate that calls a Python
    function, so that it is evaluated only once.
    """

    family: S.Family
    predicate: Column | Callable[[], Column]
    prepare: Callable[[DataFrame], DataFrame] | None = None
    python: bool = False

    def column(self) -> Column:
        return self.predicate if isinstance(self.predicate, Column) else self.predicate()


# --- per-pair criteria, compiled into an expression -------------------------------------------------


def criterion_predicate(criterion: Mapping) -> Column:
    """One ``{field, operation, value}``; a combination that makes no sense is never met."""
    field, operation, value = criterion["field"], criterion["operation"], criterion["value"]
    if value.get("Number") is not None and field in NUMBER_FIELDS:
        number = float(value["Number"])
        if operation == ">":
            return N.gt_value(F.col(field), number)
        if operation == "<":
            return N.lt_value(F.col(field), number)
        if operation == "=":
            return N.close_to_value(F.col(field), number)
    if value.get("Text") is not None and field in TEXT_FIELDS:
        if operation == "=":
            return F.col(field) == F.lit(value["Text"])
        if operation == "!=":
            return F.col(field) != F.lit(value["Text"])
    return F.lit(False)


def criteria_predicate(criteria_by_pair: Mapping[str, Sequence[Mapping]] = DEFAULT_CRITERIA) -> Column:
    """All criteria of the trade's pair are met; a pair without an entry passes.

    Written as a disjunction over pairs, so that it reaches a Parquet scan.
    """
    if not criteria_by_pair:
        return F.lit(True)
    passes = ~F.col("pair").isin(*criteria_by_pair)
    for pair, criteria in criteria_by_pair.items():
        of_pair = F.col("pair") == pair
        for criterion in criteria:
            of_pair = of_pair & criterion_predicate(criterion)
        passes = passes | of_pair
    return passes


def parameterized(criteria_by_pair: Mapping[str, Sequence[Mapping]] = DEFAULT_CRITERIA) -> EventFilter:
    return EventFilter(S.TRADE, criteria_predicate(criteria_by_pair))


# --- per-pair criteria, kept in a table -------------------------------------------------------------


def criteria_table(spark: SparkSession, criteria_by_pair: Mapping[str, Sequence[Mapping]]) -> DataFrame:
    rows = [
        (pair, [(c["field"], c["operation"], (c["value"].get("Number"), c["value"].get("Text"))) for c in criteria])
        for pair, criteria in criteria_by_pair.items()
    ]
    return spark.createDataFrame(rows, S.FILTER_CONFIG_SCHEMA)


def table_criterion(c: Column) -> Column:
    """One criterion as a struct column: whether the trade meets it."""
    field, operation, number, text = c["field"], c["operation"], c["value"]["Number"], c["value"]["Text"]
    value = F.when(field == "price", F.col("price")).when(field == "size", F.col("size"))
    met = F.when(
        number.isNotNull(),
        F.when(operation == ">", N.gt(value, number))
        .when(operation == "<", N.lt(value, number))
        .when(operation == "=", N.close_to(value, number)),
    ).when(
        text.isNotNull() & (field == "pair"),
        F.when(operation == "=", F.col("pair") == text).when(operation == "!=", F.col("pair") != text),
    )
    return F.coalesce(met, F.lit(False))


def _check_pairs(config: DataFrame) -> None:
    """A pair named twice has no one meaning, so no form of the filter takes it."""
    if config.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        raise FilterConfigError("a pair has more than one entry")


def table_filter(config: DataFrame, **size_limits) -> EventFilter:
    """The filter of a config table (``pair, criteria``; pairs unique), for configs too long to compile."""
    _check_pairs(config)
    column = f"_criteria_{uuid.uuid4().hex}"
    criteria = config.select("pair", F.col("criteria").alias(column))
    return EventFilter(
        S.TRADE,
        F.coalesce(F.forall(column, table_criterion), F.lit(True)),
        prepare=lambda trades: lookup_join(trades, criteria, ["pair"], "left", **size_limits),
    )


def configured(
    config: DataFrame, max_compiled: int = MAX_COMPILED_CRITERIA, max_broadcast_bytes: int = MAX_BROADCAST_BYTES
) -> EventFilter:
    """The filter of a config table: compiled if it is short, else joined in the way its size allows."""
    entries = config.agg(
        F.count(F.lit(1)).alias("pairs"), F.coalesce(F.sum(F.size("criteria")), F.lit(0)).alias("criteria")
    ).first()
    if entries["pairs"] + entries["criteria"] <= max_compiled:
        _check_pairs(config)
        return parameterized(collect_criteria(config))
    return table_filter(config, max_broadcast_bytes=max_broadcast_bytes)


def filter_events(events: DataFrame, event_filter: EventFilter) -> DataFrame:
    """Events of the filter's family that pass it."""
    prepared = event_filter.prepare(events) if event_filter.prepare else events
    return prepared.where(event_filter.column()).select(*events.columns)


def collect_criteria(config: DataFrame) -> dict[str, list[dict]]:
    """A short config table as the mapping ``criteria_predicate`` takes."""
    return {r["pair"]: [c.asDict(recursive=True) for c in r["criteria"]] for r in config.collect()}


# --- other filters ----------------------------------------------------------------------------------


def price_movement(threshold_percent: float) -> Column:
    """Minute bars whose close is more than ``threshold_percent`` percent of the open away from it."""
    change = N.ieee_div(F.abs(F.col("close") - F.col("open")), F.col("open")) * 100.0
    return (F.col("event_type") == S.MINUTE_BAR) & N.gt(change, F.lit(float(threshold_percent)))


def size_gate(minimum: float = DEFAULT_SIZE_GATE) -> Column:
    """Trades of any pair larger than ``minimum``."""
    return N.gt_value(F.col("size"), float(minimum))


# --- fan-out ----------------------------------------------------------------------------------------


def fan_out(events: DataFrame, filters: Mapping[str, EventFilter] | FilterIndex, family: S.Family) -> DataFrame:
    """Events of one family, once per filter they pass, tagged ``filter_id``.  One scan for all filters.

    Filters in great number come as a ``FilterIndex``, which reads trades.
    """
    if not isinstance(filters, Mapping):
        return filters.fan_out(events if family.name == S.TRADE.name else events.where(F.lit(False)))
    mine = {name: f for name, f in filters.items() if f.family.name == family.name}
    if not mine:
        return events.where(F.lit(False)).withColumn("filter_id", F.lit(""))
    kept = events.columns
    for f in mine.values():
        events = f.prepare(events) if f.prepare else events
    passed = F.array(*[F.when(f.column(), F.lit(name)) for name, f in mine.items()])
    if not any(f.python for f in mine.values()):
        # Lets the scan skip what no filter wants; the tags below decide.
        passes_one = F.lit(False)
        for f in mine.values():
            passes_one = passes_one | f.column()
        events = events.where(passes_one)
    return events.select(*kept, F.explode(passed).alias("filter_id")).where(F.col("filter_id").isNotNull())


def apply_filters(events: Mapping[str, DataFrame], filters: Mapping[str, EventFilter]) -> dict[str, DataFrame]:
    """``fan_out`` for every family (by name) that some filter reads."""
    wanted = {f.family.name: f.family for f in filters.values()}
    return {name: fan_out(events[name], filters, family) for name, family in wanted.items()}
