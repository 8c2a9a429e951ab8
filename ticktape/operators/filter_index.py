"""Very many saved filters at once: an index over their limits, so that an event meets only the filters it may pass.

``filters.fan_out`` evaluates every filter on every event, which suits tens of filters.  Here the filters are rows and the plan
has the same size for any number of them.  Within a pair, the criteria of a filter are a box: a range of prices times a range
of sizes.  Both lines are cut into at most 2^levels slabs at quantiles of the limits in use, and a range of slabs is the union
of a few nodes of the binary tree over them.  A box is stored under its pairs of nodes (price, size); an event lies in one node
of each line per level, so it finds a box under exactly one pair of nodes, by an equality join.  Only boxes that end inside the
event's own slab can be met in vain; the exact comparison decides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticktape.functions import floats as N
from ticktape.operators.filters import NUMBER_FIELDS, TEXT_FIELDS
from ticktape.operators.lookup import lookup_join
from ticktape.sources.filter_config import FilterConfigError, check_criteria

LEVELS = 6
_KEYS = ["_fx_own", "_fx_pair"]
_NODES = [f"_fx_{field}_node" for field in NUMBER_FIELDS]
_SAVED = "filter_id string, pair string, criteria array<struct<field: string, operation: string, value: struct<Number: double, Text: string>>>"


def saved_filters(spark: SparkSession, filters_by_id: dict[str, dict]) -> DataFrame:
    """Filters as rows ``filter_id, pair, criteria``.

    A NULL pair holds for every pair without a row of its own; in the mapping it is the key ``None``.  A filter without it
    passes no other pairs, so give ``None: []`` to let them pass, as ``filters.parameterized`` does.
    """
    rows = [
        (name, pair, [(c["field"], c["operation"], (c["value"].get("Number"), c["value"].get("Text"))) for c in criteria])
        for name, by_pair in filters_by_id.items()
        for pair, criteria in by_pair.items()
    ]
    return spark.createDataFrame(rows, _SAVED)


# --- building ---------------------------------------------------------------------------------------


def _never_met(c: Column) -> Column:
    number, text = c["value"]["Number"], c["value"]["Text"]
    numeric = number.isNotNull() & ~F.isnan(number) & c["field"].isin(*NUMBER_FIELDS) & c["operation"].isin(">", "<", "=")
    textual = number.isNull() & text.isNotNull() & c["field"].isin(*TEXT_FIELDS) & c["operation"].isin("=", "!=")
    return ~F.coalesce(numeric | textual, F.lit(False))


def _values(field: str, operation: str) -> Column:
    """What the entry's criteria of this field and operation compare with."""
    kind = "Text" if field in TEXT_FIELDS else "Number"
    chosen = F.filter("criteria", lambda c: (c["field"] == field) & (c["operation"] == operation))
    return F.transform(chosen, lambda c: c["value"][kind])


def _boxes(saved: DataFrame) -> DataFrame:
    """One row per entry that can be met at all, with its criteria folded into bounds (NULL: none)."""
    entries = saved.where(~F.exists("criteria", _never_met)).select(
        "filter_id",
        F.col("pair").isNotNull().alias("_fx_own"),
        F.coalesce("pair", F.lit("")).alias("_fx_pair"),
        *[F.array_max(_values(f, ">")).alias(f"_fx_{f}_above") for f in NUMBER_FIELDS],
        *[F.array_min(_values(f, "<")).alias(f"_fx_{f}_below") for f in NUMBER_FIELDS],
        # Equality has a tolerance, so several values can be met together: if the outermost are.
        *[F.array_min(_values(f, "=")).alias(f"_fx_{f}_least") for f in NUMBER_FIELDS],
        *[F.array_max(_values(f, "=")).alias(f"_fx_{f}_most") for f in NUMBER_FIELDS],
        F.array_min(_values("pair", "=")).alias("_fx_is_least"),
        F.array_max(_values("pair", "=")).alias("_fx_is_most"),
        _values("pair", "!=").alias("_fx_is_not"),
    )
    return entries.where(~F.col("_fx_own") | _text_met(F.col("_fx_pair")))


def _text_met(pair: Column) -> Column:
    named = F.col("_fx_is_least").isNull() | ((F.col("_fx_is_least") == pair) & (F.col("_fx_is_most") == pair))
    return named & ~F.array_contains("_fx_is_not", pair)


def _cuts(boxes: DataFrame, levels: int) -> DataFrame:
    """Per pair, at most 2^levels - 1 rising cuts of each line, among the limits in use."""
    fractions = F.array(*[F.lit(i / (1 << levels)) for i in range(1, 1 << levels)])
    finite = lambda x: (x > F.lit(-N.INFINITY)) & (x < F.lit(N.INFINITY))
    limits = boxes.select(*_KEYS, *[
        F.filter(F.array(*[f"_fx_{f}_{end}" for end in ("above", "below", "least", "most")]), finite).alias(f) for f in NUMBER_FIELDS
    ])
    each = limits.select(*_KEYS, F.explode_outer(F.arrays_zip(*NUMBER_FIELDS)).alias("limit"))
    # A sketch per pair, merged over tasks: no pair's limits are brought together.
    return each.groupBy(*_KEYS).agg(*[
        F.coalesce(F.array_sort(F.array_distinct(F.percentile_approx(F.col("limit")[f], fractions))), F.array().cast("array<double>"))
        .alias(f"_fx_{f}_cuts")
        for f in NUMBER_FIELDS
    ])


def _slab(cuts: Column, value: Column, levels: int) -> Column:
    """How many cuts lie at or below ``value``, by binary search; 0 for NULL, the last slab for NaN."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(levels))])
    further = lambda at, step: F.when(F.get(cuts, at + step - 1) <= value, at + step).otherwise(at)
    return F.aggregate(steps, F.lit(0), further)


def _nodes(first: Column, last: Column, levels: int) -> Column:
    """The tree's nodes that make up the slabs ``first`` to ``last``: at most two per level.

    Node ``(1 << (levels - level)) + i`` holds the slabs ``i << level`` up to the next.  A block is taken if it lies in the
    range and its parent does not.
    """
    taken = []
    for level in range(levels + 1):
        low, high = F.ceil(first / F.lit(1 << level)).cast("int"), F.floor((last + 1) / F.lit(1 << level)).cast("int") - 1
        inside, heap = low <= high, 1 << (levels - level)
        for block, alone in ((low, low % 2 == 1), (high, high % 2 == 0)):
            taken.append(F.when(inside & alone, F.struct(F.lit(level).alias("level"), (block + heap).alias("node"))))
    return F.array_compact(F.array(*taken))


def _placed(boxes: DataFrame, cuts: DataFrame, levels: int) -> DataFrame:
    """Every box under each of its pairs of nodes, with the levels these lie on."""
    rows = lookup_join(boxes, cuts, _KEYS, "inner")
    for f in NUMBER_FIELDS:
        bound = lambda end, by: F.coalesce(
            _slab(F.col(f"_fx_{f}_cuts"), F.col(f"_fx_{f}_{end}") + F.lit(by), levels), F.lit(0)  # noqa: B023
        )
        none = lambda end: F.col(f"_fx_{f}_{end}").isNull()  # noqa: E731, B023
        # One more than the tolerance of equality to either side; greatest and least skip what is NULL.
        first = F.greatest(F.lit(0), F.when(~none("above"), bound("above", 0.0)), F.when(~none("most"), bound("most", -1e-15)))
        last = F.least(
            F.lit((1 << levels) - 1), F.when(~none("below"), bound("below", 0.0)), F.when(~none("least"), bound("least", 1e-15))
        )
        rows = rows.withColumn(f"_fx_{f}_first", first).withColumn(f"_fx_{f}_last", last)
    for f in NUMBER_FIELDS:
        nodes = _nodes(F.col(f"_fx_{f}_first"), F.col(f"_fx_{f}_last"), levels)
        rows = rows.select("*", F.explode(nodes).alias(f"_fx_{f}_at"))
    ends = [f"_fx_{f}_{end}" for f in NUMBER_FIELDS for end in ("above", "below", "least", "most")]
    return rows.select(
        "filter_id", *_KEYS, *[F.col(f"_fx_{f}_at.node").alias(f"_fx_{f}_node") for f in NUMBER_FIELDS], *ends, "_fx_is_least", "_fx_is_most", "_fx_is_not",
        F.struct(*[F.col(f"_fx_{f}_at.level").alias(f) for f in NUMBER_FIELDS]).alias("_fx_levels"),
    )


def write_filter_index(saved: DataFrame, path: str, levels: int = LEVELS) -> "FilterIndex":
    """The index of ``saved`` filters (see ``saved_filters``; each filter names a pair once), written to a new folder ``path``.

    More ``levels`` mean fewer boxes met in vain and more rows: an entry has about ``levels`` rows per field it limits.
    """
    check_criteria(saved, ["filter_id", "pair"], may_be_null=("pair",))
    spark, boxes = saved.sparkSession, _boxes(saved)
    _cuts(boxes, levels).write.parquet(f"{path}/cuts")
    cuts = spark.read.parquet(f"{path}/cuts")
    _placed(boxes, cuts, levels).write.parquet(f"{path}/boxes")
    placed = spark.read.parquet(f"{path}/boxes")
    # At most (levels + 1)^2 pairs of levels per pair.
    cuts.join(placed.groupBy(*_KEYS).agg(F.collect_set("_fx_levels").alias("_fx_shapes")), _KEYS).write.parquet(f"{path}/lines")
    defaults = saved.where("pair IS NULL").select("filter_id")
    own = saved.where("pair IS NOT NULL").join(defaults, "filter_id", "left_semi")
    own.select("filter_id", "pair", F.lit(False).alias("_fx_own")).write.parquet(f"{path}/exceptions")
    spark.createDataFrame([(levels,)], "levels int").write.json(f"{path}/about")
    return read_filter_index(spark, path)


def read_filter_index(spark: SparkSession, path: str) -> "FilterIndex":
    """The index that ``write_filter_index`` has written."""
    about = spark.read.schema("levels int").json(f"{path}/about").first()
    if about is None:
        raise FilterConfigError(f"the index at {path} was not finished")
    table = lambda name: spark.read.parquet(f"{path}/{name}")
    return FilterIndex(about["levels"], table("lines"), table("boxes").drop("_fx_levels"), table("exceptions"))


# --- applying ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class FilterIndex:
    """``lines``: cuts and levels in use per pair; ``boxes``: entries by pairs of nodes; ``exceptions``: pairs that filters
    with an entry for all other pairs name themselves."""

    levels: int
    lines: DataFrame
    boxes: DataFrame
    exceptions: DataFrame

    def fan_out(self, trades: DataFrame, **size_limits) -> DataFrame:
        """Trades once per saved filter they pass, tagged ``filter_id``; the rows of ``filters.fan_out``.

        Batch or stream.  A trade without a pair passes nothing.  Each side table is broadcast if it is measured to be
        small, else shuffled (``lookup_join``).
        """
        kept = trades.columns
        own = F.struct(F.lit(True).alias("own"), F.col("pair").alias("pair"))
        other = F.struct(F.lit(False).alias("own"), F.lit("").alias("pair"))
        probes = trades.where(F.col("pair").isNotNull()).select(*kept, F.explode(F.array(own, other)).alias("_fx_key"))
        probes = probes.select(*kept, F.col("_fx_key.own").alias("_fx_own"), F.col("_fx_key.pair").alias("_fx_pair"))
        lines = lookup_join(probes, self.lines, _KEYS, "inner", **size_limits)
        leaves = [
            (_slab(F.col(f"_fx_{f}_cuts"), F.col(f), self.levels) + F.lit(1 << self.levels)).alias(f"_fx_{f}_leaf") for f in NUMBER_FIELDS
        ]
        shapes = lines.select(*kept, *_KEYS, *leaves, "_fx_shapes").select("*", F.explode("_fx_shapes").alias("_fx_shape"))
        node = lambda f: F.call_function("shiftright", F.col(f"_fx_{f}_leaf"), F.col("_fx_shape")[f])
        placed = shapes.select(*kept, *_KEYS, *[node(f).alias(n) for f, n in zip(NUMBER_FIELDS, _NODES)])
        hits = lookup_join(placed, self.boxes, [*_KEYS, *_NODES], "inner", **size_limits).where(_met())
        hits = hits.select(*kept, "filter_id", "_fx_own")
        if self.exceptions.limit(1).count():
            hits = lookup_join(hits, self.exceptions, ["filter_id", "pair", "_fx_own"], "left_anti", **size_limits)
        return hits.select(*kept, "filter_id")


def _met() -> Column:
    """The exact comparison of an event with a box."""
    met = _text_met(F.col("pair"))
    for f in NUMBER_FIELDS:
        value, end = F.col(f), lambda name: F.col(f"_fx_{f}_{name}")  # noqa: B023
        for name, compare in (("above", N.gt), ("below", N.lt), ("least", N.close_to), ("most", N.close_to)):
            met = met & (end(name).isNull() | F.coalesce(compare(value, end(name)), F.lit(False)))
    return met
