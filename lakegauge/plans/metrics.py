"""Parameterised metrics: a definition plus a question give one DataFrame."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakegauge.dataset import Dataset, column, quoted
from lakegauge.functions.percentiles import exact_percentiles
from lakegauge.functions.storage import fits_broadcast

TIME_GRAINS = ("day", "week", "month", "quarter", "year")

AGGREGATIONS = {
    "sum": F.sum,
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "nunique": F.count_distinct,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "median": None,
}

FILTERS = {
    "eq": lambda c, v: c == v[0],
    "neq": lambda c, v: c != v[0],
    "gt": lambda c, v: c > v[0],
    "gte": lambda c, v: c >= v[0],
    "lt": lambda c, v: c < v[0],
    "lte": lambda c, v: c <= v[0],
    "in": lambda c, v: c.isin(*v),
    "not_in": lambda c, v: ~c.isin(*v),
}


class MetricError(ValueError):
    """A question the metric's definition does not allow."""


@dataclass(frozen=True)
class JoinEdge:
    from_table: str
    from_column: str
    to_table: str
    to_column: str


@dataclass(frozen=True)
class FilterSpec:
    column: str
    op: str
    values: tuple

    def __post_init__(self) -> None:
        if self.op not in FILTERS:
            raise MetricError(f"unknown filter {self.op!r}; filters: {sorted(FILTERS)}")
        if not self.values or (self.op not in ("in", "not_in") and len(self.values) != 1):
            raise MetricError(f"filter {self.op!r} got {len(self.values)} values")


@dataclass(frozen=True)
class Dimension:
    table: str
    column: str
    path: tuple[JoinEdge, ...] = ()


@dataclass(frozen=True)
class Metric:
    id: str
    table: str
    measure: str
    aggregation: str
    measure_table: str | None = None
    measure_path: tuple[JoinEdge, ...] = ()
    dimensions: tuple[Dimension, ...] = ()
    time_column: str | None = None
    time_grains: tuple[str, ...] = TIME_GRAINS
    default_filters: tuple[FilterSpec, ...] = ()
    confidence: float = 1.0
    caveats: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.aggregation not in AGGREGATIONS:
            raise MetricError(
                f"unknown aggregation {self.aggregation!r}; known: {sorted(AGGREGATIONS)}"
            )

    def with_filter(self, extra: FilterSpec) -> Metric:
        return replace(self, default_filters=(*self.default_filters, extra))

    def dimension(self, name: str) -> Dimension:
        for found in self.dimensions:
            if name in (found.column, f"{found.table}.{found.column}"):
                return found
        raise MetricError(f"{name!r} is not a dimension of metric {self.id!r}")


def _col(table: str, name: str) -> Column:
    return F.col(f"{quoted(table)}.{quoted(name)}")


def build_metric(
    ds: Dataset,
    metric: Metric,
    group_by: str | None = None,
    time_grain: str | None = None,
    filters: Mapping[str, Any] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """``[time_bucket] [grp] value``, the largest values first; all groups unless ``limit`` asks for the top.

    Filters name the measure or an allowed dimension; values are literals of
    the plan and never become part of any SQL text.
    """
    dim = metric.dimension(group_by) if group_by is not None else None
    if time_grain is not None:
        if time_grain not in metric.time_grains or time_grain not in TIME_GRAINS:
            raise MetricError(f"{time_grain!r} is not a time grain of metric {metric.id!r}")
        if not metric.time_column:
            raise MetricError(f"metric {metric.id!r} has no time column")

    measure_table = metric.measure_table or metric.table
    places = {metric.measure: (measure_table, metric.measure_path)}
    for d in metric.dimensions:
        places.setdefault(d.column, (d.table, d.path))
    wanted = [*metric.default_filters]
    wanted += [FilterSpec(name, "eq", (value,)) for name, value in (filters or {}).items()]
    for spec in wanted:
        if spec.column not in places:
            raise MetricError(f"{spec.column!r} cannot filter metric {metric.id!r}")

    edges: list[JoinEdge] = []
    joined = {metric.table}
    paths = [metric.measure_path, dim.path if dim else ()]
    paths += [places[spec.column][1] for spec in wanted]
    for edge in (e for path in paths for e in path):
        if edge.to_table not in joined:
            joined.add(edge.to_table)
            edges.append(edge)

    base = ds.table(metric.table).alias(metric.table)
    on_base = [s for s in wanted if places[s.column][0] == metric.table]
    elsewhere = [s for s in wanted if places[s.column][0] != metric.table]
    base = _filtered(base, on_base, metric.table)

    keys: dict[str, Column] = {}
    if time_grain is not None:
        moment = _col(metric.table, metric.time_column).cast("timestamp")
        keys["time_bucket"] = F.date_trunc(time_grain, moment)
    if dim is not None:
        keys["grp"] = _col(dim.table, dim.column)

    shuffled = [e for e in edges if not fits_broadcast(ds.table(e.to_table))]
    if shuffled and measure_table == metric.table and metric.aggregation in _PARTIAL:
        rows = _aggregated_before_join(ds, metric, base, edges, elsewhere, places, keys, dim)
    else:
        for edge in edges:
            base = _joined(ds, base, edge)
        for spec in elsewhere:
            base = _filtered(base, [spec], places[spec.column][0])
        rows = _aggregate(
            base.select(
                *[c.alias(name) for name, c in keys.items()],
                _col(measure_table, metric.measure).alias("measure"),
            ),
            list(keys),
            metric.aggregation,
        )
    if keys:
        rows = rows.orderBy(F.desc_nulls_last("value"), *[F.asc_nulls_last(k) for k in reversed(keys)])
    return rows if limit is None else rows.limit(limit)


def _joined(ds: Dataset, df: DataFrame, edge: JoinEdge) -> DataFrame:
    other = ds.table(edge.to_table).alias(edge.to_table)
    return df.join(
        other, _col(edge.from_table, edge.from_column) == _col(edge.to_table, edge.to_column)
    )


def _filtered(df: DataFrame, specs: list[FilterSpec], table: str) -> DataFrame:
    for spec in specs:
        df = df.where(FILTERS[spec.op](_col(table, spec.column), spec.values))
    return df


def aggregate_column(op: str, value: Column) -> Column:
    """One of the nine aggregations, apart from the median, as a column."""
    if AGGREGATIONS.get(op) is None:
        raise MetricError(f"{op!r} has no single-column form")
    return AGGREGATIONS[op](value)


def _aggregate(rows: DataFrame, keys: list[str], op: str) -> DataFrame:
    """``rows`` holds the keys and a column ``measure``."""
    if op != "median":
        return rows.groupBy(*keys).agg(aggregate_column(op, F.col("measure")).alias("value"))
    found = exact_percentiles(rows, keys, "measure", [0.5]).select(*keys, "value")
    if not keys:
        return found.agg(F.max("value").alias("value"))
    # groups whose measure is null throughout keep their row
    groups = rows.select(*keys).distinct().withColumn("value", F.lit(None).cast("double"))
    return found.unionByName(groups).groupBy(*keys).agg(F.max("value").alias("value"))


_PARTIAL = {
    "sum": ({"s": F.sum}, lambda: F.sum("s")),
    "count": ({"n": F.count}, lambda: F.coalesce(F.sum("n"), F.lit(0))),
    "min": ({"m": F.min}, lambda: F.min("m")),
    "max": ({"m": F.max}, lambda: F.max("m")),
    "mean": ({"s": F.sum, "n": F.count}, lambda: F.sum("s") / F.nullif(F.sum("n"), F.lit(0))),
    "nunique": ({}, lambda: F.count_distinct("measure")),
    "var": ({"n": F.count, "mean": F.avg, "square": lambda c: F.var_pop(c) * F.count(c)}, None),
    "std": ({"n": F.count, "mean": F.avg, "square": lambda c: F.var_pop(c) * F.count(c)}, None),
}


def _merged_moments(rows: DataFrame, keys: list[str], op: str) -> DataFrame:
    """Variance or deviation of the groups from parts with count, mean and sum of squared distances from it.

    Distances of the parts' means are taken from the group's own mean, so that
    nothing large cancels out.
    """
    rows = rows.withColumn("_group", F.struct(*keys) if keys else F.lit(0))
    filled = rows.where("n > 0")
    centre = filled.groupBy("_group").agg(F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean"))
    centre = centre.withColumnRenamed("_group", "_own")
    spread = filled.join(centre, F.col("_group").eqNullSafe(F.col("_own")))
    away = F.col("mean") - F.col("_mean")
    found = spread.groupBy("_group").agg(
        F.first("_n").alias("_n"), F.sum(F.col("square") + F.col("n") * away * away).alias("_square")
    )
    var = F.when(F.col("_n") > 1, F.col("_square") / (F.col("_n") - 1))
    found = found.select("_group", (F.sqrt(var) if op == "std" else var).alias("value"))
    # groups whose measure is null throughout keep their row
    every = rows.groupBy("_group").agg(F.lit(None).cast("double").alias("value"))
    if not keys:
        return found.agg(F.max("value").alias("value"))
    return found.unionByName(every).groupBy("_group").agg(F.max("value").alias("value")).select("_group.*", "value")


def _aggregated_before_join(ds, metric, base, edges, elsewhere, places, keys, dim) -> DataFrame:
    """Sum up the fact rows of each foreign key before a join that shuffles.

    A key that holds a third of all rows then reaches the join as one row per
    time bucket, whatever the other side's size.
    """
    partial, final = _PARTIAL[metric.aggregation]
    foreign = sorted({e.from_column for e in edges if e.from_table == metric.table})
    early = {n: c for n, c in keys.items() if n == "time_bucket" or dim.table == metric.table}
    # different values stay apart where they are to be counted
    counted = [_col(metric.table, metric.measure).alias("part_measure")] if not partial else []
    small = base.groupBy(
        *[_col(metric.table, c).alias(c) for c in foreign],
        *[c.alias(f"key_{name}") for name, c in early.items()],
        *counted,
    )
    small = small.agg(F.lit(0).alias("part_")) if counted else small.agg(*[f(_col(metric.table, metric.measure)).alias(f"part_{n}") for n, f in partial.items()])
    small = small.alias(metric.table)
    for edge in edges:
        small = _joined(ds, small, edge)
    for spec in elsewhere:
        small = _filtered(small, [spec], places[spec.column][0])
    named = {n: F.col(f"key_{n}") if n in early else c for n, c in keys.items()}
    rows = small.select(
        *[c.alias(name) for name, c in named.items()],
        *[F.col(f"part_{n}").alias(n) for n in partial or ["measure"]],
    )
    if final is None:
        return _merged_moments(rows, list(named), metric.aggregation)
    return rows.groupBy(*named).agg(final().alias("value"))


def metric_sheet(ds: Dataset, metrics: list[Metric]) -> DataFrame:
    """One value per metric; metrics of one table and filter share one scan."""
    groups: dict[tuple, list[Metric]] = {}
    for m in metrics:
        groups.setdefault((m.table, m.measure_path, m.default_filters), []).append(m)
    parts = []
    for (table, path, filters), members in groups.items():
        rows = ds.table(table).alias(table)
        for edge in path:
            rows = _joined(ds, rows, edge)
        for spec in filters:
            rows = _filtered(rows, [spec], table)
        direct = [m for m in members if m.aggregation != "median"]
        if direct:
            one_row = rows.agg(
                *[
                    aggregate_column(m.aggregation, _col(m.measure_table or table, m.measure))
                    .cast("double")
                    .alias(m.id)
                    for m in direct
                ]
            )
            pairs = F.array(
                *[F.struct(F.lit(m.id).alias("metric_id"), column(m.id).alias("value")) for m in direct]
            )
            parts.append(one_row.select(F.inline(pairs)))
        medians = [m for m in members if m.aggregation == "median"]
        if medians:
            cells = rows.select(
                F.inline(
                    F.array(
                        *[
                            F.struct(
                                F.lit(m.id).alias("metric_id"),
                                _col(m.measure_table or table, m.measure).cast("double").alias("v"),
                            )
                            for m in medians
                        ]
                    )
                )
            )
            parts.append(
                exact_percentiles(cells, ["metric_id"], "v", [0.5], few_groups=True).select(
                    "metric_id", "value"
                )
            )
    return reduce(DataFrame.unionByName, parts)


# ------------------------------------------------------------------- catalogue

MAX_HOPS = 2
MIN_EDGE_CONFIDENCE = 0.7
DIMENSION_VALUES = (2, 50)
WITH_SUM = (("total", "sum"), ("average", "mean"), ("min", "min"), ("max", "max"))
WITHOUT_SUM = (("average", "mean"), ("min", "min"), ("max", "max"), ("median", "median"))


def _safe(paths: DataFrame) -> DataFrame:
    bad = F.exists(
        "path", lambda e: e["fan_out_risk"] | (e["confidence"] < MIN_EDGE_CONFIDENCE)
    )
    return paths.where((F.col("hops") <= MAX_HOPS) & ~bad)


def dimension_candidates(columns: DataFrame, paths: DataFrame) -> DataFrame:
    """Columns a fact may be grouped by; ``paths`` start at the fact table."""
    usable = columns.where(
        F.col("guessed_role").isin("categorical", "geographic", "boolean_flag")
        & F.col("cardinality").between(*DIMENSION_VALUES)
        & ~F.col("is_pii")
    )
    return usable.join(_safe(paths).select("table", "hops", "path"), "table").select(
        F.concat_ws(".", "table", "column").alias("field_id"), "table", "column", "cardinality",
        "hops", "path",
    )


def metric_catalog(
    columns: DataFrame,
    paths: DataFrame,
    fact: str,
    fact_key: str | None,
    claims: DataFrame | None = None,
) -> DataFrame:
    """Every metric of a fact table, one row each, with its provenance.

    ``claims`` may hold ``table, column, kind, sums, confidence``: a claimed
    column has to be a measure, and only a claim allows sums.  A sum beside a
    status column may count rows it should not, so it is trusted less.
    """
    spark = columns.sparkSession
    empty = "table string, column string, kind string, sums boolean, claim_confidence double"
    stated = (
        claims.withColumnRenamed("confidence", "claim_confidence")
        if claims is not None
        else spark.createDataFrame([], empty)
    )
    measures = (
        columns.where((F.col("guessed_role") == "numeric") & ~F.col("is_identifier") & ~F.col("is_pii"))
        .join(_safe(paths).select("table", "hops"), "table")
        .join(stated, ["table", "column"], "left")
        .where((F.col("hops") > 0) | F.col("kind").isNull() | (F.col("kind") == "measure"))
    )
    sums = F.coalesce("sums", F.lit(False))

    def operations(pairs) -> Column:
        return F.array(
            *[F.struct(F.lit(s).alias("suffix"), F.lit(op).alias("aggregation")) for s, op in pairs]
        )

    rows = measures.select(
        "table", "column", "ordinal", "hops", "claim_confidence", sums.alias("sums"),
        F.inline(F.when(sums, operations(WITH_SUM)).otherwise(operations(WITHOUT_SUM))),
    )
    short = F.concat_ws("_", "suffix", "column")
    own = rows.where("hops = 0").select(short.alias("metric_id")).distinct().withColumn("_taken", F.lit(True))
    named = (
        rows.withColumn("_short", short)
        .join(own, (F.col("_short") == F.col("metric_id")) & (F.col("hops") > 0), "left")
        .withColumn(
            "metric_id",
            F.when(F.col("_taken"), F.concat_ws("_", "suffix", "table", "column")).otherwise(F.col("_short")),
        )
    )
    catalog = named.select(
        "metric_id", F.lit(fact).alias("base_table"), F.col("table").alias("measure_table"),
        F.col("column").alias("measure"), "aggregation", "sums", "claim_confidence",
    )
    if fact_key is not None:
        count = spark.range(1).select(
            F.lit(f"count_{fact}").alias("metric_id"), F.lit(fact).alias("base_table"),
            F.lit(fact).alias("measure_table"), F.lit(fact_key).alias("measure"),
            F.lit("count").alias("aggregation"), F.lit(False).alias("sums"),
            F.lit(None).cast("double").alias("claim_confidence"),
        )
        catalog = catalog.unionByName(count)
    status = dimension_candidates(columns, paths).where(
        F.lower("column").contains("status") | F.lower("column").contains("state")
    )
    first_status = status.groupBy(F.lit(fact).alias("base_table")).agg(
        F.min_by("column", F.struct("hops", "table", "column")).alias("status_dimension")
    )
    trusted = F.coalesce("claim_confidence", F.lit(1.0))
    doubtful = F.col("sums") & F.col("status_dimension").isNotNull()
    return (
        catalog.join(first_status, "base_table", "left")
        .withColumn("origin", F.when(F.col("claim_confidence").isNotNull(), "claimed").otherwise("deterministic"))
        .withColumn("confidence", F.when(doubtful, F.least(F.lit(0.6), trusted)).otherwise(trusted))
        .withColumn(
            "caveat",
            F.when(doubtful, F.concat(F.lit("sums every row regardless of "), "status_dimension")),
        )
        .drop("sums", "claim_confidence", "status_dimension")
    )


def value_set_filter(metric: Metric, values: tuple) -> Metric:
    """The metric restricted to a value set on its status-like dimension."""
    if not values or not metric.dimensions:
        raise MetricError(f"metric {metric.id!r} has no dimension or value to filter by")
    named = [d for d in metric.dimensions if "status" in d.column.lower() or "state" in d.column.lower()]
    chosen = (named or list(metric.dimensions))[0]
    return metric.with_filter(FilterSpec(chosen.column, "in", tuple(values)))
