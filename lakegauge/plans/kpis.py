"""KPI catalogue: thirty KPIs of thirteen shapes over canonical roles."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakegauge.dataset import column, constant_rows
from lakegauge.functions.numbers import rounded


@dataclass(frozen=True)
class Bindings:
    """Canonical role to column, and value-set name to its values."""

    columns: Mapping[str, str]
    value_sets: Mapping[str, tuple] = field(default_factory=dict)

    def col(self, role: str) -> Column:
        return column(self.columns[role])

    def has(self, role: str, value_set: str) -> Column:
        """Whether the role's value is in the set; an empty set matches nothing."""
        values = self.value_sets.get(value_set) or ()
        return self.col(role).isin(*values) if values else F.lit(False)


@dataclass(frozen=True)
class Output:
    """One result column: a name, an operation and the role it reads."""

    name: str
    op: str
    role: str | None = None
    value_set: str | None = None


@dataclass(frozen=True)
class Kpi:
    id: str
    pack: str
    outputs: tuple[Output, ...]
    requires: tuple[str, ...] = ()
    where: tuple[str, str] | None = None
    by: tuple[tuple[str, str], ...] = ()
    by_month: str | None = None
    order: str | None = None
    checks: tuple[tuple, ...] = ()
    optional: bool = False


STATUS, AMOUNT, WHEN = "transaction_status", "revenue_amount", "transaction_date"
_DONE = (STATUS, "completed_values")


def _rows(name: str) -> Output:
    return Output(name, "rows")


def _rate(kpi: str, pack: str, prefix: str, role: str, value_set: str, total: str, hits: str | None = None,
          optional: bool = False) -> Kpi:
    percent = f"{prefix}_percent"
    outputs = [Output(percent, "percent", role, value_set)]
    if hits:
        outputs.append(Output(hits, "hits", role, value_set))
    return Kpi(
        kpi, pack, (*outputs, _rows(total)), (role,),
        checks=((">=", percent, 0), ("<=", percent, 100)), optional=optional,
    )


# Names, roles and result columns of every KPI.
KPIS: tuple[Kpi, ...] = (
    Kpi("average_score", "edtech",
        (Output("average_score", "average", "score"), Output("scored_enrollments", "filled", "score")),
        ("score",)),
    _rate("completion_rate", "edtech", "completion", STATUS, "completed_values", "total_enrollments"),
    _rate("dropout_rate", "edtech", "dropout", STATUS, "cancelled_values", "total_enrollments"),
    Kpi("enrollments_by_course", "edtech", (_rows("enrollment_count"),), ("course_ref",),
        by=(("course", "course_ref"),), order="enrollment_count", optional=True),
    Kpi("monthly_enrollment_trend", "edtech", (_rows("enrollment_count"),), (WHEN,), by_month=WHEN),
    Kpi("total_enrollments", "edtech", (_rows("total_enrollments"),),
        checks=((">=", "total_enrollments", 0),)),
    Kpi("average_transaction_amount", "finance", (Output("average_amount", "average", AMOUNT),),
        (AMOUNT, STATUS), where=_DONE),
    _rate("failed_transaction_rate", "finance", "failed", STATUS, "cancelled_values", "total_transactions"),
    Kpi("monthly_transaction_trend", "finance",
        (Output("volume", "sum", AMOUNT), _rows("transaction_count")), (AMOUNT, WHEN, STATUS),
        where=_DONE, by_month=WHEN),
    Kpi("total_transaction_volume", "finance",
        (Output("total_volume", "sum", AMOUNT), _rows("successful_transactions")), (AMOUNT, STATUS),
        where=_DONE, checks=((">=", "total_volume", 0),)),
    Kpi("volume_by_transaction_type", "finance",
        (_rows("transaction_count"), Output("volume", "sum", AMOUNT)), (AMOUNT, "transaction_type"),
        by=(("transaction_type", "transaction_type"),), order="volume", optional=True),
    Kpi("average_measure", "generic-analytics", (Output("average", "average", "measure_amount"),),
        ("measure_amount",), optional=True),
    Kpi("count_by_category", "generic-analytics", (_rows("record_count"),), ("category_dim",),
        by=(("category", "category_dim"),), order="record_count", optional=True),
    Kpi("sum_measure", "generic-analytics", (Output("total", "sum", "measure_amount"),),
        ("measure_amount",), optional=True),
    Kpi("total_records", "generic-analytics", (_rows("total_records"),),
        checks=((">=", "total_records", 0),)),
    Kpi("trend_by_month", "generic-analytics",
        (Output("total", "sum", "measure_amount"), _rows("record_count")),
        ("measure_amount", "date_dim"), by_month="date_dim", optional=True),
    Kpi("bookings_by_location", "healthcare-diagnostics",
        (_rows("booking_count"), Output("revenue", "sum", AMOUNT)), (AMOUNT, "location"),
        by=(("location", "location"),), order="revenue", optional=True),
    _rate("cancellation_rate", "healthcare-diagnostics", "cancellation", STATUS, "cancelled_values",
          "total_bookings", hits="cancelled_bookings"),
    Kpi("monthly_revenue_trend", "healthcare-diagnostics",
        (Output("revenue", "sum", AMOUNT), _rows("booking_count")), (AMOUNT, WHEN, STATUS),
        where=_DONE, by_month=WHEN),
    Kpi("number_of_repeat_customers", "healthcare-diagnostics",
        (Output("repeat_customers", "distinct", "customer_ref"),), ("repeat_flag", "customer_ref"),
        where=("repeat_flag", "repeat_values"), checks=((">=", "repeat_customers", 0),)),
    _rate("repeat_customer_rate", "healthcare-diagnostics", "repeat", "repeat_flag", "repeat_values",
          "total_bookings", hits="repeat_bookings"),
    Kpi("revenue_by_partner_and_product", "healthcare-diagnostics",
        (Output("revenue", "sum", AMOUNT), _rows("booking_count")),
        (AMOUNT, "partner_name", "product_name", STATUS), where=_DONE,
        by=(("partner", "partner_name"), ("product", "product_name")), order="revenue", optional=True),
    Kpi("total_revenue", "healthcare-diagnostics",
        (Output("total_revenue", "sum", AMOUNT), _rows("completed_bookings")), (AMOUNT, STATUS),
        where=_DONE, checks=((">=", "total_revenue", 0), (">=", "completed_bookings", 0))),
    Kpi("average_order_value", "retail-ecommerce",
        (Output("average_order_value", "average", AMOUNT), _rows("completed_orders")), (AMOUNT, STATUS),
        where=_DONE, checks=((">=", "average_order_value", 0),)),
    _rate("cancellation_rate", "retail-ecommerce", "cancellation", STATUS, "cancelled_values", "total_orders"),
    Kpi("monthly_revenue_trend", "retail-ecommerce",
        (Output("revenue", "sum", AMOUNT), _rows("order_count")), (AMOUNT, WHEN, STATUS),
        where=_DONE, by_month=WHEN),
    Kpi("orders_by_payment_channel", "retail-ecommerce",
        (_rows("order_count"), Output("revenue", "sum", AMOUNT)), (AMOUNT, "payment_channel"),
        by=(("payment_channel", "payment_channel"),), order="revenue", optional=True),
    _rate("return_rate", "retail-ecommerce", "return", STATUS, "returned_values", "total_orders", optional=True),
    Kpi("revenue_by_location", "retail-ecommerce",
        (_rows("order_count"), Output("revenue", "sum", AMOUNT)), (AMOUNT, "location"),
        by=(("location", "location"),), order="revenue", optional=True),
    Kpi("total_revenue", "retail-ecommerce",
        (Output("total_revenue", "sum", AMOUNT), _rows("completed_orders")), (AMOUNT, STATUS),
        where=_DONE, checks=((">=", "total_revenue", 0),)),
)


class MissingRoles(ValueError):
    """A KPI whose roles are not all bound."""


def pack_kpis(pack: str) -> tuple[Kpi, ...]:
    return tuple(k for k in KPIS if k.pack == pack)


def find_kpi(pack: str, kpi_id: str) -> Kpi:
    for kpi in pack_kpis(pack):
        if kpi.id == kpi_id:
            return kpi
    raise ValueError(f"unknown KPI {kpi_id!r} of pack {pack!r}")


def missing_roles(kpi: Kpi, bindings: Bindings) -> list[str]:
    return [r for r in kpi.requires if r not in bindings.columns]


def skipped_kpis(kpis: tuple[Kpi, ...], bindings: Bindings) -> list[tuple[Kpi, list[str]]]:
    return [(k, missing_roles(k, bindings)) for k in kpis if missing_roles(k, bindings)]


def _value(out: Output, bindings: Bindings, keep: Column | None) -> Column:
    """The output as an aggregate; ``keep`` restricts it to the KPI's own rows."""

    def kept(value: Column) -> Column:
        return value if keep is None else F.when(keep, value)

    if out.op == "rows":
        return F.count(F.lit(1)) if keep is None else F.count_if(keep)
    if out.op in ("percent", "hits"):
        hits = F.sum(F.when(bindings.has(out.role, out.value_set), 1).otherwise(0))
        if out.op == "hits":
            return hits
        return rounded(F.lit(100.0) * hits.cast("double") / F.nullif(F.count(F.lit(1)), F.lit(0)), 2)
    source = kept(bindings.col(out.role))
    if out.op == "sum":
        return F.sum(source)
    if out.op == "average":
        return F.round(F.avg(source), 2)
    if out.op == "filled":
        return F.count(source)
    return F.count_distinct(source)


def build_kpi(fact: DataFrame, kpi: Kpi, bindings: Bindings) -> DataFrame:
    """The KPI's result over the fact table, in its own order."""
    missing = missing_roles(kpi, bindings)
    if missing:
        raise MissingRoles(f"KPI {kpi.id!r} requires unresolved roles {missing}")
    rows = fact.where(bindings.has(*kpi.where)) if kpi.where else fact
    values = [_value(o, bindings, None).alias(o.name) for o in kpi.outputs]
    if kpi.by_month:
        month = F.date_format(bindings.col(kpi.by_month).cast("timestamp"), "yyyy-MM")
        return rows.groupBy(month.alias("month")).agg(*values).orderBy("month")
    if kpi.by:
        keys = [bindings.col(role).alias(name) for name, role in kpi.by]
        names = [name for name, _ in kpi.by]
        return rows.groupBy(*keys).agg(*values).orderBy(F.desc_nulls_last(kpi.order), *names)
    return rows.agg(*values)


def _is_scalar(kpi: Kpi) -> bool:
    return not kpi.by and not kpi.by_month


def _one_scan(fact: DataFrame, kpis: list[Kpi], bindings: Bindings) -> DataFrame:
    """All ungrouped KPIs in one aggregate: columns ``<kpi>__<output>``."""
    return fact.agg(
        *[
            _value(o, bindings, bindings.has(*k.where) if k.where else None).alias(f"{k.id}__{o.name}")
            for k in kpis
            for o in k.outputs
        ]
    )


def pack_sheet(fact: DataFrame, packs: list[tuple[tuple[Kpi, ...], Bindings]]) -> DataFrame:
    """Every bound KPI of several packs in long form: ``pack, kpi_id, group_key, measure, value``.

    All of them come out of one scan of the fact table: each distinct set of
    keys, the empty one included, is a grouping set, a KPI's filter goes into
    its aggregates, and groups without a row of the KPI's own are left out.
    KPIs without keys have their row even where the table is empty.
    """
    ready = [(k, bound) for kpis, bound in packs for k in kpis if not missing_roles(k, bound)]
    keys: dict[str, Column] = {}
    own_keys: list[tuple[str, ...]] = []
    for kpi, bound in ready:
        names = []
        if kpi.by_month:
            names.append(f"_month_{bound.columns[kpi.by_month]}")
            keys[names[-1]] = F.date_format(bound.col(kpi.by_month).cast("timestamp"), "yyyy-MM")
        for _, role in kpi.by:
            names.append(f"_by_{bound.columns[role]}")
            keys[names[-1]] = bound.col(role)
        own_keys.append(tuple(names))
    place = {name: F.col(f"_k{i}") for i, name in enumerate(keys)}
    rows = fact.select("*", *[c.alias(f"_k{i}") for i, c in enumerate(keys.values())])
    aggregates, measures = [], []
    for i, (kpi, bound) in enumerate(ready):
        keep = bound.has(*kpi.where) if kpi.where else None
        aggregates += [_value(o, bound, keep).cast("double").alias(f"_v{i}_{j}") for j, o in enumerate(kpi.outputs)]
        aggregates.append((F.count(F.lit(1)) if keep is None else F.count_if(keep)).alias(f"_n{i}"))
        measures += [(kpi.pack, kpi.id, o.name, None if own_keys[i] else 0.0 if o.op in ("rows", "filled", "distinct") else None, bool(own_keys[i])) for o in kpi.outputs]
    sets = list(dict.fromkeys(own_keys))
    if len(sets) > 1 or sets != [()]:
        grouped = rows.groupingSets([[place[n] for n in names] for names in sets], *place.values()).agg(F.grouping_id().alias("_set"), *aggregates)
    else:
        grouped = rows.agg(F.lit(0).alias("_set"), *aggregates)
    # a key that a set leaves out is a one bit in its number, the first key the highest
    number = {names: sum(1 << (len(place) - 1 - i) for i, n in enumerate(place) if n not in names) for names in sets}
    cells = []
    for i, (kpi, _) in enumerate(ready):
        names = own_keys[i]
        mine = (F.col("_set") == number[names]) & (F.lit(not names) | (F.col(f"_n{i}") > 0))
        key = F.concat_ws(" | ", *[place[n].cast("string") for n in names]) if names else F.lit(None).cast("string")
        for j, o in enumerate(kpi.outputs):
            cells.append(
                F.struct(
                    mine.alias("mine"), F.lit(kpi.pack).alias("pack"), F.lit(kpi.id).alias("kpi_id"), key.alias("group_key"),
                    F.lit(o.name).alias("measure"), F.col(f"_v{i}_{j}").alias("value"),
                )
            )
    found = grouped.select(F.inline(F.array(*cells))).where("mine").drop("mine")
    # an empty table has no groups, not even that of no keys
    listed = constant_rows(fact.sparkSession, measures, "pack string, kpi_id string, measure string, empty double, grouped boolean")
    joined = listed.join(found, ["pack", "kpi_id", "measure"], "left").where(~F.col("grouped") | F.col("group_key").isNotNull())
    return joined.select("pack", "kpi_id", "group_key", "measure", F.coalesce("value", "empty").alias("value"))


def kpi_sheet(fact: DataFrame, kpis: tuple[Kpi, ...], bindings: Bindings) -> DataFrame:
    """Every bound KPI of one pack in long form, from one scan: ``kpi_id, group_key, measure, value``."""
    return pack_sheet(fact, [(kpis, bindings)]).drop("pack")


def kpi_snapshot(fact: DataFrame, kpis: tuple[Kpi, ...], bindings: Bindings) -> DataFrame:
    """Every bound KPI's result rows as JSON, ready to be stored."""
    parts = [
        build_kpi(fact, k, bindings).select(
            F.lit(k.id).alias("kpi_id"), F.to_json(F.struct("*")).alias("row")
        )
        for k in kpis
        if not missing_roles(k, bindings)
    ]
    return reduce(DataFrame.unionByName, parts)


# ------------------------------------------------------------------- assertions

_OPERATORS = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: a / b,
    "%": lambda a, b: F.pmod(a, b),
    "**": lambda a, b: F.pow(a, b),
    "and": lambda a, b: a & b,
    "or": lambda a, b: a | b,
}
_FUNCTIONS = {
    "not": lambda a: ~a,
    "abs": F.abs,
    "round": lambda a: F.bround(a, 0),
    "len": F.length,
    "min": lambda *a: F.least(*a),
    "max": lambda *a: F.greatest(*a),
}


class CheckError(ValueError):
    """An assertion outside the closed set of operators and columns."""


def check_column(check, columns: Mapping[str, Column]) -> Column:
    """A nested ``(operator, operand, …)`` tuple as a column.

    A string names a result column, a number stands for itself, and
    ``("text", value)`` is a text literal.
    """
    if isinstance(check, str):
        if check not in columns:
            raise CheckError(f"unknown column {check!r} in assertion")
        return columns[check]
    if not isinstance(check, tuple):
        return F.lit(check)
    op, *operands = check
    if op == "text":
        return F.lit(operands[0])
    if op in _OPERATORS and len(operands) == 2:
        return _OPERATORS[op](*[check_column(o, columns) for o in operands])
    if op in _FUNCTIONS:
        return _FUNCTIONS[op](*[check_column(o, columns) for o in operands])
    raise CheckError(f"operator {op!r} is not allowed in an assertion")


def check_text(check) -> str:
    if not isinstance(check, tuple):
        return str(check)
    op, *operands = check
    if op == "text":
        return repr(operands[0])
    if op in _OPERATORS:
        return f" {op} ".join(check_text(o) for o in operands)
    return f"{op}({', '.join(check_text(o) for o in operands)})"


def kpi_assertions(fact: DataFrame, kpis: tuple[Kpi, ...], bindings: Bindings) -> DataFrame:
    """``kpi_id, assertion, passed`` on each KPI's first row; null does not pass.

    Ungrouped KPIs are checked together on the row of their shared scan.
    """
    ready = [k for k in kpis if k.checks and not missing_roles(k, bindings)]
    parts = []
    scalars = [k for k in ready if _is_scalar(k)]
    if scalars:
        row = _one_scan(fact, scalars, bindings)
        cells = [
            _outcome(k, c, {o.name: F.col(f"{k.id}__{o.name}") for o in k.outputs})
            for k in scalars
            for c in k.checks
        ]
        parts.append(row.select(F.inline(F.array(*cells))))
    for k in (k for k in ready if not _is_scalar(k)):
        first = build_kpi(fact, k, bindings).limit(1)
        cells = [_outcome(k, c, {n: F.col(n) for n in first.columns}) for c in k.checks]
        parts.append(first.select(F.inline(F.array(*cells))))
    return reduce(DataFrame.unionByName, parts)


def _outcome(kpi: Kpi, check: tuple, columns: Mapping[str, Column]) -> Column:
    return F.struct(
        F.lit(kpi.id).alias("kpi_id"),
        F.lit(check_text(check)).alias("assertion"),
        F.coalesce(check_column(check, columns), F.lit(False)).alias("passed"),
    )


def kpi_dry_run(fact: DataFrame, kpis: tuple[Kpi, ...], bindings: Bindings) -> DataFrame:
    """Issues only: KPIs without rows, failed assertions and skipped KPIs."""
    sheet = kpi_sheet(fact, kpis, bindings).groupBy("kpi_id").agg(F.count(F.lit(1)).alias("cells"))
    spark = fact.sparkSession
    ready = [(k.id,) for k in kpis if not missing_roles(k, bindings)]
    wanted = constant_rows(spark, ready, "kpi_id string")
    no_rows = wanted.join(sheet, "kpi_id", "left_anti").select(
        "kpi_id", F.lit("returned no rows").alias("issue")
    )
    failed = (
        kpi_assertions(fact, kpis, bindings)
        .where(~F.col("passed"))
        .select("kpi_id", F.concat(F.lit("failed assertion: "), "assertion").alias("issue"))
    )
    skipped = [(k.id, f"unresolved roles: {', '.join(m)}") for k, m in skipped_kpis(kpis, bindings)]
    return no_rows.unionByName(failed).unionByName(
        constant_rows(spark, skipped, "kpi_id string, issue string")
    )
