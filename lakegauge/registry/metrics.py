"""Registered metric and KPI queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakegauge.operators import graph
from lakegauge.operators.profile import Profile
from lakegauge.plans import kpis as K
from lakegauge.plans import metrics as M
from lakegauge.plans.metrics import Dimension, FilterSpec, JoinEdge, Metric
from lakegauge.registry.base import BOTH, GRAPH, RELATIONS, columns_ctes, day, load, path_ctes, with_, words
from lakegauge.registry.derived import ALL_SCHEMAS, SOURCES, derive

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
EXTRA = dict(sources=SOURCES, schemas=ALL_SCHEMAS)


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


def _shown(df: DataFrame, digits: int | None = 2) -> DataFrame:
    """Values rounded and time buckets as dates, to compare engines."""
    if digits is not None:
        df = df.withColumn("value", F.round(F.col("value").cast("double"), digits))
    return df.withColumn("time_bucket", day("time_bucket")) if "time_bucket" in df.columns else df


TO_CUSTOMER = JoinEdge("orders", "o_custkey", "customer", "c_custkey")
TO_NATION = JoinEdge("customer", "c_nationkey", "nation", "n_nationkey")
TO_ORDERS = JoinEdge("lineitem", "l_orderkey", "orders", "o_orderkey")

ORDER_VALUE = Metric(
    "total_order_value", "orders", "o_totalprice", "sum",
    dimensions=(
        Dimension("orders", "o_orderstatus"),
        Dimension("orders", "o_orderpriority"),
        Dimension("orders", "o_custkey"),
        Dimension("customer", "c_mktsegment", (TO_CUSTOMER,)),
        Dimension("nation", "n_name", (TO_CUSTOMER, TO_NATION)),
    ),
    time_column="o_orderdate",
)
LINE_VALUE = Metric(
    "total_line_value", "lineitem", "l_extendedprice", "sum",
    dimensions=(
        Dimension("lineitem", "l_returnflag"),
        Dimension("lineitem", "l_linestatus"),
        Dimension("orders", "o_orderpriority", (TO_ORDERS,)),
    ),
    time_column="l_shipdate",
)
BALANCE = Metric(
    "average_balance", "orders", "c_acctbal", "mean", measure_table="customer",
    measure_path=(TO_CUSTOMER,), dimensions=(Dimension("orders", "o_orderstatus"),),
)

_JOINED = "orders JOIN customer ON o_custkey = c_custkey"


def _metric(name: str, sql: str, metric: Metric, *tables: str, digits: int | None = 2, **question) -> None:
    @query(name, sql)
    def _(spark, sf_dir):
        return _shown(M.build_metric(load(spark, sf_dir, *tables), metric, **question), digits)


def _ranked(columns: str, source: str, where: str = "", value: str = "sum(o_totalprice)", limit: int | None = None) -> str:
    """Grouped values: largest first, then the group, then the time bucket."""
    names = [c.split(" AS ")[-1] for c in columns.split("; ")]
    order = ", ".join(["value DESC NULLS LAST", *reversed(names)])
    return (
        f"SELECT {', '.join(columns.split('; '))}, round({value}, 2)::DOUBLE AS value FROM {source} {where} "
        f"GROUP BY {', '.join(str(i + 1) for i in range(len(names)))} ORDER BY {order}" + ("" if limit is None else f" LIMIT {limit}")
    )


def _bucket(grain: str, column: str = "o_orderdate") -> str:
    return f"strftime(date_trunc('{grain}', {column}), '%Y-%m-%d') AS time_bucket"


_metric("metric_total", "SELECT round(sum(o_totalprice), 2) AS value FROM orders", ORDER_VALUE, "orders")
_metric("metric_by_dim", _ranked("o_orderpriority AS grp", "orders"), ORDER_VALUE, "orders", group_by="o_orderpriority")
_metric("metric_by_time", _ranked(_bucket("month"), "orders"), ORDER_VALUE, "orders", time_grain="month")
_metric("metric_by_dim_time", _ranked(f"{_bucket('month')}; c_mktsegment AS grp", _JOINED), ORDER_VALUE,
        "orders", "customer", group_by="c_mktsegment", time_grain="month")
_metric("metric_star_join", _ranked("o_orderpriority AS grp", "lineitem JOIN orders ON l_orderkey = o_orderkey", value="sum(l_extendedprice)"),
        LINE_VALUE, "lineitem", "orders", group_by="orders.o_orderpriority")
_metric("metric_two_hop", _ranked("n_name AS grp", f"{_JOINED} JOIN nation ON c_nationkey = n_nationkey"), ORDER_VALUE,
        "orders", "customer", "nation", group_by="n_name")
_metric("metric_broadcast_measure", _ranked("o_orderstatus AS grp", _JOINED, value="avg(c_acctbal)"), BALANCE,
        "orders", "customer", group_by="o_orderstatus")
_metric("metric_top_k", _ranked("o_custkey AS grp", "orders", limit=10), ORDER_VALUE, "orders", group_by="o_custkey", limit=10)

_AGG_SQL = {
    "sum": "round(sum(l_extendedprice), 2)", "mean": "round(avg(l_extendedprice), 2)", "min": "min(l_extendedprice)",
    "max": "max(l_extendedprice)", "count": "count(l_extendedprice)", "nunique": "count(DISTINCT l_extendedprice)",
    "std": "round(stddev_samp(l_extendedprice), 2)", "var": "round(var_samp(l_extendedprice), 0)",
    "median": "round(median(l_extendedprice), 4)",
}


DIGITS = {"count": None, "nunique": None, "var": 0, "median": 4}


def _aggregation(op: str, sql: str) -> None:
    metric = Metric(f"{op}_line", "lineitem", "l_extendedprice", op, dimensions=LINE_VALUE.dimensions)
    digits = DIGITS.get(op, 2)
    _metric(f"agg_{op}", f"SELECT l_returnflag AS grp, {sql} AS value FROM lineitem GROUP BY 1", metric, "lineitem",
            digits=digits, group_by="l_returnflag")


for _op, _sql in _AGG_SQL.items():
    _aggregation(_op, _sql)

_FILTER_CASES = {
    "eq": ("o_orderstatus", ("F",), "o_orderstatus = 'F'"),
    "neq": ("o_orderstatus", ("F",), "o_orderstatus <> 'F'"),
    "gt": ("o_totalprice", (250000.0,), "o_totalprice > 250000"),
    "gte": ("o_orderpriority", ("3-MEDIUM",), "o_orderpriority >= '3-MEDIUM'"),
    "lt": ("o_totalprice", (250000.0,), "o_totalprice < 250000"),
    "lte": ("o_orderpriority", ("3-MEDIUM",), "o_orderpriority <= '3-MEDIUM'"),
    "in": ("c_mktsegment", ("BUILDING", "MACHINERY"), "c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    "not_in": ("c_mktsegment", ("BUILDING", "MACHINERY"), "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"),
}
for _op, (_column, _values, _where) in _FILTER_CASES.items():
    _metric(f"filter_{_op}", _ranked("o_orderpriority AS grp", _JOINED, f"WHERE {_where}"),
            ORDER_VALUE.with_filter(FilterSpec(_column, _op, _values)), "orders", "customer", group_by="o_orderpriority")

for _grain in M.TIME_GRAINS:
    _metric(f"grain_{_grain}", _ranked(_bucket(_grain), "orders"), ORDER_VALUE, "orders", time_grain=_grain)

SET_FILTERED = M.value_set_filter(ORDER_VALUE, ("F", "O"))
_metric("metric_value_set_filter", _ranked("o_orderpriority AS grp", "orders", "WHERE o_orderstatus IN ('F', 'O')"),
        SET_FILTERED, "orders", group_by="o_orderpriority")


SHEET = [Metric(f"{op}_price", "lineitem", "l_extendedprice", op) for op in M.AGGREGATIONS] + [
    Metric("total_order_value", "orders", "o_totalprice", "sum"),
    Metric("completed_order_value", "orders", "o_totalprice", "sum",
           dimensions=(Dimension("orders", "o_orderstatus"),),
           default_filters=(FilterSpec("o_orderstatus", "eq", ("F",)),)),
    Metric("average_balance", "orders", "c_acctbal", "mean", measure_table="customer", measure_path=(TO_CUSTOMER,)),
]


@query("metric_sheet", " UNION ALL ".join(
    [f"SELECT '{op}_price' AS metric_id, round(CAST({sql} AS DOUBLE), {DIGITS.get(op, 2) or 0}) AS value FROM lineitem" for op, sql in _AGG_SQL.items()]
    + ["SELECT 'total_order_value', round(sum(o_totalprice), 2) FROM orders",
       "SELECT 'completed_order_value', round(sum(o_totalprice), 2) FROM orders WHERE o_orderstatus = 'F'",
       f"SELECT 'average_balance', round(avg(c_acctbal), 2) FROM {_JOINED}"]))
def _(spark, sf_dir):
    sheet = M.metric_sheet(load(spark, sf_dir, "lineitem", "orders", "customer"), SHEET)
    rounded = (
        F.when(F.col("metric_id") == "var_price", F.round("value", 0))
        .when(F.col("metric_id") == "median_price", F.round("value", 4))
        .otherwise(F.round("value", 2))
    )
    return sheet.withColumn("value", rounded)


# ----------------------------------------------------------------- catalogue

CATALOGUED = ("sales", "customer", "nation")
CATALOG_CTES = (
    columns_ctes(CATALOGUED, (), **EXTRA), RELATIONS, GRAPH, BOTH, path_ctes("sales", 2),
    "safe AS (SELECT tbl, hops FROM paths WHERE NOT risky AND sure >= 0.7 AND hops <= 2)",
    "dims AS (SELECT c.tbl, c.col, c.cardinality, s.hops, c.ordinal FROM columns_ c JOIN safe s USING (tbl) "
    "WHERE guessed_role IN ('categorical', 'boolean_flag') AND cardinality BETWEEN 2 AND 50 AND NOT is_pii)",
    "claimed(tbl, col, sums, sure_of) AS (VALUES ('sales', 'revenue_amount', true, 0.9::DOUBLE))",
    "measures AS (SELECT m.tbl, m.col, s.hops, coalesce(k.sums, false) AS sums, k.sure_of FROM columns_ m JOIN safe s USING (tbl) "
    "LEFT JOIN claimed k ON k.tbl = m.tbl AND k.col = m.col WHERE guessed_role = 'numeric' AND NOT is_identifier AND NOT is_pii)",
    "ops(suffix, aggregation, for_sums) AS (VALUES ('total', 'sum', true), ('average', 'mean', true), ('min', 'min', true), ('max', 'max', true), "
    "('average', 'mean', false), ('min', 'min', false), ('max', 'max', false), ('median', 'median', false))",
    "catalog AS (SELECT suffix || '_' || col AS metric_id, 'sales' AS base_table, tbl AS measure_table, col AS measure, aggregation, sums, sure_of "
    "FROM measures JOIN ops ON ops.for_sums = sums "
    "UNION ALL SELECT 'count_sales', 'sales', 'sales', 'order_ref', 'count', false, NULL)",
    "status AS (SELECT arg_min(col, [CAST(hops AS VARCHAR), tbl, col]) AS dim FROM dims WHERE contains(lower(col), 'status') OR contains(lower(col), 'state'))",
)


def _catalog_inputs(spark, sf_dir):
    known = Profile(derive(spark, sf_dir, *CATALOGUED))
    return known, graph.join_paths(known.edges, "sales", max_hops=M.MAX_HOPS)


@query("dimension_candidates", with_(*CATALOG_CTES, select="SELECT tbl || '.' || col AS field_id, cardinality, hops FROM dims", recursive=True))
def _(spark, sf_dir):
    known, paths = _catalog_inputs(spark, sf_dir)
    return M.dimension_candidates(known.columns, paths).select("field_id", "cardinality", "hops")


def _catalog(spark, sf_dir) -> DataFrame:
    known, paths = _catalog_inputs(spark, sf_dir)
    claims = known.columns.where("table = 'sales' AND column = 'revenue_amount'").select(
        "table", "column", F.lit("measure").alias("kind"), F.lit(True).alias("sums"), F.lit(0.9).alias("confidence"))
    return M.metric_catalog(known.columns, paths, "sales", "order_ref", claims)


@query("metric_catalog", with_(
    *CATALOG_CTES, select="SELECT metric_id, base_table, measure_table, measure, aggregation FROM catalog", recursive=True))
def _(spark, sf_dir):
    return _catalog(spark, sf_dir).select("metric_id", "base_table", "measure_table", "measure", "aggregation")


@query("metric_provenance", with_(
    *CATALOG_CTES, recursive=True,
    select="SELECT metric_id, CASE WHEN sure_of IS NULL THEN 'deterministic' ELSE 'claimed' END AS origin, "
    "CASE WHEN sums AND dim IS NOT NULL THEN least(0.6, coalesce(sure_of, 1.0)) ELSE coalesce(sure_of, 1.0) END AS confidence, "
    "CASE WHEN sums THEN 'sums every row regardless of ' || dim END AS caveat FROM catalog, status"))
def _(spark, sf_dir):
    return _catalog(spark, sf_dir).select("metric_id", "origin", "confidence", "caveat")


# ---------------------------------------------------------------------- KPIs

SALE = K.Bindings(
    {"revenue_amount": "revenue_amount", "transaction_status": "order_status", "transaction_date": "order_date",
     "customer_ref": "customer_ref", "order_ref": "order_ref", "payment_channel": "payment_channel"},
    {"completed_values": ("delivered",), "cancelled_values": ("cancelled",), "returned_values": ("returned",)},
)
LINE = K.Bindings(
    {"revenue_amount": "l_extendedprice", "transaction_status": "l_returnflag", "transaction_date": "l_shipdate",
     "repeat_flag": "l_returnflag", "customer_ref": "l_orderkey", "partner_name": "l_returnflag",
     "product_name": "l_linestatus"},
    {"completed_values": ("A", "R"), "repeat_values": ("R",)},
)
ORDER = K.Bindings({"measure_amount": "o_totalprice", "category_dim": "o_orderpriority", "date_dim": "o_orderdate"})
RETAIL, HEALTH, GENERIC = "retail-ecommerce", "healthcare-diagnostics", "generic-analytics"
SALES_SQL = SOURCES["sales"]


def _kpi(name: str, sql: str, table: str, pack: str, kpi: str, bindings: K.Bindings, *rounded: str) -> None:
    @query(name, sql)
    def _(spark, sf_dir):
        fact = derive(spark, sf_dir, table).table(table)
        found = K.build_kpi(fact, K.find_kpi(pack, kpi), bindings)
        return found.select(*[F.round(c, 2).alias(c) if c in rounded else c for c in found.columns])


_kpi("kpi_total_records", "SELECT count(*) AS total_records FROM orders", "orders", GENERIC, "total_records", ORDER)
_kpi("kpi_total_revenue",
     f"SELECT round(sum(revenue_amount), 2) AS total_revenue, count(*) AS completed_orders FROM {SALES_SQL} WHERE order_status IN ('delivered')",
     "sales", RETAIL, "total_revenue", SALE, "total_revenue")
_kpi("kpi_sum_measure", "SELECT round(sum(o_totalprice), 2) AS total FROM orders", "orders", GENERIC, "sum_measure", ORDER, "total")
_kpi("kpi_average_order_value",
     f"SELECT round(avg(revenue_amount), 2) AS average_order_value, count(*) AS completed_orders FROM {SALES_SQL} WHERE order_status IN ('delivered')",
     "sales", RETAIL, "average_order_value", SALE)
_kpi("kpi_average_measure", "SELECT round(avg(o_totalprice), 2) AS average FROM orders", "orders", GENERIC, "average_measure", ORDER)
_kpi("kpi_rate",
     "SELECT round(100.0 * sum(CASE WHEN l_returnflag IN ('R') THEN 1 ELSE 0 END) / count(*), 2) AS repeat_percent, "
     "CAST(sum(CASE WHEN l_returnflag IN ('R') THEN 1 ELSE 0 END) AS BIGINT) AS repeat_bookings, count(*) AS total_bookings FROM lineitem",
     "lineitem", HEALTH, "repeat_customer_rate", LINE)
_kpi("kpi_repeat_customers", "SELECT count(DISTINCT l_orderkey) AS repeat_customers FROM lineitem WHERE l_returnflag = 'R'",
     "lineitem", HEALTH, "number_of_repeat_customers", LINE)
_kpi("kpi_count_by_category", "SELECT o_orderpriority AS category, count(*) AS record_count FROM orders GROUP BY 1",
     "orders", GENERIC, "count_by_category", ORDER)
_kpi("kpi_revenue_by_dim",
     f"SELECT payment_channel, count(*) AS order_count, round(sum(revenue_amount), 2) AS revenue FROM {SALES_SQL} GROUP BY 1",
     "sales", RETAIL, "orders_by_payment_channel", SALE, "revenue")
_kpi("kpi_revenue_by_two_dims",
     "SELECT l_returnflag AS partner, l_linestatus AS product, round(sum(l_extendedprice), 2) AS revenue, count(*) AS booking_count "
     "FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2",
     "lineitem", HEALTH, "revenue_by_partner_and_product", LINE, "revenue")
_kpi("kpi_monthly_revenue",
     f"SELECT strftime(order_date, '%Y-%m') AS month, round(sum(revenue_amount), 2) AS revenue, count(*) AS order_count FROM {SALES_SQL} "
     "WHERE order_status IN ('delivered') GROUP BY 1",
     "sales", RETAIL, "monthly_revenue_trend", SALE, "revenue")
_kpi("kpi_monthly_count",
     "SELECT strftime(o_orderdate, '%Y-%m') AS month, round(sum(o_totalprice), 2) AS total, count(*) AS record_count FROM orders GROUP BY 1",
     "orders", GENERIC, "trend_by_month", ORDER, "total")

RETAIL_KPIS = K.pack_kpis(RETAIL)

# Every pack over the same facts, so that each of the thirty KPIs has its roles.
EVERY_ROLE = K.Bindings(
    {**SALE.columns, "score": "revenue_amount", "course_ref": "payment_channel", "transaction_type": "payment_channel",
     "measure_amount": "revenue_amount", "category_dim": "order_status", "date_dim": "order_date", "location": "payment_channel",
     "repeat_flag": "order_status", "partner_name": "order_status", "product_name": "payment_channel"},
    {**SALE.value_sets, "repeat_values": ("returned", "cancelled")},
)
PACKS = tuple(dict.fromkeys(k.pack for k in K.KPIS))


def _kpi_rows_sql(kpi: K.Kpi) -> str:
    """A KPI over ``s`` in SQL, one SELECT for each of its outputs."""
    bound = EVERY_ROLE

    def has(role: str, value_set: str) -> str:
        return f"{bound.columns[role]} IN ({words(bound.value_sets[value_set])})"

    def value(out: K.Output) -> str:
        name = bound.columns.get(out.role)
        share = f"count(*) FILTER (WHERE {has(out.role, out.value_set)})" if out.value_set else ""
        return {
            "rows": "count(*)", "percent": f"round(100.0 * {share} / count(*), 2)", "hits": share, "sum": f"sum({name})",
            "average": f"round(avg({name}), 2)", "filled": f"count({name})", "distinct": f"count(DISTINCT {name})",
        }[out.op]

    keys = [f"CAST({bound.columns[role]} AS VARCHAR)" for _, role in kpi.by]
    if kpi.by_month:
        keys = [f"strftime({bound.columns[kpi.by_month]}, '%Y-%m')"]
    key = f"concat_ws(' | ', {', '.join(keys)})" if keys else "NULL"
    rest = (f" WHERE {has(*kpi.where)}" if kpi.where else "") + (f" GROUP BY {', '.join(keys)}" if keys else "")
    return " UNION ALL ".join(
        f"SELECT '{kpi.pack}' AS pack, '{kpi.id}' AS kpi_id, {key} AS group_key, '{o.name}' AS measure, "
        f"round(CAST({value(o)} AS DOUBLE), 2) AS value FROM s{rest}"
        for o in kpi.outputs
    )


@query("kpi_all_packs", f"WITH s AS {SALES_SQL} " + " UNION ALL ".join(map(_kpi_rows_sql, K.KPIS)))
def _(spark, sf_dir):
    found = K.pack_sheet(_sales(spark, sf_dir), [(K.pack_kpis(p), EVERY_ROLE) for p in PACKS])
    return found.withColumn("value", F.round("value", 2))



def _sales(spark, sf_dir) -> DataFrame:
    return derive(spark, sf_dir, "sales").table("sales")


def _rate_sql(kpi: str, prefix: str, value: str) -> str:
    percent = f"round(100.0 * count(*) FILTER (WHERE order_status = '{value}') / count(*), 2)"
    return (f"SELECT '{kpi}' AS kpi_id, NULL AS group_key, '{prefix}_percent' AS measure, {percent} AS value FROM s "
            f"UNION ALL SELECT '{kpi}', NULL, 'total_orders', count(*) FROM s")


SHEET_SQL = f"WITH s AS {SALES_SQL} " + " UNION ALL ".join([
    _rate_sql("cancellation_rate", "cancellation", "cancelled"),
    _rate_sql("return_rate", "return", "returned"),
    "SELECT 'total_revenue', NULL, 'total_revenue', round(sum(revenue_amount), 2) FROM s WHERE order_status = 'delivered'",
    "SELECT 'total_revenue', NULL, 'completed_orders', count(*) FROM s WHERE order_status = 'delivered'",
    "SELECT 'average_order_value', NULL, 'average_order_value', round(avg(revenue_amount), 2) FROM s WHERE order_status = 'delivered'",
    "SELECT 'average_order_value', NULL, 'completed_orders', count(*) FROM s WHERE order_status = 'delivered'",
    "SELECT 'orders_by_payment_channel', payment_channel, 'order_count', count(*) FROM s GROUP BY 2",
    "SELECT 'orders_by_payment_channel', payment_channel, 'revenue', round(sum(revenue_amount), 2) FROM s GROUP BY 2",
    "SELECT 'monthly_revenue_trend', strftime(order_date, '%Y-%m'), 'revenue', round(sum(revenue_amount), 2) FROM s WHERE order_status = 'delivered' GROUP BY 2",
    "SELECT 'monthly_revenue_trend', strftime(order_date, '%Y-%m'), 'order_count', count(*) FROM s WHERE order_status = 'delivered' GROUP BY 2",
])


@query("kpi_sheet", SHEET_SQL)
def _(spark, sf_dir):
    sheet = K.kpi_sheet(_sales(spark, sf_dir), RETAIL_KPIS, SALE)
    return sheet.withColumn("value", F.round("value", 2))


_RETAIL_CHECKS = {
    "cancellation_rate": ("cancellation_percent", "count(*) FILTER (WHERE order_status = 'cancelled') * 100.0 / count(*)"),
    "return_rate": ("return_percent", "count(*) FILTER (WHERE order_status = 'returned') * 100.0 / count(*)"),
}


@query("kpi_assertions", f"WITH s AS {SALES_SQL} " + " UNION ALL ".join(
    [f"SELECT '{kpi}' AS kpi_id, '{name} {op} {bound}' AS assertion, {value} {op} {bound} AS passed FROM s"
     for kpi, (name, value) in _RETAIL_CHECKS.items() for op, bound in ((">=", 0), ("<=", 100))]
    + ["SELECT 'total_revenue', 'total_revenue >= 0', sum(revenue_amount) FILTER (WHERE order_status = 'delivered') >= 0 FROM s",
       "SELECT 'average_order_value', 'average_order_value >= 0', avg(revenue_amount) FILTER (WHERE order_status = 'delivered') >= 0 FROM s"]))
def _(spark, sf_dir):
    return K.kpi_assertions(_sales(spark, sf_dir), RETAIL_KPIS, SALE)


# One more KPI, whose assertion the data contradicts, shows what a failure looks like.
STRICT = K.Kpi("all_delivered", RETAIL, (K.Output("completion_percent", "percent", "transaction_status", "completed_values"),),
               ("transaction_status",), checks=((">=", "completion_percent", 100),))


@query("kpi_dry_run",
       f"SELECT 'all_delivered' AS kpi_id, 'failed assertion: completion_percent >= 100' AS issue FROM {SALES_SQL} "
       "HAVING count(*) FILTER (WHERE order_status = 'delivered') < count(*) "
       "UNION ALL SELECT 'revenue_by_location', 'unresolved roles: location'")
def _(spark, sf_dir):
    return K.kpi_dry_run(_sales(spark, sf_dir), (*RETAIL_KPIS, STRICT), SALE)


@query("kpi_snapshot")
def _(spark, sf_dir):
    return K.kpi_snapshot(_sales(spark, sf_dir), RETAIL_KPIS, SALE)
