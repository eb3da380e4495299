"""Tables derived from the given ones, by the same SQL text in both engines.

The given tables have no nulls, no personal columns and clean categories, so
the derived ones add what the profile and quality rules look for.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from lakegauge.dataset import Dataset
from lakegauge.registry.base import SCHEMAS, table

SQL = {
    "contacts": (
        "customer",
        "SELECT c_custkey AS customer_id, c_name AS customer_name, "
        "concat('+91 98', lpad(CAST(c_custkey AS STRING), 8, '0')) AS phone, "
        "c_acctbal AS balance, c_mktsegment AS segment, "
        "CASE WHEN c_acctbal < 0 THEN 'yes' ELSE 'no' END AS overdue_flag, "
        "concat('$', CAST(c_nationkey AS STRING)) AS plan_fee, "
        "concat('2024-01-', lpad(CAST(c_nationkey + 1 AS STRING), 2, '0')) AS joined_on, "
        "concat(substr(md5(c_name), 1, 8), '-', substr(md5(c_name), 9, 4), '-', substr(md5(c_name), 13, 4), "
        "'-', substr(md5(c_name), 17, 4), '-', substr(md5(c_name), 21, 12)) AS token, "
        "1700000000 + c_custkey AS created, "
        "concat('https://example.com/c/', CAST(c_custkey AS STRING)) AS link, "
        "CASE WHEN c_nationkey < 15 THEN NULL ELSE c_mktsegment END AS referral_status "
        "FROM customer",
        "customer_id bigint, customer_name string, phone string, balance double, segment string, "
        "overdue_flag string, plan_fee string, joined_on string, token string, created bigint, link string, "
        "referral_status string",
    ),
    "leads": (
        "events",
        "SELECT event_id AS lead_id, "
        "CASE WHEN value < 80 THEN 'unclear' WHEN value < 120 THEN 'favorable' ELSE 'unfavorable' END AS outcome, "
        "CASE WHEN user_id % 3 = 0 THEN upper(event_type) WHEN user_id % 3 = 1 THEN concat(' ', event_type) "
        "ELSE event_type END AS channel, "
        "CASE WHEN user_id % 5 = 0 THEN CAST(user_id % 7 AS STRING) ELSE event_type END AS age_group, "
        "CASE WHEN user_id % 10 < 6 THEN NULL ELSE 'neutral' END AS sentiment, "
        "CASE WHEN user_id % 20 = 0 THEN 'camp-pilot' ELSE 'camp-main' END AS campaign_id, "
        "'active' AS status_flag FROM events",
        "lead_id bigint, outcome string, channel string, age_group string, sentiment string, "
        "campaign_id string, status_flag string",
    ),
    "offers": (
        "lineitem",
        "SELECT DISTINCT l_partkey AS part_key, l_suppkey AS supp_key FROM lineitem",
        "part_key bigint, supp_key bigint",
    ),
    "order_days": (
        "orders",
        "SELECT o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS order_day, o_totalprice AS order_total "
        "FROM orders WHERE month(o_orderdate) <> 3",
        "order_id bigint, order_day date, order_total double",
    ),
    "solvent": (
        "customer",
        "SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 0",
        "c_custkey bigint, c_nationkey int",
    ),
    "sales": (
        "orders",
        "SELECT o_orderkey AS order_ref, o_custkey AS customer_ref, o_totalprice AS revenue_amount, "
        "CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'P' THEN 'cancelled' ELSE 'returned' END AS order_status, "
        "o_orderdate AS order_date, o_orderpriority AS payment_channel FROM orders",
        "order_ref bigint, customer_ref bigint, revenue_amount double, order_status string, "
        "order_date timestamp_ntz, payment_channel string",
    ),
}

ALL_SCHEMAS = {**SCHEMAS, **{name: schema for name, (_, _, schema) in SQL.items()}}
SOURCES = {name: f"({sql})" for name, (_, sql, _) in SQL.items()}


def derive(spark: SparkSession, sf_dir: str, *names: str) -> Dataset:
    """A dataset of given and derived tables."""
    tables = {}
    for name in names:
        if name in SQL:
            base, sql, _ = SQL[name]
            tables[name] = spark.sql(sql.replace(f" FROM {base}", f" FROM {{{base}}}"), **{base: table(spark, sf_dir, base)})
        else:
            tables[name] = table(spark, sf_dir, name)
    return Dataset(tables)
