"""Every registered query runs, and matches its oracle, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of
from lakegauge import registry

SF = "/root/testdata/sf0.001"
# at this scale some measures are unique and so are no measures
SCALE_BOUND = {"insight_trend", "insight_distribution", "insight_ranking", "insight_top_n"}
SAMPLE = [
    "metric_by_dim_time", "metric_two_hop", "agg_median", "filter_not_in", "metric_sheet", "kpi_sheet", "kpi_dry_run",
    "profile_null_distinct", "profile_quartiles", "top_values", "identifier_winner", "fk_exact_name", "temporal_gaps",
    "q_mixed_types", "describe_tables", "src_csv", "guarded_sql", "gate_value_set", "pii_text_scan", "eval_summary", "recent_top_n",
]


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) - set(registry.ORACLE) == {"data_map", "kpi_snapshot", "source_fingerprint"}


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = entry.queries()[name](spark, SF)
    cursor = con.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in cursor.description], cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
