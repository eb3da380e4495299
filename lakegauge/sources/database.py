"""Tables of a live database over JDBC, read in parallel partitions."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession

from lakegauge.dataset import Dataset, DeclaredKey, quoted

FETCH_SIZE = 10_000

_TABLE_LISTS = {
    "postgresql": "select table_name as name from information_schema.tables "
    "where table_schema = '{schema}' and table_type = 'BASE TABLE'",
    "sqlite": "select name from sqlite_master where type = 'table' and name not like 'sqlite_%'",
}
_KEY_LISTS = {
    "postgresql": "select c.table_name as from_table, c.column_name as from_column, "
    "p.table_name as to_table, p.column_name as to_column "
    "from information_schema.referential_constraints r "
    "join information_schema.key_column_usage c on c.constraint_name = r.constraint_name "
    "and c.constraint_schema = r.constraint_schema "
    "join information_schema.key_column_usage p on p.constraint_name = r.unique_constraint_name "
    "and p.constraint_schema = r.unique_constraint_schema and p.ordinal_position = c.position_in_unique_constraint "
    "where c.constraint_schema = '{schema}'",
    "sqlite": "select m.name as from_table, k.\"from\" as from_column, k.\"table\" as to_table, "
    "coalesce(k.\"to\", k.\"from\") as to_column "
    "from sqlite_master m join pragma_foreign_key_list(m.name) k on m.type = 'table'",
}


def resolve_secrets(url: str) -> str:
    """Replace ``${NAME}`` by environment variables, the only place for credentials."""

    def value(match: re.Match) -> str:
        name = match.group(1)
        if name not in os.environ:
            raise ValueError(f"environment variable {name} is not set")
        return os.environ[name]

    return re.sub(r"\$\{(\w+)\}", value, url)


def dialect_of(url: str) -> str:
    match = re.match(r"jdbc:(\w+):", url)
    if not match or match.group(1) not in _TABLE_LISTS:
        raise ValueError(f"no catalogue query for {url.split('?')[0]!r}")
    return match.group(1)


def schema_of(url: str) -> str:
    """The schema named by the URL's search path, else ``public``."""
    query = parse_qs(urlsplit(url.removeprefix("jdbc:")).query)
    for key in ("currentSchema", "search_path"):
        if query.get(key):
            return _plain(query[key][0].split(",")[0])
    options = query.get("options", [""])[0]
    match = re.search(r"search_path=([^,\s]+)", options)
    return _plain(match.group(1)) if match else "public"


def _plain(name: str) -> str:
    if not re.fullmatch(r"\w+", name):
        raise ValueError(f"not a plain schema name: {name!r}")
    return name


def partition_options(lower, upper, column: str, partitions: int) -> dict[str, str]:
    """Reader options that split a table's range into parallel queries."""
    if lower is None or upper is None or lower == upper or partitions < 2:
        return {}
    return {
        "partitionColumn": column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
    }


def read_query(spark: SparkSession, url: str, query: str, options: Mapping[str, str]) -> DataFrame:
    reader = spark.read.format("jdbc").options(url=url, query=query, **options)
    return reader.option("fetchsize", FETCH_SIZE).load()


def read_database(
    spark: SparkSession,
    url: str,
    partition_by: Mapping[str, str] | None = None,
    partitions: int = 64,
    options: Mapping[str, str] | None = None,
) -> Dataset:
    """Every table of the schema; ``partition_by`` names a numeric column to split on."""
    dialect, schema = dialect_of(url), schema_of(url)
    secret = resolve_secrets(url)
    options = dict(options or {})
    listing = read_query(spark, secret, _TABLE_LISTS[dialect].format(schema=schema), options)
    names = sorted(r["name"] for r in listing.collect())
    tables = {}
    for name in names:
        full = f'"{schema}"."{name}"' if dialect == "postgresql" else f'"{name}"'
        split = (partition_by or {}).get(name)
        extra: dict[str, str] = {}
        if split:
            bounds = f'select min("{split}") as low, max("{split}") as high from {full}'
            low, high = read_query(spark, secret, bounds, options).first()
            extra = partition_options(low, high, split, partitions)
        reader = spark.read.format("jdbc").options(url=secret, dbtable=full, **options, **extra)
        tables[name] = reader.option("fetchsize", FETCH_SIZE).load()
    keys = read_query(spark, secret, _KEY_LISTS[dialect].format(schema=schema), options).collect()
    declared = tuple(
        DeclaredKey(**k.asDict()) for k in keys if k["from_table"] in tables and k["to_table"] in tables
    )
    return Dataset(tables, declared, kind=dialect)


def write_redacted_database(ds: Dataset, denied: Mapping[str, set[str]], url: str, options: Mapping[str, str] | None = None) -> None:
    """Copy every table without its denied columns into a database."""
    secret = resolve_secrets(url)
    for name, df in ds.without(denied).tables.items():
        writer = df.write.format("jdbc").options(url=secret, dbtable=name, **(options or {}))
        writer.mode("overwrite").save()
