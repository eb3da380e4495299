"""Redacted export, warehouse schemas and normalised results."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakegauge.dataset import Dataset, column
from lakegauge.functions.storage import shared_folder

_RUN_ID = re.compile(r"[a-z0-9]{1,32}")
LABEL_CHARS = 20


def redacted_export(ds: Dataset, denied: Mapping[str, Iterable[str]], folder: str, fmt: str = "parquet") -> dict[str, str]:
    """Write every table without its denied columns; returns the paths.

    JSON is written as one object per line, in part files.
    """
    paths = {}
    for name, df in ds.without(denied).tables.items():
        path = f"{folder.rstrip('/')}/{name}.{'ndjson' if fmt == 'json' else fmt}"
        writer = df.write.mode("errorifexists")
        if fmt in ("csv", "tsv"):
            writer.options(header=True, sep="\t" if fmt == "tsv" else ",", escape='"').csv(path)
        elif fmt in ("json", "ndjson"):
            writer.option("ignoreNullFields", False).json(path)
        elif fmt == "parquet":
            writer.parquet(path)
        else:
            raise ValueError(f"no writer for format {fmt!r}")
        paths[name] = path
    return paths


def schema_name(run_id: str, label: str | None = None, label_chars: int = LABEL_CHARS) -> str:
    """``client_<label>_<run>``; anything unusual in the run id is refused.

    Of the label's letters and digits the first ``label_chars`` characters stay;
    the run id alone tells databases apart.
    """
    if not _RUN_ID.fullmatch(run_id):
        raise ValueError(f"run id {run_id!r} is not 1 to 32 lower-case letters or digits")
    slug = re.sub(r"[^a-z0-9]+", "_", (label or "").lower()).strip("_")[:label_chars].strip("_")
    return f"client_{slug}_{run_id}" if slug else f"client_{run_id}"


def warehouse_load(ds: Dataset, run_id: str, label: str | None = None, label_chars: int = LABEL_CHARS) -> str:
    """Save every table into a database of the client's own; returns its name."""
    name = schema_name(run_id, label, label_chars)
    spark = ds.spark
    location = f"{shared_folder(spark).rstrip('/')}/{name}"
    spark.sql(f"CREATE DATABASE `{name}` LOCATION '{location}'")
    for table, df in ds.tables.items():
        df.write.saveAsTable(f"`{name}`.`{table}`")
    return name


def warehouse_drop(spark: SparkSession, run_id: str, label: str | None = None, label_chars: int = LABEL_CHARS) -> None:
    """Drop the client's database with everything in it."""
    spark.sql(f"DROP DATABASE IF EXISTS `{schema_name(run_id, label, label_chars)}` CASCADE")


def normalize_rows(df: DataFrame) -> DataFrame:
    """Turn not-a-number into null in every floating column."""
    return df.select(
        *[
            F.when(~F.isnan(column(f.name)), column(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.FloatType, T.DoubleType))
            else column(f.name)
            for f in df.schema.fields
        ]
    )


def json_rows(df: DataFrame) -> DataFrame:
    """Result rows as JSON objects that keep their null fields."""
    return normalize_rows(df).select(
        F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row")
    )
