"""Reading files and directories as lazy tables, and describing them."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakegauge.dataset import Dataset, constant_rows

FORMATS = {
    ".csv": "csv",
    ".tsv": "tsv",
    ".json": "json",
    ".ndjson": "ndjson",
    ".jsonl": "ndjson",
    ".parquet": "parquet",
}


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    schema: T.StructType | None = None,
    quoted_line_breaks: bool = False,
) -> DataFrame:
    """One file, or a directory of part files of one format, as a DataFrame.

    Text formats are sniffed unless a schema is given; state it for large
    inputs, as sniffing reads the data once more.  With ``quoted_line_breaks``
    a CSV value may hold line breaks, and a file is one task; without, Spark
    splits it.
    """
    fmt = fmt or FORMATS.get(_extension(path))
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if fmt in ("csv", "tsv"):
        options = {"header": True, "sep": "\t" if fmt == "tsv" else ",", "inferSchema": schema is None,
                   "multiLine": quoted_line_breaks, "escape": '"'}
        return reader.options(**options).csv(path)
    if fmt in ("json", "ndjson"):
        return reader.option("multiLine", fmt == "json" and _is_json_array(spark, path)).json(path)
    if fmt == "parquet":
        return reader.parquet(path)
    raise ValueError(f"no reader for {path!r}; extensions: {sorted(FORMATS)}")


def _is_json_array(spark: SparkSession, path: str) -> bool:
    """Whether a ``.json`` file is one array rather than an object per line."""
    first = spark.read.text(path).where("trim(value) <> ''").first()
    return first is not None and first["value"].lstrip().startswith("[")


def _extension(path: str) -> str:
    match = re.search(r"\.[A-Za-z0-9]+$", path.rstrip("/"))
    return match.group(0).lower() if match else ""


def table_name(stem: str) -> str:
    """A file's stem as a table name: lower case, no signs, not a digit first."""
    name = re.sub(r"\W", "_", stem.strip().lower()).strip("_") or "table"
    return f"t_{name}" if name[0].isdigit() else name


def load_dataset(
    spark: SparkSession, path: str, names: Iterable[str] | None = None, quoted_line_breaks: bool = False
) -> Dataset:
    """A file as one table, or a directory as one table per readable entry.

    The listing goes through the cluster's file system; nothing is read yet.
    """
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.getFileStatus(root).isFile() or _extension(path) in FORMATS:
        found = [path]
    else:
        found = sorted(str(s.getPath().toString()) for s in system.listStatus(root))
    tables: dict[str, DataFrame] = {}
    for item in found:
        leaf = item.rstrip("/").rsplit("/", 1)[-1]
        extension = _extension(leaf)
        if extension not in FORMATS:
            continue
        name = table_name(leaf[: -len(extension)])
        if names is None or name in names:
            tables[name] = read_table(spark, item, quoted_line_breaks=quoted_line_breaks)
    if not tables:
        raise ValueError(f"no readable files in {path}; extensions: {sorted(FORMATS)}")
    kinds = {FORMATS[_extension(i)] for i in found if _extension(i) in FORMATS}
    return Dataset(tables, kind=kinds.pop() if len(kinds) == 1 else "mixed")


def row_counts(ds: Dataset) -> DataFrame:
    """``table, row_count`` of every table, as one job."""
    counts = [
        ds.tables[name].agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table"), "row_count")
        for name in ds.names
    ]
    return reduce(DataFrame.unionByName, counts)


def describe_tables(ds: Dataset) -> DataFrame:
    """Column names, types, positions and row counts of every table."""
    every = [
        (name, f.name, i, f.dataType.simpleString())
        for name in ds.names
        for i, f in enumerate(ds.tables[name].schema.fields)
    ]
    columns = constant_rows(ds.spark, every, "table string, column string, ordinal int, dtype string")
    return columns.join(row_counts(ds), "table")


def source_fingerprint(ds: Dataset) -> DataFrame:
    """One row whose 16 hex digits change with tables, columns or row counts."""
    described = describe_tables(ds).groupBy("table", "row_count").agg(
        F.sort_array(F.collect_list("column")).alias("columns")
    )
    payload = F.struct(
        F.sort_array(F.collect_list(F.struct("table", "row_count", "columns"))).alias("tables"),
        F.lit(ds.kind).alias("kind"),
    )
    return described.agg(F.substring(F.sha2(F.to_json(payload), 256), 1, 16).alias("fingerprint"))
