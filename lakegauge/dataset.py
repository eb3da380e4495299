"""A named set of tables and its column catalogue."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lakegauge.functions.types import COMPLEX, family, join_family


@dataclass(frozen=True)
class ColumnInfo:
    column_id: int
    table: str
    column: str
    ordinal: int
    dtype: str
    family: str
    join_family: str


@dataclass(frozen=True)
class DeclaredKey:
    """A foreign key stated by the source's own schema."""

    from_table: str
    from_column: str
    to_table: str
    to_column: str


@dataclass(frozen=True)
class Dataset:
    """Lazy DataFrames by table name; nothing is read until a query runs."""

    tables: Mapping[str, DataFrame]
    declared_keys: tuple[DeclaredKey, ...] = ()
    kind: str = "parquet"
    _names: tuple[str, ...] = field(init=False, repr=False, default=())

    def __post_init__(self) -> None:
        if not self.tables:
            raise ValueError("a dataset needs at least one table")
        object.__setattr__(self, "_names", tuple(sorted(self.tables)))

    @property
    def names(self) -> tuple[str, ...]:
        return self._names

    @property
    def spark(self) -> SparkSession:
        return self.tables[self._names[0]].sparkSession

    def table(self, name: str) -> DataFrame:
        try:
            return self.tables[name]
        except KeyError:
            raise ValueError(f"unknown table {name!r}; tables: {list(self._names)}") from None

    def only(self, names: Iterable[str]) -> Dataset:
        kept = {name: self.table(name) for name in names}
        keys = tuple(k for k in self.declared_keys if k.from_table in kept and k.to_table in kept)
        return Dataset(kept, keys, self.kind)

    def without(self, denied: Mapping[str, Iterable[str]]) -> Dataset:
        """The same tables with the denied columns dropped."""
        kept = {name: df.drop(*denied.get(name, ())) for name, df in self.tables.items()}
        return Dataset(kept, self.declared_keys, self.kind)

    @cached_property
    def columns(self) -> tuple[ColumnInfo, ...]:
        """Every scalar column, numbered; nested and binary columns are left out."""
        found = []
        for table in self._names:
            for ordinal, item in enumerate(self.tables[table].schema.fields):
                if family(item.dataType) != COMPLEX:
                    found.append(
                        ColumnInfo(
                            len(found),
                            table,
                            item.name,
                            ordinal,
                            item.dataType.simpleString(),
                            family(item.dataType),
                            join_family(item.dataType),
                        )
                    )
        return tuple(found)

    @cached_property
    def catalog(self) -> DataFrame:
        """The column catalogue as a DataFrame: one row per scalar column."""
        return constant_rows(
            self.spark,
            [tuple(vars(c).values()) for c in self.columns],
            "column_id int, table string, column string, ordinal int, dtype string, "
            "family string, join_family string",
        )


def constant_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few driver-held rows as a local relation, which needs no job to read."""
    fields = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(fields)
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    table = pa.Table.from_arrays(
        [pa.array(list(values), type=f.type) for values, f in zip(columns, arrow)], schema=arrow
    )
    return spark.createDataFrame(table, schema=fields)


def quoted(name: str) -> str:
    """A column name as one identifier, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str):
    return F.col(quoted(name))
