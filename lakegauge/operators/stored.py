"""Profiles kept between sessions: tables whose rows have not changed are not profiled again."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakegauge.dataset import Dataset, column
from lakegauge.functions.storage import cut
from lakegauge.operators.profile import structural_columns

#: Hex digits of a row's digest that are summed up: 60 bits.
ROW_DIGITS = 15


def table_digests(ds: Dataset) -> DataFrame:
    """``table, row_count, digest`` of every table from one scan each, whatever the order of rows and files.

    A row's MD5 is taken over its scalar columns in order, a null marked apart
    from every text; the digests are added, so that tasks send one number each
    and repeated rows count.  An empty table has the digest zero.
    """
    parts = []
    for name in ds.names:
        own = [column(c.column) for c in ds.columns if c.table == name]
        cells = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in own]
        number = F.conv(F.substring(F.md5(F.concat_ws("\x1f", *cells)), 1, ROW_DIGITS), 16, 10).cast("decimal(20,0)")
        rows = ds.tables[name].agg(F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum(number), F.lit(0)).cast("decimal(38,0)").alias("digest"))
        parts.append(rows.select(F.lit(name).alias("table"), "row_count", F.col("digest").cast("string").alias("digest")))
    return reduce(DataFrame.unionByName, parts)


class ProfileStore:
    """Column profiles in a shared folder, a part per table, named after the table's columns and digest."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def _path(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _parts(self, table: str) -> set[str]:
        """Parts of a table that were written to their end."""
        system, root = self._path(f"{self.folder}/{table}")
        if not system.exists(root):
            return set()
        names = [s.getPath().getName() for s in system.listStatus(root)]
        return {n for n in names if system.exists(self._path(f"{self.folder}/{table}/{n}/_SUCCESS")[1])}

    def part_names(self, ds: Dataset, pii: bool = True) -> dict[str, str]:
        """The part that each table's profile has or would have; one row a table reaches the driver."""
        found = {}
        for row in table_digests(ds).collect():
            layout = [(c.column, c.dtype) for c in ds.columns if c.table == row["table"]]
            payload = repr((layout, row["row_count"], row["digest"], pii))
            found[row["table"]] = hashlib.sha256(payload.encode()).hexdigest()[:16]
        return found

    def columns(self, ds: Dataset, pii: bool = True) -> DataFrame:
        """The structural profile of every table; only new and changed tables are profiled, and old parts go.

        A part without its end mark, left by a run that was stopped, is written again.
        """
        wanted = self.part_names(ds, pii)
        kept = {table: self._parts(table) for table in wanted}
        changed = [table for table, part in wanted.items() if part not in kept[table]]
        if changed:
            fresh = cut(structural_columns(ds.only(changed), pii=pii).drop("column_id"), catalogue=True)
            for table in changed:
                own = fresh.where(F.col("table") == table)
                own.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{table}/{wanted[table]}")
        for table, part in wanted.items():
            for old in kept[table] - {part}:
                system, target = self._path(f"{self.folder}/{table}/{old}")
                system.delete(target, True)
        return self.spark.read.parquet(*[f"{self.folder}/{table}/{part}" for table, part in wanted.items()])
