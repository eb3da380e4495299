"""The value-frequency table: one shuffle from which most profile facts derive."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakegauge.dataset import ColumnInfo, Dataset, column, quoted
from lakegauge.functions.storage import estimated_bytes, shuffled
from lakegauge.functions.types import BOOLEAN, INTEGER, NUMERIC, TEMPORAL, TEXT

#: Bytes of a table in columnar files for each scan that counts some of its columns.
SCAN_BYTES = 50 << 20
#: Bytes of columnar files from which on the rows of a scan are dealt out, and for each task they are dealt to.
DEAL_FROM, DEAL_BYTES = 4 << 20, 256 << 10
#: Tasks up to which a shuffle writes rows as they come, without holding them; more are for 16 times the bytes.
MOST_DEALT = 200
#: Two to this power are the rows of a scan, next to each other, that go to one task together.
DEAL_BITS = 5
#: Parts that a frequency table is written in, where those of ``SCAN_BYTES`` would be more.
PARTS = 16
SLOTS = ("whole", "real", "text")


def _slots(info: ColumnInfo) -> list[str]:
    """The value in one of three typed slots: whole number, double or text.

    Grouping on native types keeps the formatting of numbers and timestamps
    out of the scan; only distinct values are turned into text, afterwards.
    Adding 0.0 makes the two floating zeros equal.
    """
    name = quoted(info.column)
    whole, real, text = "cast(null as bigint)", "cast(null as double)", "cast(null as string)"
    if info.family in (INTEGER, BOOLEAN):
        whole = f"cast({name} as bigint)"
    elif info.dtype == "double":
        real = f"{name} + 0.0D"
    elif info.dtype == "float":
        text = f"cast({name} + cast(0 as float) as string)"
    elif info.dtype == "date":
        whole = f"cast(unix_date({name}) as bigint)"
    elif info.family == TEMPORAL:
        whole = f"unix_micros(cast({name} as timestamp))"
    elif info.family == TEXT:
        text = name
    else:
        text = f"cast({name} as string)"
    return [whole, real, text]


def _columnar(df: DataFrame) -> bool:
    """Whether a table lies in columnar files, each of which may be one task as a whole; text files split anywhere."""
    files = df.inputFiles()
    return bool(files) and all(f.endswith((".parquet", ".orc")) for f in files)


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows of columnar files in tasks of about ``DEAL_BYTES``, whatever the size of the files' row groups.

    A task that counts values holds every different one it meets, so its memory
    grows with its rows.  They are dealt by their place in the scan: equal rows
    spread like any others.  Neighbours stay together, so that the place, which the
    shuffle writes with a row, and what neighbours share take little of its disk.
    What a shuffle has made is in tasks already, and its rows come in no fixed place.
    """
    size = estimated_bytes(rows)
    if size <= DEAL_FROM or shuffled(rows):
        return rows
    tasks = -(-size // DEAL_BYTES)
    return rows.repartition(max(min(tasks, MOST_DEALT), tasks // 16), F.shiftright(F.monotonically_increasing_id(), DEAL_BITS))


def _scans(ds: Dataset, pick, build, names: tuple[str, ...], apart: bool) -> Iterator[tuple[int, DataFrame]]:
    """The scans of ``stacked``, and what each reads in bytes of files, as estimated; rows that a shuffle makes are in one."""
    for table in ds.names:
        wanted = [c for c in ds.columns if c.table == table and pick(c)]
        rows, scans, deal = ds.tables[table], 1, apart and wanted and _columnar(ds.tables[table])
        if deal:
            scans = max(1, min(len(wanted), -(-estimated_bytes(rows) // SCAN_BYTES)))
        parts = []
        for own in (wanted[i::scans] for i in range(scans)):
            if own:
                cells = ", ".join(f"{c.column_id}, {', '.join(build(c))}" for c in own)
                part = _dealt(rows.select(*[column(c.column) for c in own])) if deal else rows
                parts.append(
                    part.selectExpr(f"stack({len(own)}, {cells}) as (column_id, {', '.join(names)})")
                )
        size = estimated_bytes(rows) if parts and rows.inputFiles() else 0
        if len(parts) > 1 and shuffled(rows):
            parts = [reduce(DataFrame.unionAll, parts)]
        yield from ((size // len(parts), part) for part in parts)


def stacked(ds: Dataset, pick, build, names: tuple[str, ...], apart: bool = False) -> DataFrame:
    """One output row per picked column of each input row, in a single scan.

    ``build`` gives the SQL expressions of one column's cells.  ``apart`` is for
    columnar files: it spreads the columns of large tables over several scans, each
    of its own columns, and deals out the rows of each, so that a task that counts
    values holds those of few columns and rows.
    """
    return reduce(DataFrame.unionAll, (part for _, part in _scans(ds, pick, build, names, apart)))


def _is_one_of(ids: list[int]) -> Column:
    return F.col("column_id").isin(ids) if ids else F.lit(False)


def value_frequency(ds: Dataset) -> DataFrame:
    """``(column_id, value, number, n)`` for every scalar column of every table.

    ``value`` is the text of the value, ``number`` its double for numeric
    columns.  The count is combined on the map side, so a value that fills a
    third of a column reaches the shuffle as one row per task, and a task counts
    the columns of one scan over the rows dealt to it.  Texts are counted as they are, at any length.
    """
    return _counted(ds, stacked(ds, lambda c: True, _slots, SLOTS, apart=True))


def frequency_parts(ds: Dataset) -> list[DataFrame]:
    """``value_frequency`` in parts, each of its own columns.

    A part reads one scan, or several of ``SCAN_BYTES`` or a ``PARTS``-th of the
    input together.  It shuffles the rows it deals and the values it counts, so that
    parts written one after the other need the disk of one part's shuffles at a time.
    """
    scans = list(_scans(ds, lambda c: True, _slots, SLOTS, apart=True))
    most = max(SCAN_BYTES, sum(size for size, _ in scans) // PARTS)
    parts: list[list[DataFrame]] = []
    held = 0
    for size, cells in scans:
        if parts and held + size <= most:
            parts[-1].append(cells)
            held += size
        else:
            parts.append([cells])
            held = size
    return [_counted(ds, reduce(DataFrame.unionAll, part)) for part in parts]


def _counted(ds: Dataset, cells: DataFrame) -> DataFrame:
    counted = cells.groupBy("column_id", *SLOTS).agg(
        F.count(F.lit(1)).alias("n")
    )
    ids = {
        kind: [c.column_id for c in ds.columns if test(c)]
        for kind, test in {
            "date": lambda c: c.dtype == "date",
            "moment": lambda c: c.family == TEMPORAL and c.dtype != "date",
            "flag": lambda c: c.family == BOOLEAN,
            "number": lambda c: c.family in NUMERIC,
        }.items()
    }
    whole_text = (
        F.when(_is_one_of(ids["date"]), F.date_from_unix_date(F.col("whole").cast("int")).cast("string"))
        .when(_is_one_of(ids["moment"]), F.timestamp_micros("whole").cast("string"))
        .when(_is_one_of(ids["flag"]), F.col("whole").cast("boolean").cast("string"))
        .otherwise(F.col("whole").cast("string"))
    )
    number = F.when(
        _is_one_of(ids["number"]),
        F.coalesce("real", F.col("whole").cast("double"), F.col("text").cast("double")),
    )
    return counted.select(
        "column_id",
        F.coalesce("text", F.col("real").cast("string"), whole_text).alias("value"),
        number.alias("number"),
        "n",
    )


def named(frequency: DataFrame, ds: Dataset) -> DataFrame:
    """Replace the column number by table and column name."""
    names = ds.catalog.select("column_id", "table", "column")
    return frequency.join(F.broadcast(names), "column_id").drop("column_id")
