"""What the operators share: written intermediate tables, connected components, runs of sorted rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import nullcontext
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakegauge.functions.storage import conf_set, shuffles_freed  # noqa: F401  (conf_set is for the operators)

#: Characters that separate words where a contract says ``[^\\x20\\x09-\\x0D]+``.
WORD = "[^\\x20\\x09-\\x0D]+"


def findable(spark: SparkSession) -> None:
    """Python workers of this session look for the package where the driver found it, too."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    findable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder in the session's warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (folder or spark.conf.get("spark.sql.warehouse.dir") + "/_shared").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(df: DataFrame, name: str = "table", free: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and return what was written: later steps survive lost executors.

    ``free`` gives the shuffle files of the writing back at its end.
    """
    path = new_path(df.sparkSession, name)
    with shuffles_freed(df.sparkSession) if free else nullcontext():
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def erased(*tables: DataFrame) -> None:
    """Delete ``written`` tables that nothing will read again; only files in the shared folder's own tables go."""
    for table in tables:
        spark = table.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def constant(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_bucket(id_column: Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``."""
    return F.crc32(id_column.cast("string").cast("binary")) % buckets


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Connected components of undirected ``edges``: rows (node, component), component the smallest node.

    Alternates large-star and small-star steps; each step sends a node's
    neighbours to its smallest one, with partial aggregation before the shuffle,
    so that a hub costs a row per task.  Each round is written to the shared
    folder.  Edges with a null end are ignored; an empty table gives no rows.
    """
    now = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null and u <> v")
    now = written(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v")))
        now = written(small.distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def flat_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Connected components of undirected ``edges``: written rows (node, component), component the smallest node.

    In a round each node takes its smallest neighbour's name, if that is smaller,
    and then the name that this one has taken; edges whose ends now have one name
    go, and the others join names, so that two rounds halve the nodes at least.
    Names are joined to edges and names from written tables, so that the rows of
    a hub, or of a large component, may be dealt to several tasks; smallest names
    are gathered in each task first.
    """
    ends = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v")
    now = written(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "ends", free=True)
    rounds: list[DataFrame] = []
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label"))
        near = written(near, "lower", free=True)
        named = near.select(F.col("node").alias("label"), F.col("label").alias("next"))
        rounds.append(written(near.join(named, "label").select("node", F.col("next").alias("label")), "labels", free=True))
        then = now.join(rounds[-1].toDF("u", "x"), "u").join(rounds[-1].toDF("v", "y"), "v").where("x <> y")
        then = written(then.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "ends", free=True)
        erased(now, near)
        now = then
        if now.isEmpty():
            break
    out = rounds[0]
    for later in rounds[1:]:
        out = out.join(later.toDF("label", "next"), "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    out = written(out.select("node", F.col("label").alias("component")), "components", free=True)
    erased(now, *rounds)
    return out


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Regroup sorted batches into tables that end at a change of the integer ``keys``."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        table = table.combine_chunks()
        n = table.num_rows
        if not n:
            continue
        cut = 0
        for key in keys:
            values = table.column(key).to_numpy()
            same = np.flatnonzero(values != values[-1])
            cut = max(cut, int(same[-1]) + 1 if len(same) else 0)
        rest = table.slice(cut)
        if cut:
            yield table.slice(0, cut)
    if rest is not None and rest.num_rows:
        yield rest


def run_bounds(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, and the number of rows at the end."""
    n = len(keys[0])
    change = np.zeros(n + 1, bool)
    change[0] = change[n] = True
    for key in keys:
        change[1:n] |= key[1:] != key[:-1]
    return np.flatnonzero(change)
