"""Cutting lineage through the shared folder the cluster names.

Multi-step algorithms write an intermediate result once and read it back, so
that later steps neither repeat the work nor depend on executors that may be
lost.  The folder is the session's ``spark.checkpoint.dir``, or lies in the
session's warehouse where that is unset.  What is written is removed when the
application ends.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    return folder or spark.conf.get("spark.sql.warehouse.dir") + "/_shared"


def remove_at_end(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


def cut(df: DataFrame, catalogue: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table.

    ``catalogue`` marks results with a row per column, table or edge: they go
    into one file, so that reading them back takes one task.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    remove_at_end(spark, path)
    (df.repartition(1) if catalogue else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def conf_set(spark: SparkSession, setting: str, value: str) -> Iterator[None]:
    """The session's ``setting`` while queries are built and run inside."""
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)


def shuffles_freed(spark: SparkSession) -> AbstractContextManager:
    """Queries built and run inside give their shuffle files back as soon as they end, not when the driver forgets them."""
    return conf_set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def cut_parts(parts: list[DataFrame]) -> DataFrame:
    """``cut`` of the union of ``parts``, written one after the other; each gives its shuffle files back at its end."""
    spark = parts[0].sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    remove_at_end(spark, path)
    with shuffles_freed(spark):
        for part in parts:
            part.write.mode("append").parquet(path)
    return spark.read.schema(parts[0].schema).parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan, known before anything runs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def shuffled(df: DataFrame) -> bool:
    """Whether a shuffle makes the rows of a plan, known before anything runs."""
    return bool(re.search(r"(?<!Broadcast)Exchange\b", df._jdf.queryExecution().executedPlan().toString()))


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Catalyst's estimate is within the session's broadcast threshold."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return estimated_bytes(df) <= limit
