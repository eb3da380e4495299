"""Mixing sources to target weights, by repeating whole documents.

Sizes are summed by source; the sources' targets follow from their weights, and
a document's rate is its source's target over its source's size.  Each document
is taken floor(rate) times, and once more with a probability of the fraction
left, drawn from a hash of a seed and its id, so that reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lakegauge.llm.common import free_name, word_count, written

#: Weights of the sources in the order of their names (code points, null last), repeating.
WEIGHTS = (5, 2, 1)
#: A source gives at most so many times its size.
MOST_REPEATS = 3


def source_sizes(docs: DataFrame, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows (source, source_size): words by source, summed in each task before the shuffle."""
    sized = docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    return sized.groupBy("source").agg(F.sum("size").alias("source_size"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Rows (source, source_size, target) from (source, source_size).

    Every source has a share of all sizes by its weight.  A target stops at
    ``most`` times its source's size and the excess is shared again by weight,
    until none is above.  In the order of size over weight, the sources that stop
    are a prefix: those that still stop when all before them have.  The windows
    run over a row per source.  A source of size 0 has the target 0.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight.cast("long"))
    rising = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = rising.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    left = ranked.select(
        "*",
        (F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("rest"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("rest_weight"),
    )
    stops = F.col("rest") * F.col("weight") > most * F.col("source_size") * F.col("rest_weight")
    # of the sources that do not stop, the first has what all others share
    shared = F.min(F.when(~stops, F.struct("rest_order", "rest", "rest_weight"))).over(everything)
    left = left.withColumn("rest_order", F.row_number().over(rising)).withColumn("shared", shared)
    target = F.when(stops, (most * F.col("source_size")).cast("double")).otherwise(
        (F.col("shared.rest") * F.col("weight")).cast("double") / F.col("shared.rest_weight")
    )
    return left.select("source", "source_size", target.alias("target"))


def drawn(id_column: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 13 hex digits of the MD5 of seed and id; a null id draws as ``null``."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def planned(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_REPEATS,
    seed: int = 42,
) -> DataFrame:
    """``docs`` with a struct column ``mix``: size, source_size, target and copies of each document.

    The struct takes another name where ``docs`` has a ``mix`` of its own (see
    ``mix_column``).  A null or empty text has size 0 and is taken at its
    source's rate; documents of a source without any words have rate 0 and are
    not taken.  Rows with equal ids draw alike.  An empty table stays empty.
    """
    by_source = written(targets(source_sizes(docs, text_col, source_col), weights, most), "targets")
    names = {n: free_name(docs, f"_mix_{n}") for n in ("source", "size", "target")}
    by_source = by_source.select(
        F.col("source").alias(names["source"]), F.col("source_size").alias(names["size"]),
        F.col("target").alias(names["target"]),
    )
    joined = docs.join(by_source, docs[source_col].eqNullSafe(by_source[names["source"]]))
    rate = F.coalesce(F.col(names["target"]) / F.nullif(F.col(names["size"]), F.lit(0)), F.lit(0.0))
    whole = F.floor(rate)
    copies = whole + (drawn(F.col(id_col), seed) < rate - whole).cast("long")
    mix = F.struct(
        word_count(F.col(text_col)).alias("size"), F.col(names["size"]).alias("source_size"),
        F.col(names["target"]).alias("target"), copies.alias("copies"),
    )
    return joined.withColumn(mix_column(docs), mix).drop(*names.values())


def mix_column(docs: DataFrame) -> str:
    return free_name(docs, "mix")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as many times as the mixture takes it."""
    name = mix_column(docs)
    plan = planned(docs, **options)
    copy = free_name(plan, "_copy")
    return plan.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(f"{name}.copies").cast("int")))).drop(name, copy)
