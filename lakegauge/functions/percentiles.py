"""Exact percentiles whose work is spread over the cluster.

The built-in ``percentile`` keeps every distinct value of a group in one
task.  Here a bounded sketch first brackets each wanted rank; values outside
the bracket collapse to a count before the shuffle, and only the few values
inside it are ranked exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakegauge.functions.storage import estimated_bytes

LARGE_INPUT_BYTES = 64 << 30
ACCURACY = (10_000, 200_000)
"""Sketch accuracy for ordinary and for large inputs: ranks are off by at most
one part in that many, so a large input still leaves few values to rank."""


def exact_percentiles(
    df: DataFrame, keys: list[str], value: str, points: list[float], few_groups: bool = False
) -> DataFrame:
    """``keys, point, value``, interpolated linearly between the two ranks.

    Nulls are ignored and a group without values gives no row.  ``few_groups``
    states that the number of groups is bounded by the query text (columns of
    a table, or no keys at all), so that the brackets may be broadcast.
    """
    if not keys:
        whole = df.withColumn("_all", F.lit(1))
        return exact_percentiles(whole, ["_all"], value, points, few_groups=True).drop("_all")
    rows = df.where(F.col(value).isNotNull()).select(
        *keys, F.col(value).cast("double").alias("_v")
    )
    accuracy = ACCURACY[estimated_bytes(df) > LARGE_INPUT_BYTES]
    # three times the guaranteed rank error on each side; in a group of fewer
    # than four ranks per error step a bracket could miss a rank: rank it all
    margin, small_group = 3.0 / accuracy, 4 * accuracy
    lows = [max(0.0, p - margin) for p in points]
    highs = [min(1.0, p + margin) for p in points]
    sketch = rows.groupBy(*keys).agg(
        F.percentile_approx("_v", lows + highs, accuracy).alias("_sketch"),
        F.count(F.lit(1)).alias("_total"),
    )
    # one row per group: the brackets of all points; null where all is ranked
    large = F.col("_total") > small_group
    count = len(points)
    brackets = sketch.select(
        *[F.col(k).alias(f"_b_{k}") for k in keys],
        "_total",
        F.when(large, F.slice("_sketch", 1, count)).alias("_lows"),
        F.when(large, F.slice("_sketch", count + 1, count)).alias("_highs"),
    )
    same_group = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys]
    )
    small = F.broadcast(brackets) if few_groups else brackets
    value_column = F.col("_v")
    within = reduce(
        lambda a, b: a | b,
        [value_column.between(F.col("_lows")[i], F.col("_highs")[i]) for i in range(count)],
    )
    passed = reduce(
        lambda a, b: a + b,
        [(value_column > F.col("_highs")[i]).cast("int") for i in range(count)],
    )
    group = [*keys, "_total"]
    # values outside every bracket become one row per gap between brackets
    collapsed = (
        rows.join(small, same_group)
        .select(
            *group,
            F.coalesce(passed, F.lit(0)).alias("_gap"),
            F.coalesce(within, F.lit(True)).alias("_inside"),
            "_v",
        )
        .withColumn("_v", F.when(F.col("_inside"), F.col("_v")))
        .groupBy(*group, "_gap", "_inside", "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    in_order = Window.partitionBy(*group).orderBy("_gap", "_inside", "_v")
    ranked = collapsed.withColumn(
        "_upto", F.sum("_n").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    )
    picks = []
    for i, p in enumerate(points):
        position = (F.col("_total") - 1) * F.lit(p)
        for side, rank in (("a", F.floor(position)), ("b", F.ceil(position))):
            picks.append(
                F.min(F.when(F.col("_upto") > rank, F.struct("_upto", "_v"))).alias(f"_{side}{i}")
            )
    found = ranked.groupBy(*group).agg(*picks)

    def interpolated(i: int, p: float):
        position = (F.col("_total") - 1) * F.lit(p)
        low, high = F.col(f"_a{i}._v"), F.col(f"_b{i}._v")
        return F.when(
            low.isNull() | high.isNull(),
            F.raise_error(F.lit("percentile bracket missed its rank")).cast("double"),
        ).otherwise(low + (high - low) * (position - F.floor(position)))

    values = F.array(
        *[
            F.struct(F.lit(p).alias("point"), interpolated(i, p).alias("value"))
            for i, p in enumerate(points)
        ]
    )
    return found.select(*keys, F.inline(values))
