"""Time columns: the main one of each table, its span, granularity and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def primary_time_columns(structural: DataFrame) -> DataFrame:
    """Per table the date column with fewest nulls, then most distinct values."""
    dates = structural.where(F.col("guessed_role").isin("date", "datetime"))
    order = Window.partitionBy("table").orderBy("null_percent", F.desc("cardinality"), "ordinal")
    return (
        dates.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")
    )


def temporal_profile(frequency: DataFrame, structural: DataFrame) -> DataFrame:
    """Span, distinct counts, granularity and gaps of every main time column.

    Distinct values first shrink to one row per day, whose number the calendar
    bounds; months, years and missing days are counted on those.
    """
    main = primary_time_columns(structural).select("column_id", "table", "column")
    text = F.col("value")
    moment = F.coalesce(
        text.try_cast("timestamp"), F.try_to_timestamp(F.trim(text), F.lit("y/M/d"))
    )
    days = (
        frequency.where(text.isNotNull())
        .join(F.broadcast(main), "column_id")
        .withColumn("moment", moment)
        .groupBy("table", "column", F.to_date("moment").alias("day"))
        .agg(
            F.min("moment").alias("first"),
            F.max("moment").alias("last"),
            F.count(F.lit(1)).alias("distinct_n"),
            F.sum("n").alias("rows"),
            F.bool_or(text.contains(":")).alias("timed"),
        )
    )
    per_column = days.groupBy("table", "column").agg(
        F.min("first").alias("min_value"),
        F.max("last").alias("max_value"),
        F.sum("distinct_n").alias("distinct_n"),
        F.sum("rows").alias("non_null"),
        F.bool_or("timed").alias("_timed"),
        F.count("day").alias("distinct_days"),
        F.count_distinct(F.trunc("day", "month")).alias("_months"),
        F.count_distinct(F.trunc("day", "year")).alias("_years"),
    )
    distinct, months, years = F.col("distinct_n"), F.col("_months"), F.col("_years")
    granularity = (
        F.when(F.col("_timed"), "timestamp")
        .when((years == 1) & (months <= 1), F.when(distinct > 10, "day").otherwise("month"))
        .when(distinct / months < 2, "month")
        .when(distinct / years < 13, "month")
        .otherwise("day")
    )
    span = F.datediff("max_value", "min_value") + 1
    missing = span - F.col("distinct_days")
    gap = (F.col("granularity") == "day") & (missing > F.greatest(F.lit(2.0), span * 0.05))
    return (
        per_column.withColumn("granularity", granularity)
        .withColumn("span_days", span)
        .withColumn(
            "gaps",
            F.when(gap, F.concat(missing, F.lit(" missing days in "), span, F.lit("-day span"))),
        )
        .drop("_timed", "_months", "_years")
    )
