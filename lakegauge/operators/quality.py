"""Data-quality findings, read off the frequency table and the profile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakegauge.functions.numbers import rounded
from lakegauge.functions.text import is_number_text
from lakegauge.functions.types import NUMERIC

MAX_VALUES = 50
HIGH_NULL_PERCENT = 40.0
DOMINANT_SHARE = 0.60
MIXED_SHARE = (0.05, 0.95)
TOP = 5
UNCLEAR_CONFIDENCE = 0.5

COLUMNS = ("id", "code", "severity", "table", "column", "summary", "top_values")
_TOP_TYPE = "array<struct<value:string,count:bigint,percent:double>>"


def _finding(df: DataFrame, code: str, severity: str, summary: Column, top: Column) -> DataFrame:
    return df.select(
        F.concat(F.lit(f"{code}:"), "table", F.lit("."), "column").alias("id"),
        F.lit(code).alias("code"),
        F.lit(severity).alias("severity"),
        "table",
        "column",
        summary.alias("summary"),
        top.cast(_TOP_TYPE).alias("top_values"),
    )


def eligible_columns(structural: DataFrame, max_values: int = MAX_VALUES) -> DataFrame:
    """Columns whose values are worth listing: at most ``max_values`` different ones, not personal, not dates."""
    return structural.where(
        ~F.col("is_pii")
        & F.col("cardinality").between(1, max_values)
        & (F.col("family") != "temporal")
    )


def histograms(frequency: DataFrame, structural: DataFrame, max_values: int = MAX_VALUES) -> DataFrame:
    """All values of columns with at most ``max_values`` different ones: total, share and place.

    The bound is what later groups of a column's values are limited by.
    """
    chosen = eligible_columns(structural, max_values).select(
        "column_id", "table", "column", "family", "cardinality",
        (F.col("row_count") - F.col("null_count")).alias("total"),
    )
    place = Window.partitionBy("column_id").orderBy(F.desc("n"), "value")
    return (
        frequency.where(F.col("value").isNotNull())
        .join(chosen, "column_id")
        .withColumn("place", F.row_number().over(place))
        .withColumn("percent", rounded(F.col("n") / F.col("total") * 100.0, 1))
    )


def _counted(test: Column) -> Column:
    """The five most frequent values that pass, as value, count and percent."""
    cell = F.struct(
        F.col("place").alias("place"), F.col("value").alias("value"),
        F.col("n").alias("count"), F.col("percent").alias("percent"),
    )
    picked = F.slice(F.sort_array(F.collect_list(F.when(test, cell))), 1, TOP)
    return F.transform(
        picked,
        lambda c: F.struct(
            c["value"].alias("value"), c["count"].alias("count"), c["percent"].alias("percent")
        ),
    )


def _name() -> Column:
    return F.concat(F.lit('"'), F.col("column"), F.lit('"'))


def high_null(structural: DataFrame) -> DataFrame:
    summary = F.concat(_name(), F.format_string(" is empty for %.1f%% of rows.", "null_percent"))
    found = structural.where(F.col("null_percent") >= HIGH_NULL_PERCENT)
    return _finding(found, "high_null", "medium", summary, F.array())


def single_value(hist: DataFrame) -> DataFrame:
    summary = F.concat(
        _name(), F.lit(' is always "'), "value", F.lit('" ('), F.format_number("n", 0), F.lit(" row(s)).")
    )
    top = F.array(F.struct(F.col("value"), F.col("n").alias("count"), F.lit(100.0).alias("percent")))
    return _finding(hist.where("cardinality = 1"), "single_value", "low", summary, top)


def dominant_value(hist: DataFrame) -> DataFrame:
    columns = hist.where("cardinality > 1").groupBy("table", "column", "total").agg(
        F.min_by(F.struct("value", "n"), "place").alias("first"), _counted(F.lit(True)).alias("top")
    )
    share = F.col("first.n") / F.col("total")
    summary = F.concat(
        F.format_string("%.1f%% of ", share * 100), F.format_number("total", 0),
        F.lit(" non-null rows in "), _name(), F.lit(' are "'), F.col("first.value"), F.lit('".'),
    )
    return _finding(
        columns.where(share >= DOMINANT_SHARE), "dominant_value", "medium", summary, F.col("top")
    )


def inconsistent_format(hist: DataFrame) -> DataFrame:
    """Values that differ only in case or outer blanks."""
    spellings = (
        hist.where("cardinality > 1")
        .groupBy("table", "column", F.lower(F.trim("value")).alias("plain"))
        .agg(
            F.sort_array(F.collect_list(F.struct("place", "value", F.col("n").alias("count"), "percent"))).alias("cells"),
            F.sum("n").alias("cluster_n"),
            F.min("value").alias("least"),
        )
        .where(F.size("cells") > 1)
    )
    example = F.array_join(F.transform(F.slice("cells", 1, 3), lambda c: c["value"]), "/")
    columns = spellings.groupBy("table", "column").agg(
        F.sort_array(
            F.collect_list(F.struct((-F.col("cluster_n")).alias("o"), "least", example.alias("text")))
        ).alias("clusters"),
        F.sort_array(F.flatten(F.collect_list("cells"))).alias("cells"),
    )
    examples = F.array_join(F.transform(F.slice("clusters", 1, 3), lambda c: c["text"]), ", ")
    summary = F.concat(
        _name(), F.lit(" has multiple spellings of the same value: "), examples, F.lit(".")
    )
    top = F.transform(
        F.slice("cells", 1, TOP),
        lambda c: F.struct(c["value"].alias("value"), c["count"].alias("count"), c["percent"].alias("percent")),
    )
    return _finding(columns, "inconsistent_format", "low", summary, top)


def mixed_types(hist: DataFrame) -> DataFrame:
    """Text columns of which 5 to 95 percent look like numbers."""
    numeric = is_number_text(F.col("value"))
    text = hist.where((F.col("cardinality") > 1) & ~F.col("family").isin(*NUMERIC))

    def examples(test: Column) -> Column:
        cells = F.sort_array(F.collect_list(F.when(test, F.struct("place", "value"))))
        return F.array_join(F.transform(F.slice(cells, 1, 2), lambda c: c["value"]), ", ")

    columns = text.groupBy("table", "column", "total").agg(
        F.coalesce(F.sum(F.when(numeric, F.col("n"))), F.lit(0)).alias("numbers"),
        examples(~numeric).alias("labels"),
        examples(numeric).alias("figures"),
        _counted(F.lit(True)).alias("top"),
    )
    share = F.col("numbers") / F.col("total")
    summary = F.concat(
        _name(), F.lit(" mixes text labels ("), "labels", F.lit(") with numeric-looking values ("),
        "figures", F.format_string(") - %.1f%% look numeric.", share * 100),
    )
    return _finding(
        columns.where(share.between(*MIXED_SHARE)), "mixed_types", "high", summary, F.col("top")
    )


def unclear_meaning(claims: DataFrame) -> DataFrame:
    """Claims ``table, column, proposed_meaning, confidence`` below one half."""
    summary = F.concat(
        F.lit("Not confident what "), _name(), F.lit(' means - best guess: "'), "proposed_meaning",
        F.format_string('" (%.0f%% confidence).', F.col("confidence") * 100),
    )
    doubtful = claims.where(F.col("confidence") < UNCLEAR_CONFIDENCE)
    return _finding(doubtful, "unclear_meaning", "medium", summary, F.array())


def quality_report(
    frequency: DataFrame, structural: DataFrame, claims: DataFrame | None = None, max_values: int = MAX_VALUES
) -> DataFrame:
    """All findings, most severe first, in one total order; values are judged in columns with at most ``max_values``."""
    hist = histograms(frequency, structural, max_values)
    parts = [
        high_null(structural),
        single_value(hist),
        dominant_value(hist),
        inconsistent_format(hist),
        mixed_types(hist),
    ]
    if claims is not None:
        parts.append(unclear_meaning(claims))
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    every = reduce(DataFrame.unionByName, parts)
    return every.orderBy(rank, "code", "table", "column")
