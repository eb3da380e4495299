"""Gates: claims, bindings and texts checked against what the data shows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakegauge.dataset import Dataset, column, constant_rows
from lakegauge.functions.text import PERSONAL_VALUE_PATTERNS
from lakegauge.operators.relations import MIN_OVERLAP
from lakegauge.plans.kpis import Bindings, Kpi, skipped_kpis
from lakegauge.plans.packs import Pack

# --- fixed values: unit names the rules know ---
MONEY_UNITS = ("currency", "inr", "usd", "money", "revenue")
PERCENT_UNITS = ("percent", "rate", "percentage")
NON_ADDITIVE_UNITS = ("percent", "rate", "percentage", "score", "ratio")
# --- end of fixed values ---

MIN_VALUE_SHARE = 0.8


def _reasons(*rules: tuple[Column, str]) -> Column:
    return F.array_join(F.array_compact(F.array(*[F.when(test, F.lit(why)) for test, why in rules])), "; ")


def gate_distribution(claims: DataFrame, columns: DataFrame) -> DataFrame:
    """Claims ``table, column, unit, kind`` whose unit the value range rules out."""
    facts = columns.select("table", "column", "min_value", "max_value", "cardinality")
    joined = claims.join(facts, ["table", "column"])
    unit = F.lower(F.trim(F.coalesce("unit", F.lit(""))))
    low, high = F.col("min_value"), F.col("max_value")
    money, percent = unit.isin(*MONEY_UNITS), unit.isin(*PERCENT_UNITS)
    known = money | percent | unit.isin("score", "count")
    time = ~known & ((unit == "time") | (F.col("kind") == "time"))
    reasons = _reasons(
        (money & (low >= 0) & (high <= 100), "money bounded by 0 and 100"),
        (money & (low < 0), "negative money"),
        (percent & (low < 0), "negative percentage"),
        (percent & (high > 100), "percentage above 100"),
        ((unit == "score") & (high > 1000), "score above 1000"),
        ((unit == "count") & (low < 0), "negative count"),
        (time & (F.col("cardinality") < 2), "time with fewer than two points"),
    )
    return joined.select(
        "table", "column", "unit",
        F.when(reasons == "", "verified").otherwise("failed").alias("verdict"),
        reasons.alias("reasons"),
    )


def gate_aggregation(claims: DataFrame, columns: DataFrame) -> DataFrame:
    """Claims ``table, column, unit, aggregations`` that would sum a ratio, or a column without any value."""
    unit = F.lower(F.trim(F.coalesce("unit", F.lit(""))))
    sums = F.array_contains("aggregations", "sum")
    wrong = (unit.isin(*NON_ADDITIVE_UNITS) & sums) | (F.col("cardinality") == 0)
    joined = claims.join(columns.select("table", "column", "cardinality"), ["table", "column"])
    return joined.select(
        "table", "column", "unit", F.when(wrong, "failed").otherwise("verified").alias("verdict")
    )


def gate_relation(facts: DataFrame) -> DataFrame:
    """Claimed joins whose measured overlap is below one half fail."""
    verdict = F.when(F.col("overlap_ratio") < MIN_OVERLAP, "failed").otherwise("verified")
    return facts.select(
        "from_table", "from_column", "to_table", "to_column", "overlap_ratio", verdict.alias("verdict")
    )


def gate_value_set(coverage: DataFrame) -> DataFrame:
    """On coverage summaries: absent candidates fail, a small share is a warning."""
    share = F.col("matched") / F.nullif(F.col("real_values"), F.lit(0))
    absent = F.col("matched") < F.col("candidates")
    return coverage.select(
        "table", "column", "matched", "candidates", "real_values",
        F.when(absent, "failed").otherwise("verified").alias("verdict"),
        F.coalesce(~absent & (share < MIN_VALUE_SHARE), F.lit(False)).alias("warning"),
    )


def gate_money_range(bindings: DataFrame, columns: DataFrame, pack: Pack, fact: str) -> DataFrame:
    """Bindings of money roles to a column whose values lie within 0 and 100."""
    spark = columns.sparkSession
    money = constant_rows(spark, [(r,) for r in pack.money_roles], "role string")
    facts = columns.where(F.col("table") == fact).select("column", "min_value", "max_value")
    bounded = (F.col("min_value") >= 0) & (F.col("max_value") <= 100)
    return (
        bindings.where(F.col("column").isNotNull())
        .join(money, "role")
        .join(facts, "column")
        .select(
            "role", "column",
            F.when(F.coalesce(bounded, F.lit(False)), "error").otherwise("pass").alias("severity"),
        )
    )


def fact_check(
    bindings: Bindings, kpis: tuple[Kpi, ...], columns: DataFrame
) -> DataFrame:
    """Bound columns that do not exist or hold no value, and KPIs that cannot be compiled."""
    spark = columns.sparkSession
    bound = constant_rows(spark, list(bindings.columns.items()), "role string, column string")
    known = columns.where("cardinality > 0").select("column").distinct()
    missing = bound.join(known, "column", "left_anti").select(
        F.lit("error").alias("severity"),
        F.concat(F.lit("column:"), "role").alias("location"),
        F.concat("column", F.lit(" is not a column with values")).alias("message"),
    )
    skipped = constant_rows(
        spark,
        [
            ("warning" if k.optional else "error", f"kpi:{k.id}", f"unresolved roles: {', '.join(m)}")
            for k, m in skipped_kpis(kpis, bindings)
        ],
        "severity string, location string, message string",
    )
    return missing.unionByName(skipped)


def overall_status(issues: DataFrame) -> DataFrame:
    errors, any_issue = F.count_if(F.col("severity") == "error"), F.count(F.lit(1))
    return issues.agg(
        F.when(errors > 0, "fail").when(any_issue > 0, "warn").otherwise("pass").alias("status")
    )


def pii_text_scan(ds: Dataset, texts: dict[str, str]) -> DataFrame:
    """Personal values in whole texts: ``table, kind, texts, matches``.

    ``texts`` maps a table to its text column.  One scan per table counts all
    kinds at once and shuffles one row per task.
    """
    parts = []
    for table, name in texts.items():
        text = column(name)
        # every kind needs a digit group, or an @, that is cheap to look for
        hint = {"email": text.contains("@")}
        digits = text.rlike(r"\d{4}")
        counts = [
            F.when(hint.get(kind, digits), F.regexp_count(text, F.lit(pattern)))
            .when(text.isNotNull(), 0)
            .alias(kind)
            for kind, pattern in PERSONAL_VALUE_PATTERNS.items()
        ]
        totals = ds.table(table).select(*counts).agg(
            *[
                agg
                for kind in PERSONAL_VALUE_PATTERNS
                for agg in (
                    F.count_if(F.col(kind) > 0).alias(f"{kind}_texts"),
                    F.coalesce(F.sum(kind), F.lit(0)).alias(f"{kind}_matches"),
                )
            ]
        )
        cells = [
            F.struct(
                F.lit(table).alias("table"),
                F.lit(kind).alias("kind"),
                F.col(f"{kind}_texts").alias("texts"),
                F.col(f"{kind}_matches").alias("matches"),
            )
            for kind in PERSONAL_VALUE_PATTERNS
        ]
        parts.append(totals.select(F.inline(F.array(*cells))))
    return reduce(DataFrame.unionByName, parts)
