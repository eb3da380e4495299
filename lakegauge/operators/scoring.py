"""Scoring answers and profiles, and reading decisions back from history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakegauge.functions.numbers import rounded
from lakegauge.functions.text import ANSWER_NUMBER_PATTERN, contains_any

# --- fixed values: phrases that qualify an answer ---
QUALIFYING_PHRASES = (
    "don't have", "do not have", "no data", "not available", "unable to",
    "cannot determine", "can't determine", "doesn't include", "does not include",
    "no such", "not tracked", "isn't tracked", "not present", "no revenue",
    "not a metric", "couldn't find", "could not find", "no matching",
    "auto-detected", "not confirmed", "uncertain", "not confident",
)
# --- end of fixed values ---

MEASURES = (
    "answer_accuracy", "capability_coverage", "false_confidence_rate", "refusal_correctness",
    "tool_selection_precision",
)


def answer_numbers(answer: Column) -> Column:
    """Every number in a text, thousands commas removed."""
    found = F.regexp_extract_all(answer, F.lit(ANSWER_NUMBER_PATTERN), F.lit(0))
    return F.transform(found, lambda t: F.replace(t, F.lit(","), F.lit("")).try_cast("double"))


def score_numeric(answer: Column, truth: Column, tolerance: Column) -> Column:
    """Whether any number in the answer is within the tolerance."""
    return F.coalesce(
        F.exists(answer_numbers(answer), lambda x: F.abs(x - truth) <= tolerance), F.lit(False)
    )


def score_categorical(answer: Column, labels: Column) -> Column:
    """Whether any accepted label occurs in the answer, whatever the case."""
    return F.exists(labels, lambda label: F.lower(answer).contains(F.lower(label)))


def is_qualified(answer: Column) -> Column:
    return contains_any(F.lower(answer), QUALIFYING_PHRASES)


def score_refusal(answer: Column) -> Column:
    """Whether the answer refuses: it qualifies itself or states no number."""
    return is_qualified(answer) | (F.size(F.array_compact(answer_numbers(answer))) == 0)


def score_tool(calls: Column, expected: Column) -> Column:
    """Whether the expected tool was called; null where none was expected."""
    return F.when(expected.isNotNull(), F.array_contains(calls, expected))


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, rounded(F.lit(100.0) * part / whole, 1))


def eval_summary(results: DataFrame) -> DataFrame:
    """Five percentages per dataset and, with a null dataset, over all of them.

    ``results`` holds ``dataset, category, passed, errored, false_confidence,
    tool_correct``.
    """
    answered, passed = ~F.col("errored"), F.col("passed")
    negative, scored = F.col("category") == "negative", F.col("tool_correct").isNotNull()
    total = F.count(F.lit(1))
    return results.rollup("dataset").agg(
        total.alias("total_questions"),
        F.count_if(~answered).alias("errored"),
        _percent(F.count_if(answered & passed), F.count_if(answered)).alias("answer_accuracy"),
        _percent(F.count_if(answered), total).alias("capability_coverage"),
        _percent(F.count_if("false_confidence"), total).alias("false_confidence_rate"),
        _percent(F.count_if(negative & passed), F.count_if(negative)).alias("refusal_correctness"),
        _percent(F.count_if(F.col("tool_correct")), F.count_if(scored)).alias("tool_selection_precision"),
    )


def category_accuracy(results: DataFrame) -> DataFrame:
    return results.groupBy("dataset", "category").agg(
        _percent(F.count_if("passed"), F.count(F.lit(1))).alias("accuracy")
    )


def eval_diff(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Baseline, current and delta of the five measures, per dataset."""

    def long(df: DataFrame, name: str) -> DataFrame:
        cells = [F.struct(F.lit(m).alias("measure"), F.col(m).alias(name)) for m in MEASURES]
        return df.select("dataset", F.inline(F.array(*cells)))

    a, b = long(baseline, "baseline"), long(current, "current").withColumnRenamed("dataset", "_d")
    b = b.withColumnRenamed("measure", "_m")
    joined = a.join(b, F.col("dataset").eqNullSafe(F.col("_d")) & (F.col("measure") == F.col("_m")), "full")
    return joined.select(
        F.coalesce("dataset", "_d").alias("dataset"),
        F.coalesce("measure", "_m").alias("measure"),
        "baseline",
        "current",
        F.round(F.col("current") - F.col("baseline"), 1).alias("delta"),
    )


def profile_accuracy(columns: DataFrame, grains: DataFrame, labels: DataFrame) -> DataFrame:
    """Profile against hand labels ``table, column, role, is_key, is_personal``."""
    keys = grains.select("table", F.array_join("grain_columns", ",").alias("grain"))
    profile = columns.select("table", "column", "guessed_role", "fingerprint", "is_pii").join(keys, "table")
    joined = profile.join(labels, ["table", "column"], "left")
    role_hit = (F.col("role") == F.col("guessed_role")) | (F.col("role") == F.col("fingerprint"))
    expected = F.coalesce("is_personal", F.lit(False))
    return joined.agg(
        F.count_if(F.col("is_key") & (F.col("grain") == F.col("column"))).alias("grain_hits"),
        F.count_if(F.col("is_key")).alias("grain_total"),
        F.count_if(F.coalesce(role_hit, F.lit(False))).alias("role_hits"),
        F.count("role").alias("role_total"),
        F.count_if(expected & F.col("is_pii")).alias("personal_hits"),
        F.count_if(expected).alias("personal_total"),
        F.count_if(~expected & F.col("is_pii")).alias("personal_false"),
    )


def latest_by_key(history: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last decision of every key: a mergeable maximum, no sort of groups."""
    rest = [c for c in history.columns if c not in keys]
    last = history.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def recent_top_n(history: DataFrame, keys: list[str], order: str, n: int = 3) -> DataFrame:
    """The last ``n`` decisions of every key, newest first.

    The rank filter cuts each task's rows to ``n`` per key before the shuffle,
    so a key with a third of the history stays small.
    """
    newest = Window.partitionBy(*keys).orderBy(F.desc(order))
    return history.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= n)
