"""Automatic insights: aggregates proposed for every table from its profile, run and ranked."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lakegauge.dataset import Dataset, column, constant_rows
from lakegauge.functions.types import NUMERIC

#: How far each kind of insight is trusted before it has run.
SUPPORT = {"month": 0.75, "week": 0.60, "breakdown": 0.70, "distribution": 0.65, "status_sum": 0.60, "top_n": 0.60}


@dataclass(frozen=True)
class Insight:
    kind: str
    question: str
    support: float
    table: str
    measure: str | None = None
    dimension: str | None = None
    grain: str | None = None


def candidate_insights(
    columns: DataFrame, breakdown_values: int = 50, distribution_values: int = 100, top_values: int = 5
) -> DataFrame:
    """Every measure of a table against its times, dimensions and states, one row per proposal.

    A breakdown needs at most ``breakdown_values`` groups, a distribution at most
    ``distribution_values``, a top list at least ``top_values``.  Text cannot be
    summed and a number is no moment, so neither is proposed.
    """
    role, numeric = F.col("understanding_role"), F.col("family").isin(*NUMERIC)
    open_to_all = columns.where(~F.col("is_pii") | (role == "timestamp"))
    measures = open_to_all.where((role == "measure") & numeric).select("table", F.col("column").alias("measure"))
    others = open_to_all.where(role.isin("dimension", "status") | ((role == "timestamp") & ~numeric)).select(
        "table", F.col("column").alias("dimension"), "cardinality", role.alias("role")
    )
    pairs = measures.join(others, "table")
    few, state = F.col("cardinality") <= breakdown_values, F.col("role") == "status"
    moment = F.col("role") == "timestamp"

    def proposal(rows: DataFrame, kind: str, *text: str, grain: str | None = None) -> DataFrame:
        words = [F.col(w[1:]) if w.startswith("$") else F.lit(w) for w in text]
        measure = F.col("measure") if "measure" in rows.columns else F.lit(None).cast("string")
        return rows.select(
            F.lit(kind).alias("kind"), F.concat(*words).alias("question"), F.lit(SUPPORT[grain or kind]).alias("support"),
            "table", measure.alias("measure"), "dimension", F.lit(grain).cast("string").alias("grain"),
        )

    found = [proposal(pairs.where(moment), "trend", f"{g} trend of ", "$measure", " over ", "$dimension", grain=g) for g in ("month", "week")]
    found.append(proposal(pairs.where(~moment & few), "breakdown", "$measure", " by ", "$dimension"))
    found.append(proposal(others.where(~moment & (F.col("cardinality") <= distribution_values)), "distribution", "distribution of ", "$dimension"))
    found.append(proposal(pairs.where(state), "status_sum", "$measure", " for the most frequent ", "$dimension"))
    found.append(proposal(pairs.where(~moment & (F.col("cardinality") >= top_values)), "top_n", "top ", "$dimension", " by ", "$measure"))
    return reduce(DataFrame.unionByName, found).orderBy(F.desc("support"), "table", "question")


def propose_insights(columns: DataFrame, most: int | None = None, **bounds) -> list[Insight]:
    """The candidates as values that can be run, the most trusted first; ``most`` is for callers who want fewer.

    The list is as long as the column catalogue allows, not as the data.
    """
    found = candidate_insights(columns, **bounds)
    return [Insight(**row.asDict()) for row in (found if most is None else found.limit(most)).collect()]


def run_insight(ds: Dataset, insight: Insight, top: int = 10) -> DataFrame:
    """The insight's rows: ``key`` and ``value``; a top list has ``top`` rows."""
    rows = ds.table(insight.table)
    if insight.kind == "trend":
        bucket = F.date_trunc(insight.grain, column(insight.dimension).cast("timestamp")).alias("key")
        return rows.groupBy(bucket).agg(F.sum(column(insight.measure)).alias("value")).orderBy("key")
    key = column(insight.dimension).alias("key")
    if insight.kind == "distribution":
        counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("value"))
        return counts.orderBy(F.desc("value"), "key")
    sums = rows.groupBy(key).agg(F.sum(column(insight.measure)).alias("value"), F.count(F.lit(1)).alias("n"))
    if insight.kind == "status_sum":
        # the most frequent value and its sum come out of one aggregation
        return sums.where("key is not null").orderBy(F.desc("n"), "key").limit(1).select("key", "value")
    ordered = sums.orderBy(F.desc_nulls_last("value"), F.asc_nulls_last("key")).select("key", "value")
    return ordered.limit(top) if insight.kind == "top_n" else ordered


def run_insights(ds: Dataset, insights: list[Insight], top: int = 10) -> DataFrame:
    """``kind, question, support, key, value`` of all insights, each table read once.

    Every dimension and every time bucket of a table is a grouping set, and all
    its measures are summed in each.  Keys come as texts; equal values of a top
    list are taken in the order of these.
    """
    parts = []
    for table in dict.fromkeys(i.table for i in insights):
        own = [i for i in insights if i.table == table]
        keys = list(dict.fromkeys((i.dimension, i.grain) for i in own))
        measures = list(dict.fromkeys(i.measure for i in own if i.measure))
        cells = [column(d) if g is None else F.date_trunc(g, column(d).cast("timestamp")) for d, g in keys]
        rows = ds.table(table).select(
            *[c.alias(f"k{n}") for n, c in enumerate(cells)], *[column(m).alias(f"m{n}") for n, m in enumerate(measures)]
        )
        groups = rows.groupingSets([[f"k{n}"] for n in range(len(keys))], *[f"k{n}" for n in range(len(keys))]).agg(
            F.grouping_id().alias("set"), F.count(F.lit(1)).alias("n"),
            *[F.sum(f"m{n}").cast("double").alias(f"s{n}") for n in range(len(measures))],
        )
        found = []
        for insight in own:
            at = keys.index((insight.dimension, insight.grain))
            key = F.col(f"k{at}").cast("string")
            mine = F.col("set") == (1 << len(keys)) - 1 - (1 << (len(keys) - 1 - at))
            value = F.col("n").cast("double") if insight.kind == "distribution" else F.col(f"s{measures.index(insight.measure)}")
            if insight.kind == "status_sum":
                mine = mine & key.isNotNull()
            found.append(
                F.struct(
                    mine.alias("mine"), F.lit(insight.kind).alias("kind"), F.lit(insight.question).alias("question"),
                    F.lit(insight.support).alias("support"), key.alias("key"), value.alias("value"), F.col("n").alias("n"),
                )
            )
        parts.append(groups.select(F.inline(F.array(*found))).where("mine").drop("mine"))
    every = reduce(DataFrame.unionByName, parts)
    # the most frequent state is one row, a top list ``top`` rows; all others are whole
    first = W.partitionBy("kind", "question")
    listed = every.where("kind = 'top_n'").withColumn("at", F.row_number().over(first.orderBy(F.desc_nulls_last("value"), F.asc_nulls_last("key"))))
    state = every.where("kind = 'status_sum'").withColumn("at", F.row_number().over(first.orderBy(F.desc("n"), "key")))
    rest = every.where("kind not in ('top_n', 'status_sum')").withColumn("at", F.lit(0))
    picked = rest.unionByName(listed.where(F.col("at") <= top)).unionByName(state.where("at = 1"))
    return picked.select("kind", "question", "support", "key", "value")


def rank_insights(ds: Dataset, insights: list[Insight]) -> DataFrame:
    """Row counts of all insights, from one scan a table; empty ones lose half their support."""
    counts = run_insights(ds, insights).groupBy("kind", "question").agg(F.count(F.lit(1)).alias("rows"))
    listed = constant_rows(ds.spark, [(i.kind, i.question, i.support) for i in insights], "kind string, question string, support double")
    ranked = listed.join(counts, ["kind", "question"], "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    support = F.when(F.col("rows") == 0, F.round(F.col("support") * 0.5, 2)).otherwise(F.col("support"))
    return ranked.withColumn("support", support).orderBy(F.desc("support"), "question")
