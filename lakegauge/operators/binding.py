"""Binding canonical roles to columns, and choosing an industry pack."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakegauge.dataset import Dataset, column, constant_rows
from lakegauge.functions.numbers import rounded
from lakegauge.functions.text import jaccard, name_tokens
from lakegauge.operators.scoring import latest_by_key
from lakegauge.plans.kpis import pack_kpis
from lakegauge.plans.packs import GENERIC_NAME_TOKENS, PACKS, Pack, expected_roles

MIN_SCORE = 0.40
RESOLVED_SCORE = 0.70
ALTERNATIVES = 3


def _texts(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def role_scores(columns: DataFrame, pack: Pack) -> DataFrame:
    """Score of every bindable column for every role of the pack.

    The roles are constants of the pack, so each profile row carries them and
    no join is needed.
    """
    roles = F.array(
        *[
            F.struct(
                F.lit(role).alias("role"),
                _texts(pack.role_hints.get(role, ())).alias("hints"),
                _texts(expected_roles(role)).alias("expected"),
            )
            for role in pack.roles
        ]
    )
    bindable = columns.where(~F.col("is_pii") & ~F.col("guessed_role").isin(*pack.denied_roles))
    rows = bindable.select("table", "column", "ordinal", "guessed_role", F.inline(roles))
    generic = _texts(GENERIC_NAME_TOKENS)
    role_words = F.array_remove(name_tokens(F.col("role")), "")
    column_words = F.array_remove(name_tokens(F.col("column")), "")
    core = jaccard(F.array_except(role_words, generic), F.array_except(column_words, generic))
    both_core = (F.size(F.array_except(role_words, generic)) > 0) & (
        F.size(F.array_except(column_words, generic)) > 0
    )
    hinted = F.exists("hints", lambda h: F.lower("column").contains(h))
    name_score = F.when(hinted, 1.0).otherwise(
        F.lit(0.6) * F.when(both_core, core).otherwise(0.0)
        + F.lit(0.4) * jaccard(role_words, column_words)
    )
    type_score = (
        F.when(F.size("expected") == 0, 0.5)
        .when(F.array_contains("expected", F.col("guessed_role")), 1.0)
        .otherwise(0.25)
    )
    score = rounded(F.least(F.lit(1.0), F.lit(0.55) * name_score + F.lit(0.45) * type_score), 4)
    return rows.select("table", "column", "ordinal", "guessed_role", "role", score.alias("score"))


def pack_fact_table(columns: DataFrame, pack: Pack, central: str | None = None) -> DataFrame:
    """Tables by the sum of their best role scores; a named entity comes first."""
    best = role_scores(columns, pack).groupBy("table", "role").agg(F.max("score").alias("best"))
    totals = best.groupBy("table").agg(
        F.coalesce(F.sum(F.when(F.col("best") >= MIN_SCORE, F.col("best"))), F.lit(0.0)).alias("total")
    )
    named = [(F.col("table") == central).desc()] if central else []
    return totals.orderBy(*named, F.desc("total"), "table").limit(1)


def role_bindings(
    columns: DataFrame, pack: Pack, fact: str, overrides: Mapping[str, str] | None = None
) -> DataFrame:
    """``role, column, confidence, status, source, alternatives`` for every role.

    ``overrides`` are a person's choices, as ``column`` or ``table.column``.
    """
    ranked = role_scores(columns.where(F.col("table") == fact), pack).withColumn(
        "place",
        F.row_number().over(Window.partitionBy("role").orderBy(F.desc("score"), "ordinal")),
    )
    best = ranked.where("place = 1").select("role", "column", "score")
    others = (
        ranked.where(F.col("place").between(2, 1 + ALTERNATIVES))
        .groupBy("role")
        .agg(F.sort_array(F.collect_list(F.struct("place", "column", "score"))).alias("others"))
    )
    spark = columns.sparkSession
    roles = constant_rows(spark, [(r,) for r in pack.roles], "role string")
    stated = constant_rows(
        spark,
        [(role, name.split(".")[-1]) for role, name in (overrides or {}).items()],
        "role string, chosen string",
    )
    known = columns.where(F.col("table") == fact).select(F.col("column").alias("chosen"))
    stated = stated.join(known, "chosen", "left_semi")
    human, score = F.col("chosen").isNotNull(), F.col("score")
    status = (
        F.when(human | (score >= RESOLVED_SCORE), "resolved")
        .when(score >= MIN_SCORE, "needs_confirmation")
        .otherwise("unresolved")
    )
    alternatives = F.transform("others", lambda o: o["column"])
    return (
        roles.join(best, "role", "left")
        .join(others, "role", "left")
        .join(stated, "role", "left")
        .withColumn("status", status)
        .select(
            "role",
            F.when(F.col("status") != "unresolved", F.coalesce("chosen", "column")).alias("column"),
            F.when(human, 1.0).otherwise(F.when(F.col("status") != "unresolved", score)).alias("confidence"),
            "status",
            F.when(human, "human_override")
            .when(F.col("status") != "unresolved", "deterministic")
            .alias("source"),
            F.when(F.col("status") == "needs_confirmation", alternatives).alias("alternatives"),
        )
    )


def value_sets(ds: Dataset, table: str, name: str, pack: Pack) -> DataFrame:
    """Real values of a column that contain a hint: ``value_set, value``."""
    hints = [(s, h) for s, words in pack.value_set_hints.items() for h in words]
    cells = F.array(
        *[F.struct(F.lit(s).alias("value_set"), F.lit(h).alias("hint")) for s, h in hints]
    )
    values = ds.table(table).select(column(name).cast("string").alias("value")).where(
        "value is not null"
    ).distinct()
    return (
        values.select("value", F.inline(cells))
        .where(F.lower("value").contains(F.col("hint")))
        .select("value_set", "value")
        .distinct()
    )


def binding_gate(bindings: DataFrame, pack: Pack) -> DataFrame:
    """Uncertain bindings that a compiled KPI depends on, with those KPIs."""
    uses = [(role, k.id) for k in pack_kpis(pack.slug) for role in k.requires]
    spark = bindings.sparkSession
    needed = constant_rows(spark, uses, "role string, kpi_id string")
    bound = bindings.where(F.col("status") != "unresolved").select("role")
    unbound_kpis = needed.join(bound, "role", "left_anti").select("kpi_id").distinct()
    compiled = needed.join(unbound_kpis, "kpi_id", "left_anti")
    return (
        bindings.where("status = 'needs_confirmation'")
        .join(compiled, "role")
        .groupBy("role", "column", "confidence")
        .agg(F.array_join(F.sort_array(F.collect_set("kpi_id")), ", ").alias("kpis_affected"))
    )


def apply_confirmations(bindings: DataFrame, gated: DataFrame, answers: DataFrame) -> DataFrame:
    """Apply answers ``role, answer`` to the gated roles; no answer drops the binding."""
    asked = gated.select("role", F.lit(True).alias("_asked"))
    joined = bindings.join(asked, "role", "left").join(answers, "role", "left")
    allowed = F.coalesce(
        (F.col("answer") == F.col("column")) | F.array_contains("alternatives", F.col("answer")),
        F.lit(False),
    )
    return joined.where(F.col("_asked").isNull() | allowed).select(
        "role",
        F.when(F.col("_asked"), F.col("answer")).otherwise(F.col("column")).alias("column"),
        F.when(F.col("_asked"), 1.0).otherwise(F.col("confidence")).alias("confidence"),
        F.when(F.col("_asked"), "resolved").otherwise(F.col("status")).alias("status"),
        F.when(F.col("_asked"), "human_override").otherwise(F.col("source")).alias("source"),
        F.when(F.col("_asked").isNull(), F.col("alternatives")).alias("alternatives"),
    )


def confirmed_bindings(bindings: DataFrame, gated: DataFrame, log: DataFrame) -> DataFrame:
    """The bindings after a log of decisions ``role, answer, decided``: of each role the last one counts.

    The log may be of any size and one role may fill it: tasks send one decision
    a role.  A last answer that is null, or no column the role was offered, drops
    the binding, as no decision does.
    """
    last = latest_by_key(log.where("role is not null and decided is not null").select("role", "answer", "decided"), ["role"], "decided")
    return apply_confirmations(bindings, gated, last.select("role", "answer"))


# ------------------------------------------------------------- pack selection

WEIGHTS = {"entity": 0.35, "column": 0.35, "role": 0.20, "table_count": 0.10}
OUT_OF_RANGE = 0.3
ACCEPT_SCORE = 0.45
BLEND_SCORE, BLEND_MARGIN = 0.3, 0.12


def pack_scores(columns: DataFrame, packs: tuple[Pack, ...] = PACKS) -> DataFrame:
    """How well each pack suits a lake, from its table and column names and roles."""
    hints = [
        (p.slug, kind, hint)
        for p in packs
        for kind, words in (("entity", p.entity_hints), ("column", p.column_hints), ("role", p.required_roles))
        for hint in words
    ]
    cells = F.array(
        *[
            F.struct(F.lit(s).alias("pack"), F.lit(k).alias("kind"), F.lit(h.lower()).alias("hint"))
            for s, k, h in hints
        ]
    )
    text = (
        F.when(F.col("kind") == "entity", F.lower("table"))
        .when(F.col("kind") == "column", F.lower("column"))
        .otherwise(F.col("guessed_role"))
    )
    hit = F.when(F.col("kind") == "role", text == F.col("hint")).otherwise(text.contains(F.col("hint")))
    hits = (
        columns.select("table", "column", "guessed_role", F.inline(cells))
        .where(hit)
        .select("pack", "kind", "hint")
        .distinct()
        .groupBy("pack")
        .pivot("kind", ["entity", "column", "role"])
        .count()
    )
    spark = columns.sparkSession
    sizes = constant_rows(
        spark,
        [
            (p.slug, len(p.entity_hints), len(p.column_hints), len(p.required_roles), *p.table_count)
            for p in packs
        ],
        "pack string, entities int, names int, roles int, low int, high int",
    )
    tables = columns.agg(F.count_distinct("table").alias("tables"))

    def share(hits_of: str, total: str) -> Column:
        return F.when(F.col(total) > 0, F.coalesce(hits_of, F.lit(0)) / F.col(total)).otherwise(0.0)

    in_range = F.when(F.col("tables").between(F.col("low"), F.col("high")), 1.0).otherwise(OUT_OF_RANGE)
    score = (
        WEIGHTS["entity"] * share("entity", "entities")
        + WEIGHTS["column"] * share("column", "names")
        + WEIGHTS["role"] * share("role", "roles")
        + WEIGHTS["table_count"] * in_range
    )
    counted = sizes.withColumn("_one", F.lit(1)).join(tables.withColumn("_one", F.lit(1)), "_one")
    return counted.join(hits, "pack", "left").select("pack", rounded(score, 4).alias("score"))


def pack_ranking(scores: DataFrame) -> DataFrame:
    """Packs by score: primary, a close second, and whether to ask a person."""
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "pack")
    top = F.first("score").over(order)
    place = F.row_number().over(order)
    role = (
        F.when(F.col("place") == 1, "primary")
        .when(
            (F.col("place") == 2)
            & (F.col("score") >= BLEND_SCORE)
            & (F.col("top") - F.col("score") <= BLEND_MARGIN),
            "secondary",
        )
        .otherwise("other")
    )
    return scores.withColumn("place", place).withColumn("top", top).select(
        "pack", "score", "place", role.alias("choice"),
        ((F.col("place") == 1) & (F.col("score") < ACCEPT_SCORE)).alias("needs_confirmation"),
    )
