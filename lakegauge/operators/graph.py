"""The graph of tables: edges, bridges, the fact table, paths between tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakegauge.dataset import Dataset
from lakegauge.functions.storage import cut
from lakegauge.operators.relations import declared_edges, infer_relationships

MEASURE_ROLES = ("numeric", "currency")
DIMENSION_ROLES = ("categorical", "geographic", "boolean_flag")
TIME_ROLES = ("date", "datetime")

EDGE_COLUMNS = (
    "from_table", "from_column", "to_table", "to_column", "cardinality", "overlap_ratio",
    "orphan_ratio", "confidence", "origin", "verified", "fan_out_risk",
)


def fan_out_risk(cardinality: Column) -> Column:
    return cardinality.isin("1:N", "N:N")


def merge_edges(declared: DataFrame, inferred: DataFrame) -> DataFrame:
    """All declared edges, and inferred ones for columns without a declared edge."""
    stated = declared.select("from_table", "from_column").distinct()
    return declared.unionByName(
        inferred.join(stated, ["from_table", "from_column"], "left_anti"), allowMissingColumns=True
    )


def bridge_tables(edges: DataFrame, grains: DataFrame) -> DataFrame:
    """Tables that refer to two or more others and have no confident single key."""
    parents = edges.groupBy("from_table").agg(F.count_distinct("to_table").alias("parents"))
    keyed = grains.where((F.col("confidence") >= 0.8) & (F.size("grain_columns") == 1))
    return (
        parents.where("parents >= 2")
        .join(keyed, F.col("from_table") == keyed["table"], "left_anti")
        .select(F.col("from_table").alias("table"), "parents")
    )


def mark_bridges(edges: DataFrame, grains: DataFrame) -> DataFrame:
    """Edges that leave a bridge become ``N:N``; every edge gets its fan-out flag."""
    bridges = bridge_tables(edges, grains).select(
        F.col("table").alias("from_table"), F.lit(True).alias("_bridge")
    )
    marked = edges.join(bridges, "from_table", "left").withColumn(
        "cardinality", F.when(F.col("_bridge"), "N:N").otherwise(F.col("cardinality"))
    )
    return marked.drop("_bridge").withColumn("fan_out_risk", fan_out_risk(F.col("cardinality")))


def build_edges(
    ds: Dataset, frequency: DataFrame, structural: DataFrame, grains: DataFrame
) -> DataFrame:
    edges = infer_relationships(frequency, structural)
    if ds.declared_keys:
        edges = merge_edges(declared_edges(ds, frequency, structural), edges)
    edges = cut(edges, catalogue=True)
    return mark_bridges(edges.withColumn("verified", F.lit(True)), grains).select(*EDGE_COLUMNS)


def fact_scores(columns: DataFrame, edges: DataFrame, grains: DataFrame) -> DataFrame:
    """Score of every table that is not a bridge."""
    role = F.col("guessed_role")
    tables = columns.groupBy("table").agg(
        F.bool_or(role.isin(*MEASURE_ROLES)).alias("has_measure"),
        F.bool_or(role.isin(*TIME_ROLES)).alias("has_time"),
        F.max("row_count").alias("row_count"),
    )
    linked = edges.select(F.col("from_table").alias("table"), F.lit(1.0).alias("linked")).distinct()
    bridges = bridge_tables(edges, grains).select("table")
    score = (
        F.when(F.col("has_measure"), 2.0).otherwise(0.0)
        + F.when(F.col("has_time"), 2.0).otherwise(0.0)
        + F.coalesce("linked", F.lit(0.0))
        + F.col("row_count") / 1000.0
    )
    return (
        tables.join(linked, "table", "left")
        .join(bridges, "table", "left_anti")
        .select("table", score.alias("score"))
    )


def fact_table(columns: DataFrame, edges: DataFrame, grains: DataFrame) -> DataFrame:
    """The table with the highest score; equal scores go to the later name."""
    return (
        fact_scores(columns, edges, grains)
        .where("score > 0")
        .orderBy(F.desc("score"), F.desc("table"))
        .limit(1)
    )


def build_entities(columns: DataFrame, grains: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per table: role, keys, measures, dimensions and time columns."""
    role = F.col("guessed_role")

    def listed(test: Column) -> Column:
        found = F.sort_array(F.collect_list(F.when(test, F.struct("ordinal", "column"))))
        return F.transform(found, lambda c: c["column"])

    tables = columns.groupBy("table").agg(
        listed(role.isin(*MEASURE_ROLES) & ~F.col("is_identifier")).alias("measures"),
        listed(role.isin(*DIMENSION_ROLES)).alias("dimensions"),
        listed(role.isin(*TIME_ROLES)).alias("time_columns"),
        F.max("row_count").alias("row_count"),
    )
    bridges = bridge_tables(edges, grains).select("table", F.lit(True).alias("_bridge"))
    fact = fact_table(columns, edges, grains).select("table", F.lit(True).alias("_fact"))
    keys = grains.select(
        "table", F.col("grain_columns").alias("key_columns"), F.col("confidence").alias("grain_confidence")
    )
    kind = (
        F.when(F.col("_bridge"), "bridge")
        .when(F.col("_fact"), "fact")
        .when((F.col("grain_confidence") >= 0.8) & (F.size("key_columns") == 1), "dimension")
        .otherwise("unknown")
    )
    return (
        tables.join(keys, "table", "left")
        .join(bridges, "table", "left")
        .join(fact, "table", "left")
        .withColumn("role", kind)
        .drop("_bridge", "_fact")
    )


def both_directions(edges: DataFrame) -> DataFrame:
    """The edges and their reverses, with the cardinality turned round."""
    turned = (
        F.when(F.col("cardinality") == "N:1", "1:N")
        .when(F.col("cardinality") == "1:N", "N:1")
        .otherwise(F.col("cardinality"))
    )
    swapped = edges.select(
        F.col("to_table").alias("from_table"),
        F.col("to_column").alias("from_column"),
        F.col("from_table").alias("to_table"),
        F.col("from_column").alias("to_column"),
        turned.alias("cardinality"),
        *[c for c in edges.columns if c not in EDGE_COLUMNS[:5] and c != "fan_out_risk"],
    ).withColumn("fan_out_risk", fan_out_risk(F.col("cardinality")))
    return edges.unionByName(swapped.select(*edges.columns))


def join_paths(edges: DataFrame, start: str, max_hops: int | None = None) -> DataFrame:
    """Shortest path from ``start`` to every table it reaches over verified edges.

    Widens a frontier by one join per hop, so its work is bounded by tables
    times edges even where the number of distinct paths explodes.  Of equally
    short paths the one with the smallest edge names wins.
    """
    steps = both_directions(edges.where("verified")).select(
        "from_table",
        "to_table",
        F.struct("from_table", "from_column", "to_table", "to_column", "cardinality",
                 "confidence", "fan_out_risk").alias("edge"),
    )
    spark = edges.sparkSession
    start_row = spark.range(1).select(
        F.lit(start).alias("table"),
        F.lit(0).alias("hops"),
        F.array().cast(f"array<{steps.schema['edge'].dataType.simpleString()}>").alias("path"),
    )
    reached, frontier, hops = start_row, start_row, 0
    while max_hops is None or hops < max_hops:
        hops += 1
        nearest = Window.partitionBy("to_table").orderBy(
            F.transform("path", lambda e: F.concat_ws(".", e["from_table"], e["from_column"], e["to_table"], e["to_column"]))
        )
        wider = (
            frontier.join(steps, frontier["table"] == steps["from_table"])
            .join(reached.select(F.col("table").alias("to_table")), "to_table", "left_anti")
            .select("to_table", F.concat("path", F.array("edge")).alias("path"))
            .withColumn("_place", F.row_number().over(nearest))
            .where("_place = 1")
            .select(F.col("to_table").alias("table"), F.lit(hops).alias("hops"), "path")
        )
        frontier = cut(wider, catalogue=True)
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def safe_to_aggregate(paths: DataFrame) -> DataFrame:
    """Whether a measure may be summed along the path without being repeated."""
    risky = F.filter("path", lambda e: e["fan_out_risk"])
    reasons = F.transform(
        risky,
        lambda e: F.concat(
            e["from_table"], F.lit("."), e["from_column"], F.lit(" -> "), e["to_table"], F.lit("."),
            e["to_column"], F.lit(" ("), e["cardinality"],
            F.lit(") can duplicate a measure at the far end"),
        ),
    )
    return paths.select("table", "hops", (F.size(risky) == 0).alias("safe"), reasons.alias("reasons"))
