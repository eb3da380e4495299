"""Foreign keys found in the values: candidates, overlap and edge facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakegauge.dataset import Dataset, column, constant_rows
from lakegauge.functions.numbers import rounded
from lakegauge.functions.storage import cut
from lakegauge.functions.text import name_similarity
from lakegauge.functions.types import join_family

MIN_OVERLAP = 0.5
MIN_OVERLAP_UNLIKE_NAMES = 0.8
MIN_SIMILARITY = 0.3
CLEAR_SIMILARITY = 0.5
MAX_CHILD_EXCESS = 1.2
FEW_VALUES_SHARE = 0.8


def _is_key() -> Column:
    return (
        F.col("is_identifier")
        & (F.col("null_count") == 0)
        & (F.col("row_count") > 0)
        & (F.col("cardinality") == F.col("row_count"))
    )


def _side(structural: DataFrame, prefix: str) -> DataFrame:
    return structural.select(
        F.col("column_id").alias(f"{prefix}_id"),
        F.col("table").alias(f"{prefix}_table"),
        F.col("column").alias(f"{prefix}_column"),
        *[
            F.col(c).alias(f"{prefix}_{c}")
            for c in ("join_family", "cardinality", "row_count", "null_count", "is_identifier",
                      "min_value", "max_value")
        ],
    )


_PAIR = ("from_id", "from_table", "from_column", "to_id", "to_table", "to_column",
         "from_cardinality", "from_row_count", "from_null_count")


def same_name_candidates(structural: DataFrame) -> DataFrame:
    """Identifier pairs of the same name in two tables; the parent is a key."""
    parents = _side(structural.where(_is_key()), "to")
    children = _side(structural.where("is_identifier"), "from")
    pairs = children.join(
        parents,
        (F.lower("from_column") == F.lower("to_column")) & (F.col("from_table") != F.col("to_table")),
    )
    return pairs.select(*_PAIR, F.lit("same_name").alias("origin"), F.lit(1.0).alias("similarity"))


def similar_candidates(structural: DataFrame) -> DataFrame:
    """Key columns against every other column that could refer to them.

    Pairs are dropped by type, name, size and value range on the small profile
    table, before any value is compared.
    """
    parents = _side(structural.where(_is_key()), "to")
    children = _side(structural, "from")
    similarity = F.greatest(
        name_similarity(F.col("from_column"), F.col("to_column")),
        name_similarity(F.col("from_column"), F.col("to_table")),
    )
    already = F.col("from_is_identifier") & (F.lower("from_column") == F.lower("to_column"))
    apart = (F.col("from_min_value") > F.col("to_max_value")) | (
        F.col("from_max_value") < F.col("to_min_value")
    )
    pairs = children.join(
        parents,
        (F.col("from_join_family") == F.col("to_join_family"))
        & (F.col("from_table") != F.col("to_table"))
        & (F.col("from_cardinality") <= F.col("to_row_count") * MAX_CHILD_EXCESS)
        & ~already
        & ~F.coalesce(apart, F.lit(False)),
    ).withColumn("similarity", similarity)
    likely = (
        (F.col("similarity") >= MIN_SIMILARITY)
        | F.col("from_is_identifier")
        | (F.col("from_cardinality") < F.col("from_row_count") * FEW_VALUES_SHARE)
    )
    return pairs.where(likely).select(*_PAIR, F.lit("similar").alias("origin"), "similarity")


def edge_facts(frequency: DataFrame, pairs: DataFrame) -> DataFrame:
    """Overlap, cardinality and orphan ratio of all candidate pairs in one job.

    Each value has one posting: the sorted numbers of the parent columns that
    hold it.  A deduplicated child value meets its posting once, and what its
    own column is paired with is read off it; rows are counted by the parents
    met before these are taken apart, so that no row is multiplied by the number
    of candidate parents.
    """
    values = frequency.where(F.col("value").isNotNull())
    wanted = pairs.groupBy(F.col("from_id").alias("column_id")).agg(F.array_sort(F.collect_set("to_id")).alias("wanted"))
    parent_ids = pairs.select(F.col("to_id").alias("column_id")).distinct()
    children = values.join(wanted, "column_id").select(F.col("column_id").alias("from_id"), "value", "n", "wanted")
    postings = values.join(parent_ids, "column_id", "left_semi").groupBy("value").agg(F.array_sort(F.collect_set("column_id")).alias("held"))
    met = (
        children.join(postings, "value")
        .withColumn("to_ids", F.array_intersect("wanted", "held"))
        .where(F.size("to_ids") > 0)
        .groupBy("from_id", "to_ids")
        .agg(F.count(F.lit(1)).alias("_values"), F.sum("n").alias("_rows"))
        .select("from_id", F.explode("to_ids").alias("to_id"), "_values", "_rows")
        .groupBy("from_id", "to_id")
        .agg(F.sum("_values").alias("_values"), F.sum("_rows").alias("_rows"))
    )
    filled = F.col("from_row_count") - F.col("from_null_count")
    overlap = F.coalesce("_values", F.lit(0)) / F.col("from_cardinality")
    return (
        pairs.join(met, ["from_id", "to_id"], "left")
        .withColumn(
            "overlap_ratio", F.when(F.col("from_cardinality") > 0, overlap).otherwise(F.lit(0.0))
        )
        .withColumn(
            "cardinality",
            F.when((filled > 0) & (F.col("from_cardinality") == filled), "1:1").otherwise("N:1"),
        )
        .withColumn(
            "orphan_ratio",
            F.when(
                filled > 0, rounded((filled - F.coalesce("_rows", F.lit(0))) / filled, 4)
            ).otherwise(F.lit(0.0)),
        )
        .drop("_values", "_rows")
    )


def accepted(facts: DataFrame) -> DataFrame:
    """Pairs whose overlap is high enough, with their confidence and place.

    ``best_parent`` is 1 for the most trusted parent of each child column, for
    callers who want one parent although small integer ranges match many.
    """
    overlap, similarity = F.col("overlap_ratio"), F.col("similarity")
    needed = F.when(
        (F.col("origin") == "same_name") | (similarity >= CLEAR_SIMILARITY), MIN_OVERLAP
    ).otherwise(MIN_OVERLAP_UNLIKE_NAMES)
    confidence = F.when(F.col("origin") == "same_name", rounded(overlap, 3)).otherwise(
        rounded(overlap * (0.7 + 0.3 * similarity), 3)
    )
    place = Window.partitionBy("from_id").orderBy(
        F.desc("confidence"), F.desc("similarity"), "to_table", "to_column"
    )
    return (
        facts.where(overlap >= needed)
        .withColumn("confidence", confidence)
        .withColumn("best_parent", F.row_number().over(place))
    )


def infer_relationships(frequency: DataFrame, structural: DataFrame) -> DataFrame:
    return accepted(edge_facts(frequency, candidate_pairs(structural)))


def candidate_pairs(structural: DataFrame) -> DataFrame:
    """All pairs worth measuring, written once because every step reads them."""
    every = same_name_candidates(structural).unionByName(similar_candidates(structural))
    return cut(every, catalogue=True)


def declared_pairs(ds: Dataset, structural: DataFrame) -> DataFrame:
    """The source's own foreign keys as candidate pairs of confidence 1."""
    keys = constant_rows(
        ds.spark,
        [(k.from_table, k.from_column, k.to_table, k.to_column) for k in ds.declared_keys],
        "from_table string, from_column string, to_table string, to_column string",
    )
    known = _side(structural, "from").join(keys, ["from_table", "from_column"])
    parents = _side(structural, "to").select("to_id", "to_table", "to_column")
    return known.join(parents, ["to_table", "to_column"]).select(
        *_PAIR, F.lit("declared").alias("origin"), F.lit(1.0).alias("similarity")
    )


def declared_edges(ds: Dataset, frequency: DataFrame, structural: DataFrame) -> DataFrame:
    facts = edge_facts(frequency, declared_pairs(ds, structural))
    return facts.withColumn("confidence", F.lit(1.0)).withColumn("best_parent", F.lit(1))


def check_relationship(
    ds: Dataset, from_table: str, from_column: str, to_table: str, to_column: str
) -> DataFrame:
    """Facts of one supposed join; values of one kind compare natively."""
    child, parent = ds.table(from_table), ds.table(to_table)
    for table, name in ((from_table, from_column), (to_table, to_column)):
        if name not in ds.table(table).columns:
            raise ValueError(f"unknown column {table}.{name}")
    left, right = column(from_column), column(to_column)
    if join_family(child.schema[from_column].dataType) != join_family(parent.schema[to_column].dataType):
        left, right = left.cast("string"), right.cast("string")
    values = child.groupBy(left.alias("v")).agg(F.count(F.lit(1)).alias("n")).where("v is not null")
    keys = parent.select(right.alias("v")).where("v is not null").distinct().withColumn("met", F.lit(1))
    met = F.col("met").isNotNull()
    counts = values.join(keys, "v", "left").agg(
        F.count(F.lit(1)).alias("values"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count_if(met).alias("met_values"),
        F.coalesce(F.sum(F.when(~met, F.col("n"))), F.lit(0)).alias("orphans"),
    )
    overlap = F.when(F.col("values") > 0, rounded(F.col("met_values") / F.col("values"), 4)).otherwise(0.0)
    return counts.select(
        F.lit(from_table).alias("from_table"),
        F.lit(from_column).alias("from_column"),
        F.lit(to_table).alias("to_table"),
        F.lit(to_column).alias("to_column"),
        overlap.alias("overlap_ratio"),
        F.when((F.col("rows") > 0) & (F.col("values") == F.col("rows")), "1:1")
        .otherwise("N:1")
        .alias("cardinality"),
        F.when(F.col("rows") > 0, rounded(F.col("orphans") / F.col("rows"), 4))
        .otherwise(0.0)
        .alias("orphan_ratio"),
        (overlap >= MIN_OVERLAP).alias("verified"),
    )
