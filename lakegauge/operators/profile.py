"""Column profiles: one row per ``table.column`` for every table of a dataset."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakegauge.dataset import Dataset, column, quoted
from lakegauge.functions import text as X
from lakegauge.functions.numbers import rounded
from lakegauge.functions.percentiles import exact_percentiles
from lakegauge.functions.storage import cut, cut_parts
from lakegauge.functions.types import NUMERIC
from lakegauge.operators.frequency import frequency_parts, stacked, named, value_frequency

SAMPLE_VALUES = 5
ENUM_VALUES = 20
TOP_VALUES = 8
MASK = "[REDACTED-PII]"

# --- fixed values: name hints of the second-level role ---
MEASURE_NAME_HINTS = (
    "amount", "price", "cost", "revenue", "fee", "salary", "total", "balance", "quantity", "qty",
    "count", "units", "value", "score", "discount", "tax", "payment", "order_total", "unit_price",
)
DIMENSION_NAME_HINTS = ("age", "year", "month", "day", "rating", "score", "level", "grade")
STATUS_NAME_HINTS = ("status", "state", "flag")
# --- end of fixed values ---


# ------------------------------------------------------------------ statistics


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, rounded(part * F.lit(100.0) / whole, 2)).otherwise(F.lit(0.0))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.least(rounded(part.cast("double") / whole, 4), F.lit(1.0))).otherwise(
        F.lit(0.0)
    )


def column_stats(ds: Dataset, frequency: DataFrame) -> DataFrame:
    """Counts, distinct ratio, range and date test of every column.

    Aggregates the frequency table by column number: partial sums per task,
    then one row per column.
    """
    value, n = F.col("value"), F.col("n")
    text_ids = [c.column_id for c in ds.columns if c.family == "text"]
    is_text = F.col("column_id").isin(text_ids) if text_ids else F.lit(False)
    stats = frequency.groupBy("column_id").agg(
        F.sum(n).alias("row_count"),
        F.coalesce(F.sum(F.when(value.isNull(), n)), F.lit(0)).alias("null_count"),
        F.count(value).alias("cardinality"),
        F.min("number").alias("min_value"),
        F.max("number").alias("max_value"),
        F.count_if(F.when(is_text & value.isNotNull(), X.is_date_text(value))).alias("_dates"),
    )
    # an empty table has no row in the frequency table; its columns count zero
    joined = F.broadcast(ds.catalog).join(stats, "column_id", "left")
    counted = joined.fillna(0, ["row_count", "null_count", "cardinality", "_dates"])
    rows, card = F.col("row_count"), F.col("cardinality")
    return counted.select(
        *ds.catalog.columns,
        "row_count",
        "null_count",
        "cardinality",
        _percent(F.col("null_count"), rows).alias("null_percent"),
        _ratio(card, rows).alias("distinct_ratio"),
        "min_value",
        "max_value",
        ((card > 0) & (F.col("_dates") == card)).alias("looks_temporal"),
    )


def approximate_stats(ds: Dataset) -> DataFrame:
    """Null percent and sketched cardinality in one scan without a wide shuffle."""
    cells = stacked(ds, lambda c: True, lambda c: [f"xxhash64({quoted(c.column)})", f"{quoted(c.column)} is null"], ("h", "missing"))
    stats = cells.groupBy("column_id").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if("missing").alias("null_count"),
        F.approx_count_distinct(F.when(~F.col("missing"), F.col("h")), 0.01).alias("cardinality"),
    )
    rows = F.col("row_count")
    return named(
        stats.select(
            "column_id",
            _percent(F.col("null_count"), rows).alias("null_percent"),
            F.least(F.col("cardinality"), rows).alias("cardinality"),
        ),
        ds,
    )


def min_max(ds: Dataset) -> DataFrame:
    """Range of every numeric column: one aggregate per table, no wide shuffle."""
    cells = stacked(
        ds, lambda c: c.family in NUMERIC, lambda c: [f"cast({quoted(c.column)} as double)"], ("v",)
    )
    ranges = cells.groupBy("column_id").agg(
        F.min("v").alias("min_value"), F.max("v").alias("max_value")
    )
    return named(ranges, ds)


def quartiles(ds: Dataset) -> DataFrame:
    """Exact p25, p50 and p75 of every numeric column, rounded to 4 decimals."""
    cells = stacked(
        ds, lambda c: c.family in NUMERIC, lambda c: [f"cast({quoted(c.column)} as double)"], ("v",)
    )
    found = exact_percentiles(cells, ["column_id"], "v", [0.25, 0.5, 0.75], few_groups=True)
    return named(
        found.groupBy("column_id").agg(
            *[
                F.round(F.max(F.when(F.col("point") == p, F.col("value"))), 4).alias(name)
                for p, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))
            ]
        ),
        ds,
    )


# --------------------------------------------------------------- picked values


def top_values(ds: Dataset, frequency: DataFrame, k: int = TOP_VALUES) -> DataFrame:
    """The ``k`` most frequent values of each column: ``column_id, rank, value, n``.

    Ties go to the smaller value.  The rank filter lets Spark cut each task's
    share to ``k`` rows per column before the shuffle.
    """
    order = Window.partitionBy("column_id").orderBy(F.desc("n"), "value")
    return (
        frequency.where(F.col("value").isNotNull())
        .select("column_id", "value", "n", F.row_number().over(order).alias("rank"))
        .where(F.col("rank") <= k)
    )


def distinct_samples(ds: Dataset, frequency: DataFrame, k: int = SAMPLE_VALUES) -> DataFrame:
    """The first ``k`` distinct values of each column in ascending order."""
    order = Window.partitionBy("column_id").orderBy("value")
    return (
        frequency.where(F.col("value").isNotNull())
        .select("column_id", "value", F.row_number().over(order).alias("rank"))
        .where(F.col("rank") <= k)
    )


def value_facts(frequency: DataFrame) -> DataFrame:
    """What the formats need to know of all distinct values of a column, one row per column."""
    value = F.col("value")
    trimmed = F.trim(value)
    blank = trimmed == ""

    def all_match(pattern: str) -> Column:
        return F.bool_and(F.when(~blank, trimmed.rlike(pattern)).otherwise(F.lit(True)))

    return frequency.where(value.isNotNull()).groupBy("column_id").agg(
        F.avg(F.length("value")).alias("mean_length"),
        all_match(X.PHONE_PATTERN).alias("all_phone"),
        all_match(X.AADHAAR_PATTERN).alias("all_aadhaar"),
        all_match(X.PAN_PATTERN).alias("all_pan"),
        all_match(X.URL_PATTERN).alias("all_url"),
        F.bool_and(value.rlike(X.UUID_PATTERN)).alias("all_uuid"),
        (F.bool_or(~blank) & all_match(X.CURRENCY_SIGN_PATTERN)).alias("all_currency"),
        (
            F.bool_or(~blank)
            & F.bool_and(F.when(~blank, F.lower(trimmed).isin(*X.BOOLEAN_WORDS)).otherwise(True))
        ).alias("all_boolean"),
    )


# ------------------------------------------------------------------------ roles


def guess_role(stats: DataFrame) -> DataFrame:
    """Role from type and values alone, the first matching rule wins."""
    rows, card = F.col("row_count"), F.col("cardinality")
    kind = F.col("family")
    few = F.greatest(F.lit(1), F.least(F.lit(30), F.floor(rows / 2)))
    role = (
        F.when(kind == "boolean", "boolean_flag")
        .when(kind == "temporal", F.when(F.col("dtype") == "date", "date").otherwise("datetime"))
        .when(
            kind.isin(*NUMERIC),
            F.when((rows > 0) & (card <= 2), "boolean_flag").otherwise("numeric"),
        )
        .when(F.col("looks_temporal"), "date")
        .when((rows > 0) & (card <= few), "categorical")
        .otherwise("free_text")
    )
    return stats.withColumn("guessed_role", role)


def mark_identifiers(roles: DataFrame) -> DataFrame:
    """Columns without nulls whose values are all distinct become identifiers."""
    unique = (
        (F.col("row_count") > 0)
        & (F.col("null_count") == 0)
        & (F.col("cardinality") == F.col("row_count"))
    )
    promoted = F.when(
        unique & F.col("guessed_role").isin("numeric", "categorical", "free_text"), "identifier"
    ).otherwise(F.col("guessed_role"))
    return roles.withColumn("is_identifier", unique).withColumn("guessed_role", promoted)


def keep_one_identifier(identified: DataFrame) -> DataFrame:
    """Of several identifiers in a table keep one, the others become free text.

    An integer or UUID-shaped column wins over the rest, then column order.
    Needs ``all_uuid`` from :func:`value_facts`.
    """
    rival = F.col("guessed_role") == "identifier"
    shaped = (F.col("family") == "integer") | F.coalesce("all_uuid", F.lit(False))
    order = Window.partitionBy("table", rival).orderBy(shaped.desc(), "ordinal")
    ranked = identified.withColumn("_place", F.row_number().over(order))
    demoted = rival & (F.col("_place") > 1)
    return (
        ranked.withColumn("is_identifier", F.col("is_identifier") & ~demoted)
        .withColumn(
            "guessed_role", F.when(demoted, "free_text").otherwise(F.col("guessed_role"))
        )
        .drop("_place")
    )


def mark_personal(columns: DataFrame, enabled: bool = True) -> DataFrame:
    """Flag personal-data columns by name, or by an email or phone role."""
    if not enabled:
        return columns.withColumn("is_pii", F.lit(False))
    flagged = F.col("guessed_role").isin("email", "phone") | X.personal_column_name(F.col("column"))
    return columns.withColumn("is_pii", flagged)


def promote_labels(columns: DataFrame, grains: DataFrame) -> DataFrame:
    """Free text that labels a dimension, or has few values, becomes categorical."""
    rows, card = F.col("row_count"), F.col("cardinality")
    single = grains.where((F.col("confidence") >= 0.8) & (F.size("grain_columns") == 1)).select(
        "table", F.lit(True).alias("_single_key")
    )
    labels_rows = (
        F.coalesce("_single_key", F.lit(False))
        & (card == rows)
        & (F.coalesce("mean_length", F.lit(0.0)) < 60)
    )
    few = F.greatest(F.lit(2), F.least(F.lit(50), F.floor(F.sqrt(rows.cast("double"))) * 3))
    promoted = (
        (F.col("guessed_role") == "free_text")
        & ~F.col("is_pii")
        & (labels_rows | ((rows > 0) & (card <= few)))
    )
    return (
        columns.join(single, "table", "left")
        .withColumn(
            "guessed_role", F.when(promoted, "categorical").otherwise(F.col("guessed_role"))
        )
        .drop("_single_key")
    )


def with_fingerprint(columns: DataFrame) -> DataFrame:
    """Format of a column's values; every rule needs all values to agree.

    A 12-digit number already counts as a phone, so the phone rule comes first.
    """
    role, card = F.col("guessed_role"), F.col("cardinality")

    def says(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    low = F.col("min_value").cast("bigint")
    mean_length = F.coalesce("mean_length", F.lit(0.0))
    found = (
        F.when(
            role.isin("date", "datetime"),
            F.when(F.col("dtype").startswith("timestamp"), "iso_datetime").otherwise("iso_date"),
        )
        .when(role == "email", "email")
        .when((role == "phone") | says("all_phone"), "phone")
        .when(says("all_aadhaar") & (card > 5), "aadhaar")
        .when(says("all_pan"), "pan")
        .when(says("all_url"), "url")
        .when(says("all_boolean") & (card <= 3), "boolean_str")
        .when(
            F.col("family").isin(*NUMERIC)
            & (
                low.between(1_000_000_000, 2_000_000_000)
                | low.between(1_000_000_000_000, 2_000_000_000_000)
            ),
            "epoch",
        )
        .when(says("all_currency"), "currency")
        .when(says("all_uuid"), "uuid")
        .when((role == "categorical") & (card <= 12) & (mean_length < 40), "enum")
        .when(
            (role == "categorical") & (card <= 20) & (F.coalesce("mean_length", F.lit(999.0)) < 25),
            "enum",
        )
    )
    unsure = found.isNull() & (
        role.isin("numeric", "free_text") | ((role == "categorical") & (card > 20))
    )
    return columns.withColumn("fingerprint", found).withColumn("ambiguous", unsure)


def with_second_role(columns: DataFrame) -> DataFrame:
    """Measure, dimension, identifier, timestamp, status, text or unknown."""
    role, mark, name = F.col("guessed_role"), F.col("fingerprint"), F.lower("column")
    numeric = (
        F.when(X.contains_any(name, MEASURE_NAME_HINTS), "measure")
        .when(X.contains_any(name, DIMENSION_NAME_HINTS), "dimension")
        .otherwise("measure")
    )
    listed = F.when(
        X.contains_any(name, STATUS_NAME_HINTS) | (mark == "boolean_str"), "status"
    ).otherwise("dimension")
    second = (
        F.when(role == "identifier", "identifier")
        .when(role.isin("date", "datetime") | mark.isin("iso_date", "iso_datetime", "epoch"), "timestamp")
        .when(mark.isin("aadhaar", "pan", "phone", "uuid"), "identifier")
        .when((mark == "currency") | (role == "currency") | (mark == "percent"), "measure")
        .when(role == "numeric", numeric)
        .when(mark.isin("enum", "boolean_str"), listed)
        .when(role == "categorical", F.when(name.contains("status"), "status").otherwise("dimension"))
        .when(role == "free_text", "text")
        .when(role.isin("email", "phone", "geographic"), "dimension")
        .when(role == "boolean_flag", "status")
        .otherwise("unknown")
    )
    return columns.withColumn("understanding_role", second)


# ---------------------------------------------------------------- whole profile


def structural_columns(
    ds: Dataset, frequency: DataFrame | None = None, pii: bool = True
) -> DataFrame:
    """The profile before grain and label promotion, as one lazy plan."""
    frequency = value_frequency(ds) if frequency is None else frequency
    textual = [c.column_id for c in ds.columns if c.family not in NUMERIC]
    facts = value_facts(frequency.where(F.col("column_id").isin(textual) if textual else F.lit(False)))
    identified = mark_identifiers(guess_role(column_stats(ds, frequency)))
    return mark_personal(keep_one_identifier(identified.join(facts, "column_id", "left")), pii)


class Profile:
    """Everything known about a dataset, each part computed once on demand.

    The frequency table and the profile are written to the session's shared
    folder when first needed, because many parts read them.
    """

    def __init__(self, ds: Dataset, pii: bool = True) -> None:
        self.ds = ds
        self.pii = pii

    @cached_property
    def frequency(self) -> DataFrame:
        return cut_parts(frequency_parts(self.ds))

    @cached_property
    def structural(self) -> DataFrame:
        return cut(structural_columns(self.ds, self.frequency, self.pii), catalogue=True)

    @cached_property
    def grains(self) -> DataFrame:
        from lakegauge.operators.grain import infer_grains

        return cut(infer_grains(self.ds, self.structural), catalogue=True)

    @cached_property
    def columns(self) -> DataFrame:
        labelled = promote_labels(self.structural, self.grains)
        return cut(with_second_role(with_fingerprint(labelled)), catalogue=True)

    @cached_property
    def edges(self) -> DataFrame:
        from lakegauge.operators.graph import build_edges

        return cut(build_edges(self.ds, self.frequency, self.structural, self.grains), catalogue=True)

    @cached_property
    def entities(self) -> DataFrame:
        from lakegauge.operators.graph import build_entities

        return cut(build_entities(self.columns, self.grains, self.edges), catalogue=True)

    @cached_property
    def quartiles(self) -> DataFrame:
        return quartiles(self.ds)

    def data_map(self) -> DataFrame:
        """One record per column: profile, quartiles, top values, grain, entity role."""
        counts = (
            top_values(self.ds, self.frequency)
            .groupBy("column_id")
            .agg(F.sort_array(F.collect_list(F.struct("rank", "value", "n"))).alias("_top"))
        )
        listed = F.when(
            ~F.col("is_pii"),
            F.transform("_top", lambda t: F.struct(t["value"].alias("value"), t["n"].alias("count"))),
        )
        role = self.entities.select("table", F.col("role").alias("entity_role"))
        grain = self.grains.select("table", F.col("description").alias("grain"))
        return (
            self.columns.join(counts, "column_id", "left")
            .join(self.quartiles, ["table", "column"], "left")
            .join(role, "table", "left")
            .join(grain, "table", "left")
            .withColumn("top_values", listed)
            .drop("_top", "column_id", "family", "join_family")
        )


def vocabulary(ds: Dataset, frequency: DataFrame, columns: DataFrame) -> DataFrame:
    """All values and counts of enum-like columns, which have at most ``ENUM_VALUES`` by definition."""
    listed = columns.where(
        ~F.col("is_pii")
        & (
            (F.col("fingerprint") == "enum")
            | ((F.col("guessed_role") == "categorical") & (F.col("cardinality") <= ENUM_VALUES))
        )
    ).select("column_id", "table", "column")
    return top_values(ds, frequency, ENUM_VALUES).join(listed, "column_id").drop("column_id")


def data_profile(ds: Dataset, table: str, denied: tuple[str, ...] = ()) -> DataFrame:
    """Null percent and cardinality of one table's columns, denied ones left out."""
    one = Dataset({table: ds.table(table).drop(*denied)})
    stats = column_stats(one, value_frequency(one))
    return stats.select("column", "null_percent", "cardinality")


def inspect_column(
    ds: Dataset, columns: DataFrame, table: str, name: str, denied: tuple[str, ...] = (), k: int = 15
) -> DataFrame:
    """One column's profile row with up to ``k`` distinct values, none if personal."""
    check_column(ds, table, name, denied)
    one = Dataset({table: ds.table(table).select(column(name))})
    values = (
        distinct_samples(one, value_frequency(one), k)
        .groupBy(F.lit(table).alias("table"))
        .agg(F.sort_array(F.collect_list("value")).alias("sample_values"))
    )
    card = columns.where((F.col("table") == table) & (F.col("column") == name)).select(
        "table", "column", "dtype", "null_percent", "cardinality", "distinct_ratio",
        "min_value", "max_value", "guessed_role", "is_pii",
    )
    empty = F.array().cast("array<string>")
    shown = F.when(F.col("is_pii"), empty).otherwise(F.coalesce("sample_values", empty))
    return card.join(values, "table", "left").withColumn("sample_values", shown)


def compare_columns(ds: Dataset, columns: DataFrame, table: str, names: list[str]) -> DataFrame:
    for name in names:
        check_column(ds, table, name)
    return columns.where((F.col("table") == table) & F.col("column").isin(*names)).select(
        "column", "dtype", "guessed_role", "min_value", "max_value", "cardinality", "null_percent"
    )


def masked_sample(ds: Dataset, table: str, personal: set[str], order_by: list[str], k: int = 3) -> DataFrame:
    """The first ``k`` rows in key order, personal columns replaced by a marker."""
    rows = ds.table(table).orderBy(*[column(c) for c in order_by]).limit(k)
    return rows.select(
        *[
            (F.lit(MASK) if c in personal else column(c)).alias(c)
            for c in ds.table(table).columns
        ]
    )


def check_column(ds: Dataset, table: str, name: str, denied: tuple[str, ...] = ()) -> None:
    """Refuse unknown and denied columns before any plan is built."""
    known = ds.table(table).columns
    if name not in known:
        raise ValueError(f"unknown column {table}.{name}; columns: {known}")
    if name.lower() in {d.lower() for d in denied}:
        raise ValueError(f"column {table}.{name} is denied")


def denied_columns(columns: DataFrame) -> DataFrame:
    """Personal columns of each table: the one list every consumer drops."""
    return (
        columns.where("is_pii")
        .groupBy("table")
        .agg(F.sort_array(F.collect_set("column")).alias("denied"))
    )


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
