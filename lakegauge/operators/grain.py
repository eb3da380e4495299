"""What one row of a table stands for: single, composite or near-unique keys."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import chain, combinations
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakegauge.dataset import Dataset, column, constant_rows, quoted
from lakegauge.functions.storage import shuffles_freed

# defaults that the results depend on; callers may widen the search
MAX_KEY_CANDIDATES = 6
WIDEST_KEY = 3
# keys that the first look at a table compares
SLICE_KEYS = 16_000
# how much larger each further look at combinations that are left is
GROWTH = 32
# rows of a table from which on all its keys are compared in so many passes, a power of two, each over a slice
PASS_FROM, PASSES = 4_000_000, 4
COMBO = "_grain_combo"

GRAIN_SCHEMA = "table string, grain_columns array<string>, description string, confidence double"


def single_keys(structural: DataFrame) -> DataFrame:
    """Tables with an identifier column: the first one in column order."""
    keys = structural.where(
        F.col("is_identifier")
        & (F.col("null_count") == 0)
        & (F.col("row_count") > 0)
        & (F.col("cardinality") == F.col("row_count"))
    )
    first = keys.groupBy("table").agg(F.min_by("column", "ordinal").alias("key"))
    return first.select(
        "table",
        F.array("key").alias("grain_columns"),
        F.concat(F.lit("One row per unique "), F.col("key")).alias("description"),
        F.lit(0.9).alias("confidence"),
    )


def near_unique_keys(structural: DataFrame) -> DataFrame:
    """The column closest to unique, from a distinct ratio of 0.99 on."""
    near = structural.where(
        (F.col("distinct_ratio") >= 0.99) & (F.col("cardinality") < F.col("row_count"))
    )
    best = near.groupBy("table").agg(
        F.max_by(
            F.struct("column", "distinct_ratio", (F.col("row_count") - F.col("cardinality")).alias("extra")),
            F.struct("distinct_ratio", -F.col("ordinal")),
        ).alias("k")
    )
    return best.select(
        "table",
        F.array("k.column").alias("grain_columns"),
        F.format_string(
            "One row per %s (near-unique: %.1f%% distinct, %d duplicates — check for dupes)",
            "k.column",
            F.col("k.distinct_ratio") * 100,
            "k.extra",
        ).alias("description"),
        F.lit(0.6).alias("confidence"),
    )


def full_row(structural: DataFrame) -> DataFrame:
    columns = F.sort_array(F.collect_list(F.struct("ordinal", "column")))
    return structural.groupBy("table").agg(columns.alias("c")).select(
        "table",
        F.transform("c", lambda c: c["column"]).alias("grain_columns"),
        F.lit("No single-column unique identifier found; grain is the full row").alias("description"),
        F.lit(0.3).alias("confidence"),
    )


@dataclass(frozen=True)
class Candidates:
    """A table's columns that may be part of a key, most distinct first, with their numbers of different values."""

    table: str
    rows: int
    cardinality: dict[str, int]
    nullable: frozenset[str] = frozenset()
    marked: frozenset[str] = frozenset()

    def combinations(self, widest: int) -> list[tuple[str, ...]]:
        """Pairs, triples and so on without nulls; fewer combinations of values than rows cannot be unique."""
        whole = [c for c in self.cardinality if c not in self.nullable]
        every = chain.from_iterable(combinations(whole, size) for size in range(2, widest + 1))
        return [c for c in every if prod(self.cardinality[k] for k in c) >= self.rows]


def _joined(combo: tuple[str, ...]) -> str:
    """The key as SQL: its columns' texts joined by pipes."""
    return " || '|' || ".join(f"cast({quoted(c)} as string)" for c in combo)


def _keys(ds: Dataset, asked: list[tuple[Candidates, tuple[str, ...]]], slices: dict[str, int] | None = None) -> DataFrame:
    """``combo, key, h`` of the asked combinations of all tables, each table read once; ``h`` is the key's hash, null for a null key.

    ``slices`` gives each table the number of slices, a power of two, that its
    keys are dealt to by hash, plus the number of one slice, from 0 on; only that
    slice's keys are kept, and only kept keys become texts.
    """
    parts = []
    for table in dict.fromkeys(c.table for c, _ in asked):
        own = [(i, combo) for i, (c, combo) in enumerate(asked) if c.table == table]
        names = list(dict.fromkeys(chain.from_iterable(combo for _, combo in own)))
        rows = ds.table(table).select(*map(column, names))
        if slices and slices[table] > 1:
            of = 1 << slices[table].bit_length() - 1
            hashed = {name: f"xxhash64({k}, {quoted(name)})" for k, name in enumerate(names)}
            inside = {i: f"(({' ^ '.join(hashed[c] for c in combo)}) & {of - 1}) = {slices[table] - of}" for i, combo in own}
            rows = rows.where(" or ".join(inside.values()))  # most rows are in no slice
            cells = ", ".join(f"if({test}, {i}, null)" for i, test in inside.items())
            rows = rows.withColumn(COMBO, F.explode(F.expr(f"array_compact(array({cells}))")))
        else:
            rows = rows.withColumn(COMBO, F.explode(F.array(*[F.lit(i) for i, _ in own])))
        key = " ".join(f"when {i} then {_joined(combo)}" for i, combo in own)
        parts.append(rows.selectExpr(f"{COMBO} as combo", f"case {COMBO} {key} end as key"))
    keys = reduce(DataFrame.unionAll, parts)
    return keys.withColumn("h", F.when(F.col("key").isNotNull(), F.xxhash64("key")))


def _repeated(ds: Dataset, asked: list[tuple[Candidates, tuple[str, ...]]], slices: dict[str, int] | None = None) -> set[int]:
    """Numbers of the combinations with a repeated or null key, for certain.

    Only the keys' hashes cross the network.  Keys whose hashes all differ all
    differ; of a combination with a repeated hash the texts behind the smallest
    one are counted, and should they differ, all its texts.
    """
    with shuffles_freed(ds.spark):
        keys = _keys(ds, asked, slices)
        counted = keys.groupBy("combo", "h").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col("h").isNull())
        twice = counted.groupBy("combo").agg(F.min("h").alias("h"), F.count_if(F.col("h").isNull()).alias("missing")).collect()
        refuted = {r["combo"] for r in twice if r["missing"]}
        unsure = [r for r in twice if not r["missing"]]
        if unsure:
            behind = reduce(Column.__or__, [(F.col("combo") == r["combo"]) & (F.col("h") == r["h"]) for r in unsure])
            refuted |= _same_texts(keys.where(behind))
            if collided := [r["combo"] for r in unsure if r["combo"] not in refuted]:
                refuted |= _same_texts(keys.where(F.col("combo").isin(collided)))
        return refuted


def _same_texts(keys: DataFrame) -> set[int]:
    counted = keys.groupBy("combo", "key").agg(F.count(F.lit(1)).alias("n"))
    return {r["combo"] for r in counted.where("n > 1").select("combo").distinct().collect()}


def _slices(rows: int, slice_keys: int) -> int:
    """The power of two nearest below ``rows / slice_keys``, one for small tables."""
    return 1 << max(0, (rows // slice_keys).bit_length() - 1)


def _left(ds: Dataset, asked: list[tuple[Candidates, tuple[str, ...]]], slice_keys: int | None = None) -> list[tuple[Candidates, tuple[str, ...]]]:
    """The asked combinations that one slice of about ``slice_keys`` rows, or else all rows, do not refute.

    All rows of a large table are gone through a slice after the other, each in
    one of the passes: the disk then holds the hashes of one slice.
    """
    if slice_keys:
        return _kept(ds, asked, {c.table: _slices(c.rows, slice_keys) for c, _ in asked})
    passes = {c.table: PASSES if c.rows >= PASS_FROM else 1 for c, _ in asked}
    for k in range(PASSES):
        now = [a for a in asked if passes[a[0].table] > k]
        slices = {c.table: passes[c.table] + k for c, _ in now}
        kept = _kept(ds, now, slices if max(slices.values(), default=1) > 1 else None)
        asked = [a for a in asked if a not in now or a in kept]
    return asked


def _kept(ds: Dataset, asked: list[tuple[Candidates, tuple[str, ...]]], slices: dict[str, int] | None) -> list[tuple[Candidates, tuple[str, ...]]]:
    refuted = _repeated(ds, asked, slices) if asked else ()
    return [a for i, a in enumerate(asked) if i not in refuted]


def search_keys(
    ds: Dataset, tables: list[Candidates], widest: int = WIDEST_KEY, slice_keys: int = SLICE_KEYS
) -> dict[str, tuple[str, ...]]:
    """Each table's first pair, else triple and so on up to ``widest`` columns, of its candidates that is unique.

    One scan of all tables looks at the combinations of every width, but only at
    the keys in one slice of the hashes, of about ``slice_keys`` rows whatever
    the table's size: a key that is repeated there refutes its combination for
    certain.  What is left goes on a width at a time, all tables in one job:
    while a table has several combinations left, slices ``GROWTH`` times as
    large refute more of them, so that few are tested over all keys: each
    table's first one, and the others only if that one is refuted.  The keys of
    large tables are tested a slice at a time, and each job gives its shuffles back.
    """
    asked = _left(ds, [(c, combo) for c in tables for combo in c.combinations(widest)], slice_keys)
    found: dict[str, tuple[str, ...]] = {}
    for size in range(2, widest + 1):
        tested = [(c, combo) for c, combo in asked if len(combo) == size and c.table not in found]
        keys = slice_keys * GROWTH
        while rivals := [a for a in tested if _slices(a[0].rows, keys) > 1 and sum(a[0].table == c.table for c, _ in tested) > 1]:
            kept = _left(ds, rivals, keys)
            tested = [a for a in tested if a not in rivals or a in kept]
            keys *= GROWTH
        # a table that fits into its slice has been tested over all keys
        sure = [a for a in tested if _slices(a[0].rows, slice_keys) == 1]
        unsure = [a for a in tested if a not in sure]
        first = list({c.table: (c, combo) for c, combo in reversed(unsure)}.values())
        unique = _left(ds, first)
        done = {c.table for c, _ in unique}
        others = [a for a in unsure if a not in first and a[0].table not in done]
        for c, combo in [*sure, *unique, *_left(ds, others)]:
            found.setdefault(c.table, combo)
    return found


def composite_key(
    df: DataFrame, cardinality: dict[str, int], rows: int, widest: int = WIDEST_KEY, slice_keys: int = SLICE_KEYS
) -> tuple[str, ...] | None:
    """``search_keys`` of a single table."""
    return search_keys(Dataset({"t": df}), [Candidates("t", rows, cardinality)], widest, slice_keys).get("t")


def key_candidates(structural: DataFrame, most: int = MAX_KEY_CANDIDATES) -> DataFrame:
    """The ``most`` likely columns of each table without a single key, most distinct first."""
    eligible = structural.where(
        (F.col("null_percent") < 5.0)
        & (F.col("cardinality") > 1)
        & (F.col("cardinality") < F.col("row_count"))
    ).join(single_keys(structural).select("table"), "table", "left_anti")
    order = F.struct(-F.col("distinct_ratio"), -F.col("cardinality"), "ordinal")
    ordered = eligible.groupBy("table").agg(
        F.first("row_count").alias("row_count"),
        F.sort_array(
            F.collect_list(F.struct(order.alias("o"), "column", "cardinality", "null_count", "is_identifier"))
        ).alias("c"),
    )
    return ordered.select("table", "row_count", F.slice("c", 1, most).alias("c"))


def composite_keys(
    ds: Dataset, structural: DataFrame, most: int = MAX_KEY_CANDIDATES, widest: int = WIDEST_KEY
) -> DataFrame:
    """Composite keys of the tables that have no single one.

    Reads a catalogue-sized list of candidates, ``most`` for each table.
    """
    tables = [
        Candidates(
            row["table"], row["row_count"], {c["column"]: c["cardinality"] for c in row["c"]},
            frozenset(c["column"] for c in row["c"] if c["null_count"]),
            frozenset(c["column"] for c in row["c"] if c["is_identifier"]),
        )
        for row in key_candidates(structural, most).collect()
    ]
    keys = search_keys(ds, tables, widest)
    found = []
    for c in tables:
        if key := keys.get(c.table):
            bridge = len(key) == 2 and set(key) <= c.marked
            note = " (bridge/junction table)" if bridge else ""
            text = f"One row per unique combination of {', '.join(key)}{note}"
            found.append((c.table, list(key), text, 0.85))
    return constant_rows(ds.spark, found, GRAIN_SCHEMA)


def infer_grains(ds: Dataset, structural: DataFrame) -> DataFrame:
    """One grain per table: single, composite, near-unique key or full row."""
    ranked = [
        single_keys(structural),
        composite_keys(ds, structural),
        near_unique_keys(structural),
        full_row(structural),
    ]
    every = reduce(
        DataFrame.unionByName, [g.withColumn("place", F.lit(i)) for i, g in enumerate(ranked)]
    )
    best = every.groupBy("table").agg(
        F.min_by(F.struct("grain_columns", "description", "confidence"), "place").alias("g")
    )
    return best.select("table", "g.*")
