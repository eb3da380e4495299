"""Loading the test tables, and the SQL both sides of a check share."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakegauge.dataset import Dataset
from lakegauge.functions import text as X
from lakegauge.functions.types import family, join_family
from lakegauge.operators.profile import (
    DIMENSION_NAME_HINTS,
    MEASURE_NAME_HINTS,
    STATUS_NAME_HINTS,
)

# Scalar columns of the given tables with their Spark types.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
SALES = ("region", "nation", "customer", "supplier", "part", "orders")
TEXTS = ("documents", "pages", "benchmark", "labels", "conversations")
MOST = (*SALES, *TEXTS, "events", "embeddings")
EVERY = (*MOST, "lineitem")
STAR = (*SALES, "lineitem", "labels", "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load(spark: SparkSession, sf_dir: str, *names: str) -> Dataset:
    return Dataset({n: table(spark, sf_dir, n) for n in names})


def day(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd")


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(values) -> str:
    return ", ".join(quote(v) for v in values)


def re2(pattern: str) -> str:
    return quote(pattern)


# ---------------------------------------------------- oracle: the profile in SQL


def schema_columns(names, schemas=None) -> list[dict]:
    found = []
    for name in sorted(names):
        for ordinal, item in enumerate((schemas or SCHEMAS)[name].split(", ")):
            column, dtype = item.split(" ")
            spark_type = _TYPES[dtype]
            found.append(
                dict(id=len(found), table=name, column=column, ordinal=ordinal, dtype=dtype,
                     family=family(spark_type), join_family=join_family(spark_type))
            )
    return found


_TYPES = {
    "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType(),
    "timestamp_ntz": T.TimestampNTZType(), "date": T.DateType(), "boolean": T.BooleanType(),
}


def frequency_ctes(names, sources=None, schemas=None) -> str:
    """``meta`` and ``freq``; ``sources`` may replace a table by a subquery."""
    columns = schema_columns(names, schemas)
    meta = ", ".join(
        f"({c['id']}, {quote(c['table'])}, {quote(c['column'])}, {c['ordinal']}, {quote(c['dtype'])}, "
        f"{quote(c['family'])}, {quote(c['join_family'])})"
        for c in columns
    )
    parts = []
    for c in columns:
        source = (sources or {}).get(c["table"], c["table"])
        text = c["column"] if c["family"] == "text" else f"CAST({c['column']} AS VARCHAR)"
        number = f"CAST({c['column']} AS DOUBLE)" if c["family"] in ("integer", "fraction") else "CAST(NULL AS DOUBLE)"
        whole = c["column"] if c["family"] == "text" else "CAST(NULL AS VARCHAR)"
        parts.append(
            f"SELECT {c['id']} AS column_id, {text} AS value, min({number}) AS number, "
            f"min({whole}) AS whole, count(*) AS n FROM {source} GROUP BY 2"
        )
    return (
        f"meta(column_id, tbl, col, ordinal, dtype, family, join_family) AS (VALUES {meta}), "
        f"freq AS ({' UNION ALL '.join(parts)})"
    )


STATS = f"""
raw AS (
  SELECT m.*, sum(n) AS row_count, coalesce(sum(n) FILTER (WHERE value IS NULL), 0) AS null_count,
    count(value) AS cardinality, min(number) AS min_value, max(number) AS max_value,
    count(*) FILTER (WHERE family = 'text' AND try_cast(value AS DATE) IS NOT NULL) AS dates
  FROM meta m JOIN freq USING (column_id) GROUP BY ALL
),
stats AS (
  SELECT *, round(null_count * 100.0 / row_count, 2) AS null_percent,
    least(round(cast(cardinality AS DOUBLE) / row_count, 4), 1.0) AS distinct_ratio,
    cardinality > 0 AND dates = cardinality AS looks_temporal
  FROM raw
)"""

ROLES = """
guessed AS (
  SELECT *, CASE
    WHEN family = 'boolean' THEN 'boolean_flag'
    WHEN family = 'temporal' THEN CASE WHEN dtype = 'date' THEN 'date' ELSE 'datetime' END
    WHEN family IN ('integer', 'fraction') THEN CASE WHEN cardinality <= 2 THEN 'boolean_flag' ELSE 'numeric' END
    WHEN looks_temporal THEN 'date'
    WHEN cardinality <= greatest(1, least(30, row_count // 2)) THEN 'categorical'
    ELSE 'free_text' END AS base_role
  FROM stats
),
identified AS (
  SELECT *, null_count = 0 AND cardinality = row_count AS uniq,
    CASE WHEN null_count = 0 AND cardinality = row_count AND base_role IN ('numeric', 'categorical', 'free_text')
      THEN 'identifier' ELSE base_role END AS id_role
  FROM guessed
)"""

SAMPLES = f"""
samples AS (
  SELECT column_id, coalesce(whole, value) AS value, rk FROM (
    SELECT column_id, value, whole, row_number() OVER (PARTITION BY column_id ORDER BY value) AS rk
    FROM freq JOIN meta USING (column_id) WHERE value IS NOT NULL AND family NOT IN ('integer', 'fraction')
  ) WHERE rk <= 5
),
value_facts AS (
  SELECT column_id, avg(length(value)) AS mean_length,
    bool_and(trim(value) = '' OR regexp_matches(trim(value), {re2(X.PHONE_PATTERN)})) AS all_phone,
    bool_and(trim(value) = '' OR regexp_matches(trim(value), {re2(X.AADHAAR_PATTERN)})) AS all_aadhaar,
    bool_and(trim(value) = '' OR regexp_matches(trim(value), {re2(X.PAN_PATTERN)})) AS all_pan,
    bool_and(trim(value) = '' OR regexp_matches(trim(value), {re2(X.URL_PATTERN)})) AS all_url,
    bool_and(regexp_matches(value, {re2(X.UUID_PATTERN)})) AS all_uuid,
    bool_or(trim(value) <> '') AND bool_and(trim(value) = '' OR regexp_matches(trim(value), {re2(X.CURRENCY_SIGN_PATTERN)})) AS all_currency,
    bool_or(trim(value) <> '') AND bool_and(trim(value) = '' OR lower(trim(value)) IN ({words(X.BOOLEAN_WORDS)})) AS all_boolean
  FROM freq JOIN meta USING (column_id)
  WHERE value IS NOT NULL AND family NOT IN ('integer', 'fraction') GROUP BY column_id
)"""

STRUCTURAL = f"""
rivals AS (
  SELECT i.*, f.* EXCLUDE (column_id), row_number() OVER (PARTITION BY tbl, id_role = 'identifier'
    ORDER BY (family = 'integer' OR coalesce(all_uuid, false)) DESC, ordinal) AS place
  FROM identified i LEFT JOIN value_facts f USING (column_id)
),
structural AS (
  SELECT *, CASE WHEN id_role = 'identifier' AND place > 1 THEN 'free_text' ELSE id_role END AS guessed_role,
    uniq AND NOT (id_role = 'identifier' AND place > 1) AS is_identifier,
    regexp_matches(col, {re2(X.PERSON_NAME_PATTERN)}) OR regexp_matches(col, {re2(X.PERSONAL_COLUMN_PATTERN)}) AS is_pii
  FROM rivals
)"""


def structural_ctes(names, sources=None, schemas=None) -> str:
    return ", ".join([frequency_ctes(names, sources, schemas), STATS, ROLES, SAMPLES, STRUCTURAL])


SINGLE_KEYS = """
single_keys AS (
  SELECT tbl, arg_min(col, ordinal) AS key FROM structural
  WHERE is_identifier AND null_count = 0 AND cardinality = row_count GROUP BY tbl
)"""


# only these tables lack a single key, so only their combinations are counted
KEYLESS = ("lineitem",)


def grain_ctes(names, keyless=KEYLESS, sources=None, schemas=None) -> str:
    keyless = [k for k in keyless if k in names]
    composite = (
        _composites(keyless, sources, schemas)
        if keyless
        else "composite_keys AS (SELECT '' AS tbl, '' AS key, 0 AS size WHERE false)"
    )
    return ", ".join([
        SINGLE_KEYS,
        composite,
        """
near_keys AS (
  SELECT tbl, arg_max(col, [distinct_ratio, -ordinal]) AS key, max(distinct_ratio) AS ratio FROM structural
  WHERE distinct_ratio >= 0.99 AND cardinality < row_count GROUP BY tbl
),
grains AS (
  SELECT t.tbl,
    coalesce(s.key, c.key, n.key, t.every) AS grain,
    CASE WHEN s.key IS NOT NULL THEN 1 WHEN c.key IS NOT NULL THEN c.size WHEN n.key IS NOT NULL THEN 1 ELSE t.size END AS size,
    CASE WHEN s.key IS NOT NULL THEN 0.9::DOUBLE WHEN c.key IS NOT NULL THEN 0.85::DOUBLE WHEN n.key IS NOT NULL THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END AS confidence
  FROM (SELECT tbl, string_agg(col, ',' ORDER BY ordinal) AS every, count(*) AS size FROM structural GROUP BY tbl) t
  LEFT JOIN single_keys s USING (tbl) LEFT JOIN composite_keys c USING (tbl) LEFT JOIN near_keys n USING (tbl)
)""",
    ])


def _composites(keyless, sources=None, schemas=None) -> str:
    """The first unique pair, else triple, of the six best candidate columns."""
    counts = []
    for name in keyless:
        cols = [c["column"] for c in schema_columns([name], schemas)]
        source = (sources or {}).get(name, name)
        for size in (2, 3):
            for combo in combinations(cols, size):
                joined = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in combo)
                padded = [*combo, None][:3] if size == 2 else list(combo)
                names = ", ".join("NULL" if c is None else quote(c) for c in padded)
                counts.append(
                    f"SELECT {quote(name)} AS tbl, {size} AS size, {names}, count(DISTINCT {joined}) FROM {source}"
                )
    return f"""
combos(tbl, size, c1, c2, c3, found) AS ({' UNION ALL '.join(counts)}),
candidates AS (
  SELECT tbl, col, row_count, row_number() OVER (PARTITION BY tbl ORDER BY distinct_ratio DESC, cardinality DESC, ordinal) AS place
  FROM structural WHERE null_percent < 5.0 AND cardinality > 1 AND cardinality < row_count
    AND tbl NOT IN (SELECT tbl FROM single_keys)
),
unique_combos AS (
  SELECT c.tbl, c.size, list_sort(list_filter([k1.place, k2.place, k3.place], lambda p: p IS NOT NULL)) AS places
  FROM combos c
  JOIN candidates k1 ON k1.tbl = c.tbl AND k1.col = c.c1 AND k1.place <= 6
  JOIN candidates k2 ON k2.tbl = c.tbl AND k2.col = c.c2 AND k2.place <= 6
  LEFT JOIN candidates k3 ON k3.tbl = c.tbl AND k3.col = c.c3 AND k3.place <= 6
  WHERE c.found = k1.row_count AND (c.size = 2 OR k3.place IS NOT NULL)
),
first_combos AS (
  SELECT * FROM unique_combos QUALIFY row_number() OVER (PARTITION BY tbl ORDER BY size, places) = 1
),
composite_keys AS (
  SELECT f.tbl, string_agg(k.col, ',' ORDER BY k.place) AS key, max(f.size) AS size
  FROM first_combos f JOIN candidates k ON k.tbl = f.tbl AND list_contains(f.places, k.place) GROUP BY f.tbl
)"""


def _hits(column: str, hints) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), {quote(h)})" for h in hints) + ")"


COLUMNS = f"""
labelled AS (
  SELECT s.* EXCLUDE (guessed_role), CASE WHEN s.guessed_role = 'free_text' AND NOT is_pii AND (
      (g.confidence >= 0.8 AND g.size = 1 AND cardinality = row_count AND coalesce(mean_length, 0) < 60)
      OR cardinality <= greatest(2, least(50, cast(floor(sqrt(row_count)) AS BIGINT) * 3)))
    THEN 'categorical' ELSE s.guessed_role END AS guessed_role
  FROM structural s JOIN grains g USING (tbl)
),
printed AS (
  SELECT *, CASE
    WHEN guessed_role IN ('date', 'datetime') THEN CASE WHEN dtype LIKE 'timestamp%' THEN 'iso_datetime' ELSE 'iso_date' END
    WHEN coalesce(all_phone, false) THEN 'phone'
    WHEN coalesce(all_aadhaar, false) AND cardinality > 5 THEN 'aadhaar'
    WHEN coalesce(all_pan, false) THEN 'pan'
    WHEN coalesce(all_url, false) THEN 'url'
    WHEN coalesce(all_boolean, false) AND cardinality <= 3 THEN 'boolean_str'
    WHEN family IN ('integer', 'fraction') AND (trunc(min_value) BETWEEN 1000000000 AND 2000000000 OR trunc(min_value) BETWEEN 1000000000000 AND 2000000000000) THEN 'epoch'
    WHEN coalesce(all_currency, false) THEN 'currency'
    WHEN coalesce(all_uuid, false) THEN 'uuid'
    WHEN guessed_role = 'categorical' AND cardinality <= 12 AND coalesce(mean_length, 0) < 40 THEN 'enum'
    WHEN guessed_role = 'categorical' AND cardinality <= 20 AND coalesce(mean_length, 999) < 25 THEN 'enum'
    END AS fingerprint
  FROM labelled
),
columns_ AS (
  SELECT *, fingerprint IS NULL AND (guessed_role IN ('numeric', 'free_text') OR (guessed_role = 'categorical' AND cardinality > 20)) AS ambiguous,
    CASE
      WHEN guessed_role = 'identifier' THEN 'identifier'
      WHEN guessed_role IN ('date', 'datetime') OR fingerprint IN ('iso_date', 'iso_datetime', 'epoch') THEN 'timestamp'
      WHEN fingerprint IN ('aadhaar', 'pan', 'phone', 'uuid') THEN 'identifier'
      WHEN fingerprint = 'currency' THEN 'measure'
      WHEN guessed_role = 'numeric' THEN CASE WHEN {_hits('col', MEASURE_NAME_HINTS)} THEN 'measure'
        WHEN {_hits('col', DIMENSION_NAME_HINTS)} THEN 'dimension' ELSE 'measure' END
      WHEN fingerprint IN ('enum', 'boolean_str') THEN CASE WHEN {_hits('col', STATUS_NAME_HINTS)} OR fingerprint = 'boolean_str' THEN 'status' ELSE 'dimension' END
      WHEN guessed_role = 'categorical' THEN CASE WHEN contains(lower(col), 'status') THEN 'status' ELSE 'dimension' END
      WHEN guessed_role = 'free_text' THEN 'text'
      WHEN guessed_role = 'boolean_flag' THEN 'status'
      ELSE 'unknown' END AS understanding_role
  FROM printed
)"""


def columns_ctes(names, keyless=KEYLESS, sources=None, schemas=None) -> str:
    return ", ".join([structural_ctes(names, sources, schemas), grain_ctes(names, keyless, sources, schemas), COLUMNS])


def similarity_sql(a: str, b: str) -> str:
    """Name similarity of two SQL text expressions."""

    def tokens(x: str) -> str:
        return f"list_distinct(regexp_split_to_array(lower(trim({x})), '[_\\s]+'))"

    shared = f"len(list_intersect({tokens(a)}, {tokens(b)}))"
    union = f"len(list_distinct(list_concat({tokens(a)}, {tokens(b)})))"
    return (
        f"greatest({shared} / {union}, "
        f"CASE WHEN contains(lower({b}), lower({a})) OR contains(lower({a}), lower({b})) THEN 0.6 ELSE 0.0 END, "
        f"CASE WHEN (lower({a}) LIKE '%\\_id' ESCAPE '\\' AND lower({b}) = 'id') OR (lower({b}) LIKE '%\\_id' ESCAPE '\\' AND lower({a}) = 'id') THEN 0.5 ELSE 0.0 END)"
    )


RELATIONS = f"""
keys AS (SELECT * FROM structural WHERE is_identifier AND null_count = 0 AND cardinality = row_count),
same_name AS (
  SELECT c.column_id AS from_id, p.column_id AS to_id, 'same_name' AS origin, 1.0::DOUBLE AS similarity
  FROM structural c JOIN keys p ON lower(c.col) = lower(p.col) AND c.tbl <> p.tbl WHERE c.is_identifier
),
similar_names AS (
  SELECT c.column_id AS from_id, p.column_id AS to_id, 'similar' AS origin,
    greatest({similarity_sql('c.col', 'p.col')}, {similarity_sql('c.col', 'p.tbl')})::DOUBLE AS similarity,
    c.is_identifier, c.cardinality, c.row_count
  FROM structural c JOIN keys p ON c.join_family = p.join_family AND c.tbl <> p.tbl
    AND c.cardinality <= p.row_count * 1.2 AND NOT (c.is_identifier AND lower(c.col) = lower(p.col))
),
pairs AS (
  SELECT from_id, to_id, origin, similarity FROM same_name
  UNION ALL SELECT from_id, to_id, origin, similarity FROM similar_names
  WHERE similarity >= 0.3 OR is_identifier OR cardinality < row_count * 0.8
),
met AS (
  SELECT q.from_id, q.to_id, count(p.value) AS met_values, coalesce(sum(c.n) FILTER (WHERE p.value IS NOT NULL), 0) AS met_rows
  FROM pairs q JOIN freq c ON c.column_id = q.from_id AND c.value IS NOT NULL
  LEFT JOIN freq p ON p.column_id = q.to_id AND p.value = c.value GROUP BY ALL
),
facts AS (
  SELECT q.*, c.tbl AS from_table, c.col AS from_column, p.tbl AS to_table, p.col AS to_column,
    coalesce(m.met_values, 0) / c.cardinality AS overlap_ratio,
    CASE WHEN c.cardinality = c.row_count - c.null_count AND c.row_count > c.null_count THEN '1:1' ELSE 'N:1' END AS cardinality,
    CASE WHEN c.row_count > c.null_count THEN round((c.row_count - c.null_count - coalesce(m.met_rows, 0)) / (c.row_count - c.null_count), 4) ELSE 0.0 END::DOUBLE AS orphan_ratio
  FROM pairs q JOIN structural c ON c.column_id = q.from_id JOIN structural p ON p.column_id = q.to_id
  LEFT JOIN met m USING (from_id, to_id)
),
inferred AS (
  SELECT *, CASE WHEN origin = 'same_name' THEN round(overlap_ratio, 3) ELSE round(overlap_ratio * (0.7 + 0.3 * similarity), 3) END AS confidence
  FROM facts WHERE overlap_ratio >= CASE WHEN origin = 'same_name' OR similarity >= 0.5 THEN 0.5 ELSE 0.8 END
)"""

GRAPH = """
bridges AS (
  SELECT from_table AS tbl, count(DISTINCT to_table) AS parents FROM inferred
  WHERE from_table NOT IN (SELECT tbl FROM grains WHERE confidence >= 0.8 AND size = 1)
  GROUP BY from_table HAVING count(DISTINCT to_table) >= 2
),
edges AS (
  SELECT i.* EXCLUDE (cardinality), CASE WHEN b.tbl IS NOT NULL THEN 'N:N' ELSE i.cardinality END AS cardinality
  FROM inferred i LEFT JOIN bridges b ON b.tbl = i.from_table
)"""

FACT = """
fact_scores AS (
  SELECT c.tbl, (CASE WHEN bool_or(guessed_role = 'numeric') THEN 2.0 ELSE 0.0 END)
    + (CASE WHEN bool_or(guessed_role IN ('date', 'datetime')) THEN 2.0 ELSE 0.0 END)
    + (CASE WHEN c.tbl IN (SELECT from_table FROM inferred) THEN 1.0 ELSE 0.0 END) + max(row_count) / 1000.0 AS score
  FROM columns_ c WHERE c.tbl NOT IN (SELECT tbl FROM bridges) GROUP BY c.tbl
),
fact AS (SELECT tbl, score FROM fact_scores WHERE score > 0 ORDER BY score DESC, tbl DESC LIMIT 1)"""

# both directions of the edges, and the shortest paths from one table
BOTH = """
steps AS (
  SELECT from_table, from_column, to_table, to_column, cardinality, confidence FROM edges
  UNION ALL
  SELECT to_table, to_column, from_table, from_column,
    CASE cardinality WHEN 'N:1' THEN '1:N' WHEN '1:N' THEN 'N:1' ELSE cardinality END, confidence FROM edges
)"""


def path_ctes(start: str, max_hops: int) -> str:
    return f"""
walks(tbl, hops, names, risky, sure, visited) AS (
  SELECT {quote(start)}, 0, [] :: VARCHAR[], false, 1.0 :: DOUBLE, [{quote(start)}]
  UNION ALL
  SELECT s.to_table, hops + 1, list_append(names, s.from_table || '.' || s.from_column || '.' || s.to_table || '.' || s.to_column),
    risky OR s.cardinality IN ('1:N', 'N:N'), least(sure, s.confidence), list_append(visited, s.to_table)
  FROM walks w JOIN steps s ON s.from_table = w.tbl WHERE hops < {max_hops} AND NOT list_contains(visited, s.to_table)
),
paths AS (
  SELECT tbl, hops, names, risky, sure FROM walks
  QUALIFY row_number() OVER (PARTITION BY tbl ORDER BY hops, names) = 1
)"""


def with_(*ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)} {select}"
