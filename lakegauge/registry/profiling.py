"""Registered profile, grain, relation, graph, temporal and quality queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakegauge.dataset import Dataset, DeclaredKey
from lakegauge.functions.storage import remove_at_end, shared_folder
from lakegauge.operators import grain, graph, profile, quality, relations, stored, temporal
from lakegauge.operators.frequency import named, value_frequency
from lakegauge.operators.profile import Profile, structural_columns
from lakegauge.registry.base import (
    BOTH, EVERY, FACT, GRAPH, MOST, RELATIONS, SALES, STAR, columns_ctes, frequency_ctes, grain_ctes,
    load, path_ctes, quote, schema_columns, structural_ctes, with_, words,
)
from lakegauge.registry.derived import ALL_SCHEMAS, SOURCES, derive

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
EXTRA = dict(sources=SOURCES, schemas=ALL_SCHEMAS)


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


def _structural(spark: SparkSession, sf_dir: str, names, pii: bool = True) -> DataFrame:
    return structural_columns(derive(spark, sf_dir, *names), pii=pii)


# ------------------------------------------------------------------- profile

@query("value_frequency", with_(
    frequency_ctes(SALES), select="SELECT tbl AS \"table\", col AS \"column\", value, n FROM freq JOIN meta USING (column_id)"))
def _(spark, sf_dir):
    ds = load(spark, sf_dir, *SALES)
    return named(value_frequency(ds), ds).select("table", "column", "value", "n")


@query("profile_null_distinct", with_(
    structural_ctes(EVERY),
    select="SELECT tbl AS \"table\", col AS \"column\", row_count, null_percent, cardinality, distinct_ratio FROM stats"))
def _(spark, sf_dir):
    ds = load(spark, sf_dir, *EVERY)
    return profile.column_stats(ds, value_frequency(ds)).select(
        "table", "column", "row_count", "null_percent", "cardinality", "distinct_ratio")


@query("data_profile", with_(
    structural_ctes(["lineitem"]),
    select="SELECT col AS \"column\", null_percent, cardinality FROM stats WHERE col <> 'l_tax'"))
def _(spark, sf_dir):
    return profile.data_profile(load(spark, sf_dir, "lineitem"), "lineitem", ("l_tax",))


@query("profile_min_max", with_(
    structural_ctes(EVERY),
    select="SELECT tbl AS \"table\", col AS \"column\", min_value, max_value FROM stats WHERE family IN ('integer', 'fraction')"))
def _(spark, sf_dir):
    return profile.min_max(load(spark, sf_dir, *EVERY))


@query("distinct_samples", with_(
    structural_ctes(MOST),
    select="SELECT tbl AS \"table\", col AS \"column\", rk AS rank, value FROM samples JOIN meta USING (column_id)"))
def _(spark, sf_dir):
    ds = load(spark, sf_dir, *MOST)
    textual = [c.column_id for c in ds.columns if c.family not in ("integer", "fraction")]
    picked = profile.distinct_samples(ds, value_frequency(ds).where(F.col("column_id").isin(textual)))
    return named(picked, ds).select("table", "column", "rank", "value")


TYPED = (*SALES, "contacts", "events", "leads")


@query("looks_temporal", with_(
    structural_ctes(TYPED, **EXTRA), select="SELECT tbl AS \"table\", col AS \"column\", looks_temporal FROM stats"))
def _(spark, sf_dir):
    ds = derive(spark, sf_dir, *TYPED)
    return profile.column_stats(ds, value_frequency(ds)).select("table", "column", "looks_temporal")


WITH_CONTACTS = (*MOST, "contacts")


@query("guess_role", with_(
    structural_ctes(WITH_CONTACTS, **EXTRA),
    select="SELECT tbl AS \"table\", col AS \"column\", base_role AS guessed_role FROM guessed"))
def _(spark, sf_dir):
    ds = derive(spark, sf_dir, *WITH_CONTACTS)
    stats = profile.column_stats(ds, value_frequency(ds))
    return profile.guess_role(stats).select("table", "column", "guessed_role")


@query("identifier_columns", with_(
    structural_ctes(WITH_CONTACTS, **EXTRA),
    select="SELECT tbl AS \"table\", col AS \"column\", id_role AS guessed_role, uniq AS is_identifier FROM identified"))
def _(spark, sf_dir):
    ds = derive(spark, sf_dir, *WITH_CONTACTS)
    roles = profile.guess_role(profile.column_stats(ds, value_frequency(ds)))
    return profile.mark_identifiers(roles).select("table", "column", "guessed_role", "is_identifier")


@query("identifier_winner", with_(
    structural_ctes(WITH_CONTACTS, **EXTRA),
    select="SELECT tbl AS \"table\", col AS \"column\", guessed_role FROM structural WHERE is_identifier AND guessed_role = 'identifier'"))
def _(spark, sf_dir):
    kept = _structural(spark, sf_dir, WITH_CONTACTS)
    return kept.where("is_identifier and guessed_role = 'identifier'").select("table", "column", "guessed_role")


@query("pii_columns", with_(
    structural_ctes(TYPED, **EXTRA), select="SELECT tbl AS \"table\", col AS \"column\", is_pii FROM structural"))
def _(spark, sf_dir):
    return _structural(spark, sf_dir, TYPED).select("table", "column", "is_pii")


@query("denied_columns", with_(
    structural_ctes(TYPED, **EXTRA),
    select="SELECT tbl AS \"table\", string_agg(col, ',' ORDER BY col) AS denied FROM structural WHERE is_pii GROUP BY tbl"))
def _(spark, sf_dir):
    found = profile.denied_columns(_structural(spark, sf_dir, TYPED))
    return found.select("table", F.array_join("denied", ",").alias("denied"))


def _quartile_sql() -> str:
    parts = [
        f"SELECT '{c['table']}' AS \"table\", '{c['column']}' AS \"column\", "
        + ", ".join(
            f"round(quantile_cont(CAST({c['column']} AS DOUBLE), {p}), 4) AS {n}"
            for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75")))
        + f" FROM {c['table']}"
        for c in schema_columns(EVERY) if c["family"] in ("integer", "fraction")
    ]
    return " UNION ALL ".join(parts)


@query("profile_quartiles", _quartile_sql())
def _(spark, sf_dir):
    return profile.quartiles(load(spark, sf_dir, *EVERY))


@query("top_values", with_(
    frequency_ctes(MOST),
    select="SELECT tbl AS \"table\", col AS \"column\", rank, value, n FROM (SELECT tbl, col, "
    "row_number() OVER (PARTITION BY column_id ORDER BY n DESC, value) AS rank, coalesce(whole, value) AS value, n "
    "FROM freq JOIN meta USING (column_id) WHERE value IS NOT NULL) WHERE rank <= 8"))
def _(spark, sf_dir):
    ds = load(spark, sf_dir, *MOST)
    return named(profile.top_values(ds, value_frequency(ds)), ds).select("table", "column", "rank", "value", "n")


def _columns(spark, sf_dir, names) -> DataFrame:
    return Profile(derive(spark, sf_dir, *names)).columns


KEYLESS = ("lineitem", "conversations", "offers", "order_days")
COLUMN_CTES = columns_ctes(WITH_CONTACTS, KEYLESS, **EXTRA)


def _column_query(name: str, oracle: str, *wanted: str) -> None:
    @query(name, with_(COLUMN_CTES, select=f"SELECT tbl AS \"table\", col AS \"column\", {oracle} FROM columns_"))
    def _(spark, sf_dir):
        return _columns(spark, sf_dir, WITH_CONTACTS).select("table", "column", *wanted)


_column_query("label_promotion", "guessed_role", "guessed_role")
_column_query("format_fingerprint", "fingerprint", "fingerprint")
_column_query("ambiguous_columns", "ambiguous", "ambiguous")
_column_query("understanding_role", "understanding_role", "understanding_role")


@query("vocabulary", with_(
    columns_ctes((*SALES, "leads"), KEYLESS, **EXTRA),
    select="SELECT tbl AS \"table\", col AS \"column\", rank, value, n FROM (SELECT c.*, coalesce(f.whole, f.value) AS value, f.n, "
    "row_number() OVER (PARTITION BY column_id ORDER BY n DESC, f.value) AS rank FROM freq f JOIN columns_ c USING (column_id) "
    "WHERE f.value IS NOT NULL AND NOT is_pii AND (fingerprint = 'enum' OR (guessed_role = 'categorical' AND cardinality <= 20)))"))
def _(spark, sf_dir):
    known = Profile(derive(spark, sf_dir, *SALES, "leads"))
    found = profile.vocabulary(known.ds, known.frequency, known.columns)
    return found.select("table", "column", "rank", "value", "n")


def _digest_sql() -> str:
    """An order-free sum of row digests, for each table."""
    parts = []
    for name in sorted(EVERY):
        cells = ", ".join(f"coalesce('=' || CAST({c['column']} AS VARCHAR), '-')" for c in schema_columns([name]))
        parts.append(
            f"SELECT {quote(name)} AS \"table\", count(*) AS row_count, CAST(coalesce(sum(CAST('0x' || "
            f"substr(md5(concat_ws(chr(31), {cells})), 1, {stored.ROW_DIGITS}) AS BIGINT)), 0) AS VARCHAR) AS digest FROM {name}")
    return " UNION ALL ".join(parts)


@query("table_digests", _digest_sql())
def _(spark, sf_dir):
    return stored.table_digests(load(spark, sf_dir, *EVERY))


@query("stored_profile", with_(
    structural_ctes(TYPED, **EXTRA),
    select="SELECT tbl AS \"table\", col AS \"column\", row_count, null_percent, cardinality, guessed_role, is_pii FROM structural"))
def _(spark, sf_dir):
    store = stored.ProfileStore(spark, shared_folder(spark) + "/profiles-" + uuid.uuid4().hex)
    remove_at_end(spark, store.folder)
    ds = derive(spark, sf_dir, *TYPED)
    store.columns(ds)
    return store.columns(ds).select("table", "column", "row_count", "null_percent", "cardinality", "guessed_role", "is_pii")


@query("data_map", None)
def _(spark, sf_dir):
    known = Profile(derive(spark, sf_dir, *SALES))
    return known.data_map().withColumn(
        "top_values", F.array_join(F.transform("top_values", lambda t: F.concat(t["value"], F.lit(":"), t["count"])), ", "))


@query("inspect_column", with_(
    structural_ctes(["events"]),
    select="SELECT tbl AS \"table\", col AS \"column\", dtype, null_percent, cardinality, distinct_ratio, guessed_role, "
    "(SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT event_type AS v FROM events ORDER BY v LIMIT 15)) AS sample_values "
    "FROM structural WHERE col = 'event_type'"))
def _(spark, sf_dir):
    ds = load(spark, sf_dir, "events")
    card = profile.inspect_column(ds, structural_columns(ds), "events", "event_type")
    return card.withColumn("sample_values", F.array_join("sample_values", "|")).drop("min_value", "max_value", "is_pii")


COMPARED = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


@query("compare_columns", with_(
    structural_ctes(["lineitem"]),
    select="SELECT col AS \"column\", dtype, guessed_role, min_value, max_value, cardinality, null_percent "
    f"FROM structural WHERE col IN ({words(COMPARED)})"))
def _(spark, sf_dir):
    ds = load(spark, sf_dir, "lineitem")
    return profile.compare_columns(ds, structural_columns(ds), "lineitem", COMPARED)


@query("masked_sample",
       f"SELECT customer_id, '[REDACTED-PII]' AS customer_name, '[REDACTED-PII]' AS phone, segment FROM {SOURCES['contacts']} "
       "ORDER BY customer_id LIMIT 3")
def _(spark, sf_dir):
    ds = derive(spark, sf_dir, "contacts")
    shown = profile.masked_sample(ds, "contacts", {"customer_name", "phone"}, ["customer_id"])
    return shown.select("customer_id", "customer_name", "phone", "segment")


# --------------------------------------------------------------------- grain

@query("grain_single", with_(
    structural_ctes(EVERY), grain_ctes(EVERY), select="SELECT tbl AS \"table\", key AS grain, 0.9::DOUBLE AS confidence FROM single_keys"))
def _(spark, sf_dir):
    found = grain.single_keys(_structural(spark, sf_dir, EVERY))
    return found.select("table", F.array_join("grain_columns", ",").alias("grain"), "confidence")


COMPOSITE = ("lineitem", "offers", "conversations")


@query("grain_composite", with_(
    structural_ctes(COMPOSITE, **EXTRA), grain_ctes(COMPOSITE, KEYLESS, **EXTRA),
    select="SELECT tbl AS \"table\", key AS grain, 0.85::DOUBLE AS confidence FROM composite_keys"))
def _(spark, sf_dir):
    known = Profile(derive(spark, sf_dir, *COMPOSITE))
    found = grain.composite_keys(known.ds, known.structural)
    return found.select("table", F.array_join("grain_columns", ",").alias("grain"), "confidence")


STARRED = (*SALES, "lineitem")


@query("grain_near_unique", with_(
    structural_ctes(STARRED), grain_ctes(STARRED),
    select="SELECT tbl AS \"table\", key AS grain, 0.6::DOUBLE AS confidence FROM near_keys"))
def _(spark, sf_dir):
    found = grain.near_unique_keys(_structural(spark, sf_dir, STARRED))
    return found.select("table", F.array_join("grain_columns", ",").alias("grain"), "confidence")


GRAINED = (*EVERY, "offers", "order_days")


@query("grain_table", with_(
    structural_ctes(GRAINED, **EXTRA), grain_ctes(GRAINED, KEYLESS, **EXTRA),
    select="SELECT tbl AS \"table\", grain, confidence FROM grains"))
def _(spark, sf_dir):
    known = Profile(derive(spark, sf_dir, *GRAINED))
    return known.grains.select("table", F.array_join("grain_columns", ",").alias("grain"), "confidence")


# ----------------------------------------------------------------- relations

PAIR_COLUMNS = ("from_table", "from_column", "to_table", "to_column")
PAIRS_SQL = ", ".join(PAIR_COLUMNS)
NAMED = ("labels", "documents")


@query("fk_exact_name", with_(
    structural_ctes(NAMED), RELATIONS, select=f"SELECT {PAIRS_SQL}, confidence FROM inferred WHERE origin = 'same_name'"))
def _(spark, sf_dir):
    known = Profile(load(spark, sf_dir, *NAMED))
    pairs = relations.same_name_candidates(known.structural)
    return relations.accepted(relations.edge_facts(known.frequency, pairs)).select(*PAIR_COLUMNS, "confidence")


@query("fk_fuzzy", with_(
    structural_ctes(STAR), RELATIONS,
    select=f"SELECT {PAIRS_SQL}, round(similarity, 6) AS similarity, confidence FROM inferred WHERE origin = 'similar'"))
def _(spark, sf_dir):
    known = Profile(load(spark, sf_dir, *STAR))
    pairs = relations.similar_candidates(known.structural)
    found = relations.accepted(relations.edge_facts(known.frequency, pairs))
    return found.select(*PAIR_COLUMNS, F.round("similarity", 6).alias("similarity"), "confidence")


@query("fk_overlap", with_(
    structural_ctes(STAR), RELATIONS,
    select=f"SELECT {PAIRS_SQL}, round(overlap_ratio, 6) AS overlap_ratio FROM facts WHERE overlap_ratio > 0"))
def _(spark, sf_dir):
    known = Profile(load(spark, sf_dir, *STAR))
    facts = relations.edge_facts(known.frequency, relations.candidate_pairs(known.structural)).where("overlap_ratio > 0")
    return facts.select(*PAIR_COLUMNS, F.round("overlap_ratio", 6).alias("overlap_ratio"))


ORPHANED = ("orders", "solvent", "lineitem")


@query("edge_cardinality", with_(
    structural_ctes(ORPHANED, **EXTRA), RELATIONS, select=f"SELECT {PAIRS_SQL}, cardinality, orphan_ratio FROM inferred"))
def _(spark, sf_dir):
    known = Profile(derive(spark, sf_dir, *ORPHANED))
    found = relations.infer_relationships(known.frequency, known.structural)
    return found.select(*PAIR_COLUMNS, "cardinality", "orphan_ratio")


@query("name_similarity", with_(
    structural_ctes((*SALES, "contacts"), **EXTRA), RELATIONS,
    select="SELECT c.tbl AS from_table, c.col AS from_column, p.tbl AS to_table, p.col AS to_column, round(q.similarity, 6) AS similarity "
    "FROM pairs q JOIN structural c ON c.column_id = from_id JOIN structural p ON p.column_id = to_id "
    "WHERE origin = 'similar' AND NOT coalesce(c.min_value > p.max_value OR c.max_value < p.min_value, false)"))
def _(spark, sf_dir):
    pairs = relations.similar_candidates(_structural(spark, sf_dir, (*SALES, "contacts")))
    return pairs.select(*PAIR_COLUMNS, F.round("similarity", 6).alias("similarity"))


@query("type_family", with_(
    structural_ctes(TYPED, **EXTRA), select="SELECT tbl AS \"table\", col AS \"column\", family, join_family, cardinality FROM stats"))
def _(spark, sf_dir):
    ds = derive(spark, sf_dir, *TYPED)
    return profile.column_stats(ds, value_frequency(ds)).select("table", "column", "family", "join_family", "cardinality")


@query("check_relationship", """
SELECT 'documents' AS from_table, 'doc_id' AS from_column, 'labels' AS to_table, 'doc_id' AS to_column,
  round(count(DISTINCT doc_id) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) / count(DISTINCT doc_id), 4) AS overlap_ratio,
  CASE WHEN count(DISTINCT doc_id) = count(doc_id) THEN '1:1' ELSE 'N:1' END AS cardinality,
  round(count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels)) / count(doc_id), 4) AS orphan_ratio,
  count(DISTINCT doc_id) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) / count(DISTINCT doc_id) >= 0.5 AS verified
FROM documents""")
def _(spark, sf_dir):
    return relations.check_relationship(load(spark, sf_dir, *NAMED), "documents", "doc_id", "labels", "doc_id")


DECLARED = (
    DeclaredKey("orders", "o_custkey", "solvent", "c_custkey"),
    DeclaredKey("lineitem", "l_orderkey", "orders", "o_orderkey"),
)


def _declared_sql() -> str:
    parts = []
    for k in DECLARED:
        child, parent = (SOURCES.get(t, t) for t in (k.from_table, k.to_table))
        parts.append(
            f"SELECT '{k.from_table}' AS from_table, '{k.from_column}' AS from_column, '{k.to_table}' AS to_table, "
            f"'{k.to_column}' AS to_column, 1.0::DOUBLE AS confidence, 'N:1' AS cardinality, "
            f"round(count(*) FILTER (WHERE {k.from_column} NOT IN (SELECT {k.to_column} FROM {parent})) / count(*), 4) AS orphan_ratio "
            f"FROM {child}")
    return " UNION ALL ".join(parts)


@query("declared_edges", _declared_sql())
def _(spark, sf_dir):
    ds = derive(spark, sf_dir, *ORPHANED)
    known = Profile(Dataset(ds.tables, DECLARED))
    found = relations.declared_edges(known.ds, known.frequency, known.structural)
    return found.select(*PAIR_COLUMNS, "confidence", "cardinality", "orphan_ratio")


# --------------------------------------------------------------------- graph

@query("merge_edges", with_(
    structural_ctes(ORPHANED, **EXTRA), RELATIONS,
    select=f"SELECT {PAIRS_SQL}, 'declared' AS origin FROM (VALUES "
    + ", ".join(f"('{k.from_table}', '{k.from_column}', '{k.to_table}', '{k.to_column}')" for k in DECLARED)
    + f") d({PAIRS_SQL}) UNION ALL SELECT {PAIRS_SQL}, origin FROM inferred WHERE (from_table, from_column) NOT IN "
    + "(" + ", ".join(f"('{k.from_table}', '{k.from_column}')" for k in DECLARED) + ")"))
def _(spark, sf_dir):
    ds = derive(spark, sf_dir, *ORPHANED)
    known = Profile(Dataset(ds.tables, DECLARED))
    merged = graph.merge_edges(
        relations.declared_edges(known.ds, known.frequency, known.structural),
        relations.infer_relationships(known.frequency, known.structural))
    return merged.select(*PAIR_COLUMNS, "origin")


BRIDGED = ("part", "supplier", "offers")
BRIDGE_CTES = (columns_ctes(BRIDGED, KEYLESS, **EXTRA), RELATIONS, GRAPH, FACT)


@query("bridge_tables", with_(*BRIDGE_CTES, select="SELECT tbl AS \"table\", parents FROM bridges"))
def _(spark, sf_dir):
    known = Profile(derive(spark, sf_dir, *BRIDGED))
    inferred = relations.infer_relationships(known.frequency, known.structural)
    return graph.bridge_tables(inferred, known.grains)


GRAPHED = (*SALES, "offers")
GRAPH_CTES = (columns_ctes(GRAPHED, KEYLESS, **EXTRA), RELATIONS, GRAPH, FACT)


@query("fact_table", with_(*GRAPH_CTES, select="SELECT tbl AS \"table\", round(score, 6) AS score FROM fact"))
def _(spark, sf_dir):
    known = Profile(derive(spark, sf_dir, *GRAPHED))
    found = graph.fact_table(known.structural, known.edges, known.grains)
    return found.select("table", F.round("score", 6).alias("score"))


@query("entities", with_(*GRAPH_CTES, select="""
SELECT c.tbl AS "table",
  CASE WHEN c.tbl IN (SELECT tbl FROM bridges) THEN 'bridge' WHEN c.tbl IN (SELECT tbl FROM fact) THEN 'fact'
    WHEN any_value(g.confidence) >= 0.8 AND any_value(g.size) = 1 THEN 'dimension' ELSE 'unknown' END AS role,
  any_value(g.grain) AS key_columns,
  coalesce(string_agg(col, ',' ORDER BY ordinal) FILTER (WHERE guessed_role = 'numeric' AND NOT is_identifier), '') AS measures,
  coalesce(string_agg(col, ',' ORDER BY ordinal) FILTER (WHERE guessed_role IN ('categorical', 'boolean_flag')), '') AS dimensions,
  coalesce(string_agg(col, ',' ORDER BY ordinal) FILTER (WHERE guessed_role IN ('date', 'datetime')), '') AS time_columns,
  max(row_count) AS row_count
FROM columns_ c JOIN grains g ON g.tbl = c.tbl GROUP BY c.tbl"""))
def _(spark, sf_dir):
    found = Profile(derive(spark, sf_dir, *GRAPHED)).entities
    lists = ("key_columns", "measures", "dimensions", "time_columns")
    return found.select("table", "role", *[F.array_join(c, ",").alias(c) for c in lists], "row_count")


@query("edges_bidirectional", with_(
    *GRAPH_CTES, BOTH, select=f"SELECT {PAIRS_SQL}, cardinality, cardinality IN ('1:N', 'N:N') AS fan_out_risk FROM steps"))
def _(spark, sf_dir):
    known = Profile(derive(spark, sf_dir, *GRAPHED))
    return graph.both_directions(known.edges).select(*PAIR_COLUMNS, "cardinality", "fan_out_risk")


def _paths(spark, sf_dir) -> DataFrame:
    known = Profile(derive(spark, sf_dir, *SALES))
    return graph.join_paths(known.edges, "orders")


PATH_CTES = (columns_ctes(SALES, KEYLESS), RELATIONS, GRAPH, BOTH, path_ctes("orders", 3))


@query("join_path", with_(
    *PATH_CTES, select="SELECT tbl AS \"table\", hops, array_to_string(names, ' > ') AS path FROM paths", recursive=True))
def _(spark, sf_dir):
    step = lambda e: F.concat_ws(".", e["from_table"], e["from_column"], e["to_table"], e["to_column"])
    return _paths(spark, sf_dir).select("table", "hops", F.array_join(F.transform("path", step), " > ").alias("path"))


@query("reachable_tables", with_(*PATH_CTES, select="SELECT tbl AS \"table\" FROM paths", recursive=True))
def _(spark, sf_dir):
    return _paths(spark, sf_dir).select("table")


@query("fan_out_safety", with_(*PATH_CTES, select="SELECT tbl AS \"table\", NOT risky AS safe FROM paths", recursive=True))
def _(spark, sf_dir):
    return graph.safe_to_aggregate(_paths(spark, sf_dir)).select("table", "safe")


# ------------------------------------------------------------------ temporal

TIMED = ("orders", "lineitem", "events", "contacts", "order_days")
PRIMARY = """
main AS (SELECT * FROM structural WHERE guessed_role IN ('date', 'datetime')
  QUALIFY row_number() OVER (PARTITION BY tbl ORDER BY null_percent, cardinality DESC, ordinal) = 1),
moments AS (SELECT m.tbl, m.col, CAST(f.value AS TIMESTAMP) AS moment, f.value, f.n FROM freq f JOIN main m USING (column_id) WHERE f.value IS NOT NULL),
spans AS (SELECT tbl, col, min(moment) AS lo, max(moment) AS hi, count(*) AS distinct_n, sum(n) AS non_null,
  bool_or(contains(value, ':')) AS timed, count(DISTINCT CAST(moment AS DATE)) AS days,
  count(DISTINCT date_trunc('month', moment)) AS months, count(DISTINCT date_trunc('year', moment)) AS years,
  CAST(max(moment) AS DATE) - CAST(min(moment) AS DATE) + 1 AS span_days FROM moments GROUP BY tbl, col),
grained AS (SELECT *, CASE WHEN timed THEN 'timestamp' WHEN years = 1 AND months <= 1 THEN CASE WHEN distinct_n > 10 THEN 'day' ELSE 'month' END
  WHEN distinct_n / months < 2 THEN 'month' WHEN distinct_n / years < 13 THEN 'month' ELSE 'day' END AS granularity FROM spans)"""
TIME_CTES = (structural_ctes(TIMED, **EXTRA), PRIMARY)


@query("primary_time_column", with_(*TIME_CTES, select="SELECT tbl AS \"table\", col AS \"column\" FROM main"))
def _(spark, sf_dir):
    return temporal.primary_time_columns(_structural(spark, sf_dir, TIMED)).select("table", "column")


def _temporal(spark, sf_dir) -> DataFrame:
    known = Profile(derive(spark, sf_dir, *TIMED))
    return temporal.temporal_profile(known.frequency, known.structural)


@query("temporal_span", with_(
    *TIME_CTES, select="SELECT tbl AS \"table\", col AS \"column\", strftime(lo, '%Y-%m-%d %H:%M:%S') AS min_value, "
    "strftime(hi, '%Y-%m-%d %H:%M:%S') AS max_value, distinct_n, non_null FROM grained"))
def _(spark, sf_dir):
    return _temporal(spark, sf_dir).select(
        "table", "column", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("min_value", "max_value")],
        "distinct_n", "non_null")


@query("temporal_granularity", with_(*TIME_CTES, select="SELECT tbl AS \"table\", col AS \"column\", granularity FROM grained"))
def _(spark, sf_dir):
    return _temporal(spark, sf_dir).select("table", "column", "granularity")


@query("temporal_gaps", with_(
    *TIME_CTES, select="SELECT tbl AS \"table\", col AS \"column\", span_days, days AS distinct_days, "
    "CASE WHEN granularity = 'day' AND span_days - days > greatest(2, span_days * 0.05) "
    "THEN (span_days - days) || ' missing days in ' || span_days || '-day span' END AS gaps FROM grained"))
def _(spark, sf_dir):
    return _temporal(spark, sf_dir).select("table", "column", "span_days", "distinct_days", "gaps")


# ------------------------------------------------------------------- quality

CHECKED = ("leads", "contacts", "labels", "nation")
HIST = """
hist AS (SELECT s.tbl, s.col, s.family, s.cardinality, s.row_count - s.null_count AS total, f.value, f.n,
  row_number() OVER (PARTITION BY f.column_id ORDER BY f.n DESC, f.value) AS place,
  round(f.n / (s.row_count - s.null_count) * 100.0, 1) AS pct,
  regexp_matches(f.value, '(?i)^\\s*[+-]?((\\d+\\.?\\d*|\\.\\d+)(e[+-]?\\d+)?|inf|infinity|nan)\\s*$') AS numlike
  FROM freq f JOIN structural s USING (column_id)
  WHERE f.value IS NOT NULL AND NOT is_pii AND s.cardinality BETWEEN 1 AND 50 AND s.family <> 'temporal'),
tops AS (SELECT tbl, col, string_agg(value || '=' || n || ' ' || pct, ', ' ORDER BY place) FILTER (WHERE place <= 5) AS top_values FROM hist GROUP BY tbl, col),
high_null AS (SELECT 'high_null' AS code, 'medium' AS severity, tbl, col, '"' || col || '" is empty for ' || printf('%.1f', null_percent) || '% of rows.' AS summary, '' AS top_values
  FROM structural WHERE null_percent >= 40.0),
single AS (SELECT 'single_value' AS code, 'low' AS severity, tbl, col, '"' || col || '" is always "' || value || '" (' || format('{:,}', n) || ' row(s)).' AS summary,
  value || '=' || n || ' 100.0' AS top_values FROM hist WHERE cardinality = 1),
dominant AS (SELECT 'dominant_value' AS code, 'medium' AS severity, h.tbl, h.col,
  printf('%.1f', n / total * 100) || '% of ' || format('{:,}', total::BIGINT) || ' non-null rows in "' || h.col || '" are "' || value || '".' AS summary, t.top_values
  FROM hist h JOIN tops t ON t.tbl = h.tbl AND t.col = h.col WHERE cardinality > 1 AND place = 1 AND n / total >= 0.6),
spelled AS (SELECT tbl, col, lower(trim(value)) AS plain, sum(n) AS cluster_n, min(value) AS least_value,
  array_to_string(list(value ORDER BY place)[1:3], '/') AS example FROM hist WHERE cardinality > 1 GROUP BY ALL HAVING count(*) > 1),
spelled_top AS (SELECT h.tbl, h.col, h.value, h.n, h.pct, row_number() OVER (PARTITION BY h.tbl, h.col ORDER BY place) AS spot
  FROM hist h JOIN spelled s ON s.tbl = h.tbl AND s.col = h.col AND s.plain = lower(trim(h.value))),
inconsistent AS (SELECT 'inconsistent_format' AS code, 'low' AS severity, s.tbl, s.col, '"' || s.col || '" has multiple spellings of the same value: '
  || array_to_string(list(example ORDER BY cluster_n DESC, least_value)[1:3], ', ') || '.' AS summary,
  (SELECT string_agg(value || '=' || n || ' ' || pct, ', ' ORDER BY spot) FROM spelled_top p WHERE p.tbl = s.tbl AND p.col = s.col AND spot <= 5) AS top_values
  FROM spelled s GROUP BY s.tbl, s.col),
shares AS (SELECT tbl, col, sum(n) FILTER (WHERE numlike) / max(total) AS share,
  array_to_string((list(value ORDER BY place) FILTER (WHERE NOT numlike))[1:2], ', ') AS labels,
  array_to_string((list(value ORDER BY place) FILTER (WHERE numlike))[1:2], ', ') AS figures
  FROM hist WHERE cardinality > 1 AND family NOT IN ('integer', 'fraction') GROUP BY tbl, col),
mixed AS (SELECT 'mixed_types' AS code, 'high' AS severity, s.tbl, s.col, '"' || s.col || '" mixes text labels (' || labels || ') with numeric-looking values ('
  || figures || ') - ' || printf('%.1f', share * 100) || '% look numeric.' AS summary, t.top_values
  FROM shares s JOIN tops t ON t.tbl = s.tbl AND t.col = s.col WHERE share BETWEEN 0.05 AND 0.95)"""
CHECK_CTES = (structural_ctes(CHECKED, **EXTRA), HIST)
FINDING = "code || ':' || tbl || '.' || col AS id, code, severity, tbl AS \"table\", col AS \"column\", summary, top_values"


def _flat(findings: DataFrame) -> DataFrame:
    shown = F.transform(
        "top_values", lambda t: F.concat(t["value"], F.lit("="), t["count"], F.lit(" "), t["percent"]))
    return findings.withColumn("top_values", F.array_join(shown, ", "))


def _check_query(name: str, source: str, build) -> None:
    @query(name, with_(*CHECK_CTES, select=f"SELECT {FINDING} FROM {source}"))
    def _(spark, sf_dir):
        ds = derive(spark, sf_dir, *CHECKED)
        frequency = value_frequency(ds)
        return _flat(build(frequency, structural_columns(ds, frequency)))


_check_query("q_high_null", "high_null", lambda f, s: quality.high_null(s))
_check_query("q_single_value", "single", lambda f, s: quality.single_value(quality.histograms(f, s)))
_check_query("q_dominant_value", "dominant", lambda f, s: quality.dominant_value(quality.histograms(f, s)))
_check_query("q_inconsistent_format", "inconsistent", lambda f, s: quality.inconsistent_format(quality.histograms(f, s)))
_check_query("q_mixed_types", "mixed", lambda f, s: quality.mixed_types(quality.histograms(f, s)))

# A claim per column: its name is the meaning, its share of distinct values the confidence.
CLAIM_SQL = "SELECT tbl, col, 'the ' || col AS meaning, round(distinct_ratio, 2) AS confidence FROM stats"


def _claims(structural: DataFrame) -> DataFrame:
    return structural.select(
        "table", "column", F.concat(F.lit("the "), "column").alias("proposed_meaning"),
        F.round("distinct_ratio", 2).alias("confidence"))


UNCLEAR = f"""
unclear AS (SELECT 'unclear_meaning' AS code, 'medium' AS severity, tbl, col, 'Not confident what "' || col || '" means - best guess: "'
  || meaning || '" (' || printf('%.0f', confidence * 100) || '% confidence).' AS summary, '' AS top_values FROM ({CLAIM_SQL}) WHERE confidence < 0.5)"""


@query("q_unclear_meaning", with_(*CHECK_CTES, UNCLEAR, select=f"SELECT {FINDING} FROM unclear"))
def _(spark, sf_dir):
    return _flat(quality.unclear_meaning(_claims(_structural(spark, sf_dir, CHECKED))))


REPORTED = (*EVERY, "leads", "contacts")


@query("quality_report", with_(
    structural_ctes(REPORTED, **EXTRA), HIST, UNCLEAR,
    select=" UNION ALL ".join(f"SELECT {FINDING} FROM {s}" for s in ("high_null", "single", "dominant", "inconsistent", "mixed", "unclear"))))
def _(spark, sf_dir):
    known = Profile(derive(spark, sf_dir, *REPORTED))
    return _flat(quality.quality_report(known.frequency, known.structural, _claims(known.structural)))
