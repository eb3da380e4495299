"""Registered source, exploration, binding, gate, insight and scoring queries."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakegauge.dataset import Dataset
from lakegauge.functions.storage import cut, shared_folder
from lakegauge.functions.text import ANSWER_NUMBER_PATTERN, PERSONAL_VALUE_PATTERNS
from lakegauge.operators import binding, explore, gates, insights, relations, scoring
from lakegauge.operators.profile import Profile, structural_columns
from lakegauge.plans import kpis as K
from lakegauge.plans.packs import (
    GENERIC_NAME_TOKENS, PACKS, RETAIL, expected_roles,
)
from lakegauge.registry.base import (
    EVERY, RELATIONS, SCHEMAS, columns_ctes, load, quote, structural_ctes, table, with_, words,
)
from lakegauge.registry.derived import ALL_SCHEMAS, SOURCES, derive
from lakegauge.sources import files, sinks

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


# ------------------------------------------------------------------- sources

ORDERS_SQL = (
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, "
    "o_orderpriority FROM orders"
)


def _folder(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/files-{uuid4().hex}"


def _dated(df: DataFrame) -> DataFrame:
    moment = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    return df.withColumn("o_orderdate", moment)


def _format_query(name: str, fmt: str) -> None:
    @query(name, ORDERS_SQL)
    def _(spark, sf_dir):
        paths = sinks.redacted_export(load(spark, sf_dir, "orders"), {}, _folder(spark), fmt)
        return _dated(files.read_table(spark, paths["orders"]))


_format_query("src_csv", "csv")
_format_query("src_tsv", "tsv")
_format_query("src_json", "json")
_format_query("src_parquet", "parquet")


@query("src_directory", "SELECT 'customer' AS \"table\", count(*) AS row_count FROM customer UNION ALL SELECT 'documents', count(*) FROM documents "
       "UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part")
def _(spark, sf_dir):
    folder = _folder(spark)
    for name, fmt in (("orders", "csv"), ("part", "tsv"), ("customer", "parquet"), ("documents", "json")):
        sinks.redacted_export(load(spark, sf_dir, name), {}, folder, fmt)
    return files.row_counts(files.load_dataset(spark, folder))


def _describe_sql() -> str:
    parts = []
    for name in EVERY:
        items = [c.split(" ") for c in SCHEMAS[name].split(", ")]
        if name == "embeddings":
            items.insert(1, ["embedding", "array<float>"])
        parts += [
            f"SELECT {quote(name)} AS \"table\", {quote(c)} AS \"column\", {i} AS ordinal, {quote(t)} AS dtype, (SELECT count(*) FROM {name}) AS row_count"
            for i, (c, t) in enumerate(items)
        ]
    return " UNION ALL ".join(parts)


@query("describe_tables", _describe_sql())
def _(spark, sf_dir):
    return files.describe_tables(load(spark, sf_dir, *EVERY))


@query("source_fingerprint")
def _(spark, sf_dir):
    return files.source_fingerprint(load(spark, sf_dir, *EVERY))


@query("redacted_export", f"SELECT * EXCLUDE (customer_name, phone) FROM {SOURCES['contacts']}")
def _(spark, sf_dir):
    denied = {"contacts": ["customer_name", "phone"]}
    paths = sinks.redacted_export(derive(spark, sf_dir, "contacts"), denied, _folder(spark), "parquet")
    return files.read_table(spark, paths["contacts"])


@query("warehouse_load", "SELECT 'customer' AS \"table\", count(*) AS row_count FROM customer UNION ALL SELECT 'orders', count(*) FROM orders")
def _(spark, sf_dir):
    run = uuid4().hex[:12]
    name = sinks.warehouse_load(load(spark, sf_dir, "customer", "orders"), run, "sales upload")
    loaded = Dataset({t: spark.table(f"`{name}`.`{t}`") for t in ("customer", "orders")})
    counts = cut(files.row_counts(loaded))
    sinks.warehouse_drop(spark, run, "sales upload")
    return counts


@query("normalize_rows", "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance, c_mktsegment FROM customer")
def _(spark, sf_dir):
    gaps = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).otherwise(F.lit(float("nan")))
    return sinks.normalize_rows(
        table(spark, sf_dir, "customer").select("c_custkey", gaps.alias("balance"), "c_mktsegment"))


# --------------------------------------------------------------- exploration

@query("adhoc_aggregate",
       "SELECT l_returnflag AS grp, round(median(l_extendedprice), 4) AS value FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1")
def _(spark, sf_dir):
    ds = load(spark, sf_dir, "lineitem")
    found = explore.adhoc_aggregate(ds, "lineitem", "l_extendedprice", "median", "l_returnflag", {"l_linestatus": "O"})
    return found.withColumn("value", F.round("value", 4))


@query("sample_contains",
       "SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(CAST(p_partkey AS VARCHAR)), 'red') OR contains(lower(p_name), 'red') "
       "OR contains(lower(p_brand), 'red') ORDER BY p_partkey, p_name, p_brand LIMIT 15")
def _(spark, sf_dir):
    return explore.sample_contains(load(spark, sf_dir, "part"), "part", ["p_partkey", "p_name", "p_brand"], "Red")


@query("value_set_coverage",
       "SELECT i AS place, v AS candidate, v IN (SELECT o_orderstatus FROM orders) AS present "
       "FROM (VALUES (0, 'F'), (1, 'O'), (2, 'X')) t(i, v)")
def _(spark, sf_dir):
    return explore.value_set_coverage(load(spark, sf_dir, "orders"), "orders", "o_orderstatus", ["F", "O", "X"])


@query("value_set_summary",
       "SELECT 'orders' AS \"table\", 'o_orderstatus' AS \"column\", count(*) FILTER (WHERE v IN (SELECT o_orderstatus FROM orders)) AS matched, "
       "count(*) AS candidates, coalesce(string_agg(v, ', ' ORDER BY i) FILTER (WHERE v NOT IN (SELECT o_orderstatus FROM orders)), '') AS absent, "
       "(SELECT count(DISTINCT o_orderstatus) FROM orders) AS real_values, "
       "round(count(*) FILTER (WHERE v IN (SELECT o_orderstatus FROM orders)) / count(*), 4) AS coverage_ratio "
       "FROM (VALUES (0, 'F'), (1, 'O'), (2, 'X')) t(i, v)")
def _(spark, sf_dir):
    return explore.coverage_summary(load(spark, sf_dir, "orders"), "orders", "o_orderstatus", ["F", "O", "X"])


@query("search_records",
       "SELECT o_orderkey, o_custkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority "
       "FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' ORDER BY o_orderkey LIMIT 20")
def _(spark, sf_dir):
    return _dated(explore.search_records(
        load(spark, sf_dir, "orders"), "orders", {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"},
        ("o_totalprice",), ["o_orderkey"]))


GUARDED = (
    "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS revenue FROM customer "
    "JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment"
)


@query("guarded_sql", GUARDED)
def _(spark, sf_dir):
    guard = explore.GuardedSql(spark, lambda s: load(s, sf_dir, "customer", "orders"), {"customer": ["c_name"]})
    return guard.query(GUARDED)


@query("guarded_answer", GUARDED)
def _(spark, sf_dir):
    guard = explore.GuardedSql(spark, lambda s: load(s, sf_dir, "customer", "orders"), {"customer": ["c_name"]})
    return guard.answer(GUARDED, seconds=60)


# ------------------------------------------------------------------- binding

BOUND = ("sales", "customer", "lineitem")
BOUND_CTES = columns_ctes(BOUND, ("lineitem",), **EXTRA)


def _list(values) -> str:
    return f"[{words(values)}]::VARCHAR[]"


def _score_ctes() -> str:
    roles = ", ".join(
        f"({quote(r)}, {_list(RETAIL.role_hints.get(r, ()))}, {_list(expected_roles(r))})" for r in RETAIL.roles)

    def tokens(x: str) -> str:
        return f"list_distinct(list_filter(regexp_split_to_array(lower(trim({x})), '[_\\s]+'), lambda t: t <> ''))"

    def core(x: str) -> str:
        return f"list_filter({tokens(x)}, lambda t: NOT list_contains({_list(GENERIC_NAME_TOKENS)}, t))"

    def overlap(a: str, b: str) -> str:
        union = f"len(list_distinct(list_concat({a}, {b})))"
        return f"CASE WHEN {union} > 0 THEN len(list_intersect({a}, {b})) / {union} ELSE 0e0 END"

    return f"""
roles(role, hints, expected) AS (VALUES {roles}),
named AS (SELECT c.tbl, c.col, c.ordinal, c.guessed_role, r.*,
    CASE WHEN len(list_filter(hints, lambda h: contains(lower(col), h))) > 0 THEN 1e0 ELSE
      0.6e0 * (CASE WHEN len({core('role')}) > 0 AND len({core('col')}) > 0 THEN {overlap(core('role'), core('col'))} ELSE 0e0 END)
      + 0.4e0 * ({overlap(tokens('role'), tokens('col'))}) END AS name_score,
    CASE WHEN len(expected) = 0 THEN 0.5e0 WHEN list_contains(expected, guessed_role) THEN 1e0 ELSE 0.25e0 END AS type_score
  FROM columns_ c, roles r WHERE NOT is_pii AND guessed_role NOT IN ({words(RETAIL.denied_roles)})),
scores AS (SELECT tbl, col, ordinal, guessed_role, role, round(least(1e0, 0.55e0 * name_score + 0.45e0 * type_score), 4) AS score FROM named),
best AS (SELECT role, col, score, row_number() OVER (PARTITION BY role ORDER BY score DESC, ordinal) AS place FROM scores WHERE tbl = 'sales'),
bindings AS (SELECT role, CASE WHEN score >= 0.4 THEN col END AS col, CASE WHEN score >= 0.4 THEN score END AS confidence,
    CASE WHEN role = 'location' OR score >= 0.7 THEN 'resolved' WHEN score >= 0.4 THEN 'needs_confirmation' ELSE 'unresolved' END AS status
  FROM best WHERE place = 1)"""


SCORES = _score_ctes()


def _bound(spark, sf_dir, *names) -> DataFrame:
    return Profile(derive(spark, sf_dir, *names)).columns


@query("role_scores", with_(BOUND_CTES, SCORES, select="SELECT tbl AS \"table\", col AS \"column\", role, score FROM scores"))
def _(spark, sf_dir):
    return binding.role_scores(_bound(spark, sf_dir, *BOUND), RETAIL).select("table", "column", "role", "score")


OVERRIDES = {"location": "sales.order_status"}


@query("role_bindings", with_(
    BOUND_CTES, SCORES,
    select="SELECT role, CASE WHEN role = 'location' THEN 'order_status' ELSE col END AS \"column\", "
    "CASE WHEN role = 'location' THEN 1e0 ELSE confidence END AS confidence, status, "
    "CASE WHEN role = 'location' THEN 'human_override' WHEN status <> 'unresolved' THEN 'deterministic' END AS source, "
    "CASE WHEN status = 'needs_confirmation' THEN (SELECT string_agg(col, ',' ORDER BY place) FROM best o WHERE o.role = b.role AND place BETWEEN 2 AND 4) END AS alternatives "
    "FROM bindings b"))
def _(spark, sf_dir):
    found = binding.role_bindings(_bound(spark, sf_dir, "sales"), RETAIL, "sales", OVERRIDES)
    return found.withColumn("alternatives", F.array_join("alternatives", ","))


@query("pack_fact_table", with_(
    BOUND_CTES, SCORES,
    select="SELECT tbl AS \"table\", round(sum(best) FILTER (WHERE best >= 0.4), 4) AS total FROM "
    "(SELECT tbl, role, max(score) AS best FROM scores GROUP BY tbl, role) GROUP BY tbl ORDER BY total DESC NULLS LAST, tbl LIMIT 1"))
def _(spark, sf_dir):
    found = binding.pack_fact_table(_bound(spark, sf_dir, *BOUND), RETAIL)
    return found.withColumn("total", F.round("total", 4))


@query("value_sets", "SELECT DISTINCT s AS value_set, order_status AS value FROM " + SOURCES["sales"] + ", (VALUES "
       + ", ".join(f"({quote(s)}, {quote(h)})" for s, hints in RETAIL.value_set_hints.items() for h in hints)
       + ") hints(s, h) WHERE contains(lower(order_status), h)")
def _(spark, sf_dir):
    return binding.value_sets(derive(spark, sf_dir, "sales"), "sales", "order_status", RETAIL)


USES = ", ".join(f"({quote(r)}, {quote(k.id)})" for k in K.pack_kpis(RETAIL.slug) for r in k.requires)


@query("binding_gate", with_(
    BOUND_CTES, SCORES, f"uses(role, kpi_id) AS (VALUES {USES})",
    select="SELECT b.role, b.col AS \"column\", b.confidence, string_agg(u.kpi_id, ', ' ORDER BY u.kpi_id) AS kpis_affected "
    "FROM bindings b JOIN uses u USING (role) WHERE b.status = 'needs_confirmation' AND u.kpi_id NOT IN "
    "(SELECT kpi_id FROM uses WHERE role IN (SELECT role FROM bindings WHERE status = 'unresolved')) GROUP BY ALL"))
def _(spark, sf_dir):
    bound = binding.role_bindings(_bound(spark, sf_dir, "sales"), RETAIL, "sales", OVERRIDES)
    return binding.binding_gate(bound, RETAIL)


GATED_SQL = """gated AS (SELECT DISTINCT role FROM bindings b JOIN uses u USING (role) WHERE status = 'needs_confirmation'
  AND kpi_id NOT IN (SELECT kpi_id FROM uses WHERE role IN (SELECT role FROM bindings WHERE status = 'unresolved')))"""
#: Columns that people of the invented log of decisions name, and one that was never offered.
OFFERED = [c.split(" ")[0] for c in ALL_SCHEMAS["sales"].split(", ")] + ["elsewhere"]


@query("confirmed_bindings", with_(
    BOUND_CTES, SCORES, f"uses(role, kpi_id) AS (VALUES {USES})", GATED_SQL,
    f"log AS (SELECT ({_list(RETAIL.roles)})[1 + o_custkey % {len(RETAIL.roles)}] AS role, "
    f"({_list(OFFERED)})[1 + (o_orderkey // 4) % {len(OFFERED)}] AS answer, o_orderkey AS decided FROM orders)",
    "answers AS (SELECT role, arg_max(answer, decided) AS answer FROM log GROUP BY role)",
    select="SELECT b.role, CASE WHEN g.role IS NOT NULL THEN answer WHEN b.role = 'location' THEN 'order_status' ELSE b.col END AS \"column\", "
    "CASE WHEN g.role IS NOT NULL OR b.role = 'location' THEN 1e0 ELSE confidence END AS confidence, "
    "CASE WHEN g.role IS NOT NULL THEN 'resolved' ELSE status END AS status, "
    "CASE WHEN g.role IS NOT NULL OR b.role = 'location' THEN 'human_override' WHEN status <> 'unresolved' THEN 'deterministic' END AS source "
    "FROM bindings b LEFT JOIN gated g ON g.role = b.role LEFT JOIN answers a ON a.role = b.role "
    "WHERE g.role IS NULL OR answer = b.col OR EXISTS (SELECT 1 FROM best o WHERE o.role = b.role AND o.col = answer AND place BETWEEN 2 AND 4)"))
def _(spark, sf_dir):
    bound = binding.role_bindings(_bound(spark, sf_dir, "sales"), RETAIL, "sales", OVERRIDES)

    def pick(values, number):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))

    log = table(spark, sf_dir, "orders").select(
        pick(RETAIL.roles, F.col("o_custkey")).alias("role"),
        pick(OFFERED, F.floor(F.col("o_orderkey") / 4)).alias("answer"), F.col("o_orderkey").alias("decided"))
    found = binding.confirmed_bindings(bound, binding.binding_gate(bound, RETAIL), log)
    return found.drop("alternatives")


def _pack_sql() -> str:
    parts = []
    for p in PACKS:
        def share(hints, test: str) -> str:
            if not hints:
                return "0e0"
            hits = " + ".join(f"(SELECT CAST(count(*) > 0 AS INT) FROM columns_ WHERE {test.format(h=quote(h))})" for h in hints)
            return f"({hits}) / {len(hints)}e0"

        low, high = p.table_count
        parts.append(
            f"SELECT {quote(p.slug)} AS pack, round(0.35e0 * {share(p.entity_hints, 'contains(lower(tbl), {h})')} "
            f"+ 0.35e0 * {share(p.column_hints, 'contains(lower(col), {h})')} + 0.2e0 * {share(p.required_roles, 'guessed_role = {h}')} "
            f"+ 0.1e0 * (SELECT CASE WHEN count(DISTINCT tbl) BETWEEN {low} AND {high} THEN 1e0 ELSE 0.3e0 END FROM columns_), 4) AS score")
    return " UNION ALL ".join(parts)


PACKED = ("orders", "sales", "contacts")
PACK_CTES = (columns_ctes(PACKED, (), **EXTRA), f"pack_scores AS ({_pack_sql()})")


@query("pack_scores", with_(*PACK_CTES, select="SELECT pack, score FROM pack_scores"))
def _(spark, sf_dir):
    return binding.pack_scores(Profile(derive(spark, sf_dir, *PACKED)).columns)


@query("pack_ranking", with_(
    *PACK_CTES, "ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, pack) AS place, max(score) OVER () AS top FROM pack_scores)",
    select="SELECT pack, score, place, CASE WHEN place = 1 THEN 'primary' WHEN place = 2 AND score >= 0.3 AND top - score <= 0.12 THEN 'secondary' ELSE 'other' END AS choice, "
    "place = 1 AND score < 0.45 AS needs_confirmation FROM ranked"))
def _(spark, sf_dir):
    return binding.pack_ranking(binding.pack_scores(Profile(derive(spark, sf_dir, *PACKED)).columns))


# --------------------------------------------------------------------- gates

STARRED = ("customer", "supplier", "part", "orders", "lineitem", "labels")
UNIT_SQL = (
    "CASE WHEN {c} LIKE '%price' OR {c} LIKE '%bal' OR {c} LIKE '%tax' THEN 'currency' "
    "WHEN {c} LIKE '%discount' OR {c} LIKE '%size' THEN 'percent' WHEN {c} LIKE '%quantity' THEN 'score' "
    "WHEN {c} LIKE '%date' THEN 'time' ELSE 'count' END"
)
CLAIMED = f"claims AS (SELECT *, {UNIT_SQL.format(c='col')} AS unit FROM structural)"


def _unit_claims(structural: DataFrame) -> DataFrame:
    return structural.select(
        "table", "column", F.expr(UNIT_SQL.format(c="`column`")).alias("unit"), F.lit("measure").alias("kind"),
        F.array(F.lit("mean"), F.when(F.col("family") == "fraction", F.lit("sum")).otherwise(F.lit("max"))).alias("aggregations"))


_RULES = (
    ("unit = 'currency' AND min_value >= 0 AND max_value <= 100", "money bounded by 0 and 100"),
    ("unit = 'currency' AND min_value < 0", "negative money"),
    ("unit = 'percent' AND min_value < 0", "negative percentage"),
    ("unit = 'percent' AND max_value > 100", "percentage above 100"),
    ("unit = 'score' AND max_value > 1000", "score above 1000"),
    ("unit = 'count' AND min_value < 0", "negative count"),
    ("unit = 'time' AND cardinality < 2", "time with fewer than two points"),
)
REASONS = "concat_ws('; ', " + ", ".join(f"CASE WHEN {t} THEN '{w}' END" for t, w in _RULES) + ")"


@query("gate_distribution", with_(
    structural_ctes(STARRED), CLAIMED,
    select=f"SELECT tbl AS \"table\", col AS \"column\", unit, CASE WHEN {REASONS} = '' THEN 'verified' ELSE 'failed' END AS verdict, {REASONS} AS reasons FROM claims"))
def _(spark, sf_dir):
    known = Profile(load(spark, sf_dir, *STARRED)).structural
    return gates.gate_distribution(_unit_claims(known), known)


@query("gate_aggregation", with_(
    structural_ctes(STARRED), CLAIMED,
    select="SELECT tbl AS \"table\", col AS \"column\", unit, CASE WHEN cardinality = 0 OR unit IN ('percent', 'score') AND family = 'fraction' THEN 'failed' ELSE 'verified' END AS verdict FROM claims"))
def _(spark, sf_dir):
    known = Profile(load(spark, sf_dir, *STARRED)).structural
    return gates.gate_aggregation(_unit_claims(known), known)


@query("gate_relation", with_(
    structural_ctes(STARRED), RELATIONS,
    select="SELECT from_table, from_column, to_table, to_column, round(overlap_ratio, 6) AS overlap_ratio, "
    "CASE WHEN overlap_ratio < 0.5 THEN 'failed' ELSE 'verified' END AS verdict FROM facts WHERE overlap_ratio > 0"))
def _(spark, sf_dir):
    known = Profile(load(spark, sf_dir, *STARRED))
    facts = relations.edge_facts(known.frequency, relations.candidate_pairs(known.structural))
    return gates.gate_relation(facts.where("overlap_ratio > 0")).withColumn("overlap_ratio", F.round("overlap_ratio", 6))


CANDIDATE_SETS = {"half": ["F", "O"], "wrong": ["F", "active"], "whole": ["F", "O", "P"]}


@query("gate_value_set", " UNION ALL ".join(
    f"SELECT '{name}' AS claim, count(*) FILTER (WHERE v IN (SELECT o_orderstatus FROM orders)) AS matched, count(*) AS candidates, "
    "(SELECT count(DISTINCT o_orderstatus) FROM orders) AS real_values, "
    "CASE WHEN count(*) FILTER (WHERE v IN (SELECT o_orderstatus FROM orders)) < count(*) THEN 'failed' ELSE 'verified' END AS verdict, "
    "count(*) FILTER (WHERE v IN (SELECT o_orderstatus FROM orders)) = count(*) AND count(*) / (SELECT count(DISTINCT o_orderstatus) FROM orders) < 0.8 AS warning "
    f"FROM (VALUES {', '.join(f'({quote(v)})' for v in values)}) t(v)"
    for name, values in CANDIDATE_SETS.items()))
def _(spark, sf_dir):
    ds = load(spark, sf_dir, "orders")
    parts = [
        gates.gate_value_set(explore.coverage_summary(ds, "orders", "o_orderstatus", values))
        .select(F.lit(name).alias("claim"), "matched", "candidates", "real_values", "verdict", "warning")
        for name, values in CANDIDATE_SETS.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("gate_money_range",
       "SELECT 'revenue_amount' AS role, 'l_discount' AS \"column\", CASE WHEN min(l_discount) >= 0 AND max(l_discount) <= 100 THEN 'error' ELSE 'pass' END AS severity FROM lineitem "
       "UNION ALL SELECT 'payment_channel', 'l_extendedprice', CASE WHEN min(l_extendedprice) >= 0 AND max(l_extendedprice) <= 100 THEN 'error' ELSE 'pass' END FROM lineitem")
def _(spark, sf_dir):
    known = structural_columns(load(spark, sf_dir, "lineitem"))
    known = cut(known)
    chosen = {"revenue_amount": "lineitem.l_discount", "payment_channel": "l_extendedprice"}
    bound = binding.role_bindings(known, RETAIL, "lineitem", chosen).where(F.col("source") == "human_override")
    return gates.gate_money_range(bound, known, RETAIL, "lineitem")


@query("fact_check",
       "SELECT 'error' AS severity, 'column:order_ref' AS location, 'order_number is not a column with values' AS message FROM "
       f"(SELECT count(order_ref) AS n FROM {SOURCES['sales']}) WHERE n > 0 UNION ALL SELECT 'warning', 'kpi:revenue_by_location', 'unresolved roles: location' "
       "UNION ALL SELECT 'warning', 'kpi:orders_by_payment_channel', 'unresolved roles: payment_channel'")
def _(spark, sf_dir):
    bound = K.Bindings({"revenue_amount": "revenue_amount", "transaction_status": "order_status",
                        "transaction_date": "order_date", "order_ref": "order_number"})
    return gates.fact_check(bound, K.pack_kpis(RETAIL.slug), structural_columns(derive(spark, sf_dir, "sales")))


SCANNED = {"documents": "text", "conversations": "text", "pages": "html"}


@query("pii_text_scan", " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", '{kind}' AS kind, count(*) FILTER (WHERE n > 0) AS texts, CAST(coalesce(sum(n), 0) AS BIGINT) AS matches "
    f"FROM (SELECT len(regexp_extract_all({c}, {quote(pattern)})) AS n FROM {t})"
    for t, c in SCANNED.items() for kind, pattern in PERSONAL_VALUE_PATTERNS.items()))
def _(spark, sf_dir):
    return gates.pii_text_scan(load(spark, sf_dir, *SCANNED), SCANNED)


# ------------------------------------------------------------------ insights

INSIGHT_CTES = columns_ctes(("sales",), (), **EXTRA)
S = SOURCES["sales"]
# the measures of `sales` in column order, its dimensions and its time column
_MEASURES, _DIMENSIONS, _STATUS, _TIME = ("customer_ref", "revenue_amount"), ("order_status", "payment_channel"), "order_status", "order_date"


def _insight_sql(kind: str) -> list[tuple[str, float, str]]:
    total = "CAST(round(sum({m}), 2) AS DOUBLE)"
    pairs = [(m, d) for m in _MEASURES for d in _DIMENSIONS]
    if kind == "trend":
        return [
            (f"{g} trend of {m} over {_TIME}", support,
             f"SELECT strftime(date_trunc('{g}', {_TIME}), '%Y-%m-%d') AS key, {total.format(m=m)} AS value FROM {S} GROUP BY 1")
            for m in _MEASURES for g, support in (("month", 0.75), ("week", 0.6))]
    if kind == "breakdown":
        return [(f"{m} by {d}", 0.7, f"SELECT {d} AS key, {total.format(m=m)} AS value FROM {S} GROUP BY 1") for m, d in pairs]
    if kind == "distribution":
        return [(f"distribution of {d}", 0.65, f"SELECT {d} AS key, CAST(count(*) AS DOUBLE) AS value FROM {S} GROUP BY 1") for d in _DIMENSIONS]
    if kind == "status_sum":
        return [(f"{m} for the most frequent {_STATUS}", 0.6,
                 f"SELECT {_STATUS} AS key, {total.format(m=m)} AS value FROM {S} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1") for m in _MEASURES]
    return [(f"top {d} by {m}", 0.6, f"SELECT {d} AS key, {total.format(m=m)} AS value FROM {S} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
            for m, d in pairs if d == "payment_channel"]


def _insights(spark, sf_dir, names=("sales",)):
    known = Profile(derive(spark, sf_dir, *names))
    return known.ds, insights.propose_insights(known.columns)


def _insight_query(name: str, kind: str, sql: list, names=("sales",)) -> None:
    oracle = " UNION ALL ".join(f"SELECT {quote(q)} AS question, key, value FROM ({s})" for q, _, s in sql)

    @query(name, oracle)
    def _(spark, sf_dir):
        ds, found = _insights(spark, sf_dir, names)
        parts = []
        for i in (i for i in found if i.kind == kind):
            rows = insights.run_insight(ds, i)
            key = F.date_format("key", "yyyy-MM-dd") if kind == "trend" else F.col("key").cast("string")
            parts.append(rows.select(F.lit(i.question).alias("question"), key.alias("key"), F.round(F.col("value").cast("double"), 2).alias("value")))
        result = spark.createDataFrame([], "question string, key string, value double")
        for part in parts:
            result = result.unionByName(part)
        return result


for _kind in ("trend", "breakdown", "distribution", "status_sum"):
    _insight_query(f"insight_{_kind}", _kind, _insight_sql(_kind))

# contacts has three columns of the five values that a top list needs
_insight_query("insight_top_n", "top_n", [
    (f"top {d} by balance", 0.6, f"SELECT {d} AS key, CAST(round(sum(balance), 2) AS DOUBLE) AS value FROM {SOURCES['contacts']} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
    for d in ("link", "referral_status", "segment")],
    ("contacts",))


@query("insight_ranking", " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, {quote(q)} AS question, {support}::DOUBLE AS support, (SELECT count(*) FROM ({s})) AS \"rows\""
    for kind in ("trend", "breakdown", "distribution", "status_sum", "top_n") for q, support, s in _insight_sql(kind)))
def _(spark, sf_dir):
    return insights.rank_insights(*_insights(spark, sf_dir))


# ------------------------------------------------------------------- scoring

# Answers about orders: some state the total (with a thousands comma), some a
# label, some refuse and some do not.
ANSWERS = (
    "SELECT o_orderkey AS answer_id, o_orderpriority AS dataset, o_totalprice AS truth, "
    "CASE o_orderstatus WHEN 'F' THEN 'numeric' WHEN 'P' THEN 'categorical' ELSE 'negative' END AS category, "
    "CASE WHEN o_orderstatus = 'F' AND o_custkey % 4 = 0 THEN concat('Order ', CAST(o_orderkey AS STRING), ' has no total.') "
    "WHEN o_orderstatus = 'F' THEN concat('In 1997 order ', CAST(o_orderkey AS STRING), ' came to ', "
    "CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS STRING), ',', lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS STRING), 3, '0'), '.5 in all') "
    "WHEN o_orderstatus = 'P' THEN concat('The priority is ', CASE WHEN o_custkey % 5 = 0 THEN 'unknown' ELSE lower(o_orderpriority) END) "
    "WHEN o_custkey % 3 = 0 THEN 'We do not have that figure for 1997' WHEN o_custkey % 3 = 1 THEN concat('It is ', CAST(o_custkey AS STRING)) "
    "ELSE 'Nobody can say' END AS answer, o_orderdate AS asked_on FROM orders"
)
NUMERIC_SQL = (
    f"len(list_filter(regexp_extract_all(answer, {quote(ANSWER_NUMBER_PATTERN)}), lambda x: abs(try_cast(replace(x, ',', '') AS DOUBLE) - truth) <= 1.0)) > 0"
)
QUALIFIED_SQL = "(" + " OR ".join(f"contains(lower(answer), {quote(p)})" for p in scoring.QUALIFYING_PHRASES) + ")"
REFUSAL_SQL = (
    f"({QUALIFIED_SQL} OR len(list_filter(regexp_extract_all(answer, {quote(ANSWER_NUMBER_PATTERN)}), lambda x: try_cast(replace(x, ',', '') AS DOUBLE) IS NOT NULL)) = 0)"
)
CATEGORICAL_SQL = "(contains(lower(answer), lower(dataset)) OR contains(lower(answer), 'top priority'))"
A = f"({ANSWERS})"


def _answers(spark, sf_dir) -> DataFrame:
    return spark.sql(ANSWERS.replace(" FROM orders", " FROM {orders}"), orders=table(spark, sf_dir, "orders"))


@query("score_numeric", f"SELECT answer_id, {NUMERIC_SQL} AS passed FROM {A}")
def _(spark, sf_dir):
    passed = scoring.score_numeric(F.col("answer"), F.col("truth"), F.lit(1.0))
    return _answers(spark, sf_dir).select("answer_id", passed.alias("passed"))


@query("score_categorical", f"SELECT answer_id, {CATEGORICAL_SQL} AS passed FROM {A}")
def _(spark, sf_dir):
    labels = F.array(F.col("dataset"), F.lit("Top Priority"))
    return _answers(spark, sf_dir).select("answer_id", scoring.score_categorical(F.col("answer"), labels).alias("passed"))


@query("score_refusal", f"SELECT answer_id, {REFUSAL_SQL} AS passed FROM {A}")
def _(spark, sf_dir):
    return _answers(spark, sf_dir).select("answer_id", scoring.score_refusal(F.col("answer")).alias("passed"))


@query("score_tool", "SELECT event_id, CASE WHEN user_id % 4 = 0 THEN NULL ELSE event_type IN ('click', 'view') END AS passed FROM events")
def _(spark, sf_dir):
    expected = F.when(F.col("user_id") % 4 != 0, F.col("event_type"))
    calls = F.array(F.lit("click"), F.lit("view"))
    return table(spark, sf_dir, "events").select("event_id", scoring.score_tool(calls, expected).alias("passed"))


def _results(spark, sf_dir) -> DataFrame:
    answer = F.col("answer")
    passed = (
        F.when(F.col("category") == "numeric", scoring.score_numeric(answer, F.col("truth"), F.lit(1.0)))
        .when(F.col("category") == "categorical", scoring.score_categorical(answer, F.array("dataset")))
        .otherwise(scoring.score_refusal(answer))
    )
    negative = F.col("category") == "negative"
    return _answers(spark, sf_dir).select(
        "dataset", "category", "asked_on", passed.alias("passed"),
        answer.contains("unknown").alias("errored"),
        (negative & ~scoring.score_refusal(answer)).alias("false_confidence"),
        F.when(negative, answer.contains("figure")).alias("tool_correct"))


RESULTS = (
    "results AS (SELECT dataset, category, asked_on, "
    f"CASE category WHEN 'numeric' THEN {NUMERIC_SQL} WHEN 'categorical' THEN contains(lower(answer), lower(dataset)) ELSE {REFUSAL_SQL} END AS passed, "
    f"contains(answer, 'unknown') AS errored, category = 'negative' AND NOT {REFUSAL_SQL} AS false_confidence, "
    f"CASE WHEN category = 'negative' THEN contains(answer, 'figure') END AS tool_correct FROM {A})"
)


NEGATIVE = "category = 'negative'"


def _summary_sql(where: str = "true") -> str:
    def pct(part: str, whole: str) -> str:
        return f"round(100.0 * count(*) FILTER (WHERE {part}) / nullif(count(*) FILTER (WHERE {whole}), 0), 1)::DOUBLE"

    return (
        "SELECT dataset, count(*) AS total_questions, count(*) FILTER (WHERE errored) AS errored, "
        f"{pct('NOT errored AND passed', 'NOT errored')} AS answer_accuracy, {pct('NOT errored', 'true')} AS capability_coverage, "
        f"{pct('false_confidence', 'true')} AS false_confidence_rate, {pct(NEGATIVE + ' AND passed', NEGATIVE)} AS refusal_correctness, "
        f"{pct('tool_correct', 'tool_correct IS NOT NULL')} AS tool_selection_precision FROM results WHERE {where} GROUP BY ROLLUP (dataset)"
    )


@query("eval_summary", with_(RESULTS, select=_summary_sql()))
def _(spark, sf_dir):
    return scoring.eval_summary(_results(spark, sf_dir))


@query("eval_by_category", with_(
    RESULTS, select="SELECT dataset, category, round(100.0 * count(*) FILTER (WHERE passed) / count(*), 1) AS accuracy FROM results GROUP BY ALL"))
def _(spark, sf_dir):
    return scoring.category_accuracy(_results(spark, sf_dir))


_LONG = (
    "SELECT dataset, measure, v FROM {t} UNPIVOT INCLUDE NULLS (v FOR measure IN (answer_accuracy, capability_coverage, "
    "false_confidence_rate, refusal_correctness, tool_selection_precision))"
)


@query("eval_diff", with_(
    RESULTS, f"early AS ({_summary_sql('asked_on < DATE ' + quote('1998-01-01'))})", f"late AS ({_summary_sql('asked_on >= DATE ' + quote('1998-01-01'))})",
    f"a AS ({_LONG.format(t='early')})", f"b AS ({_LONG.format(t='late')})",
    select="SELECT a.dataset, a.measure, a.v AS baseline, b.v AS current, round(b.v - a.v, 1) AS delta FROM a JOIN b ON a.dataset IS NOT DISTINCT FROM b.dataset AND a.measure = b.measure"))
def _(spark, sf_dir):
    results = _results(spark, sf_dir)
    early = F.col("asked_on") < F.lit("1998-01-01").cast("timestamp_ntz")
    return scoring.eval_diff(scoring.eval_summary(results.where(early)), scoring.eval_summary(results.where(~early)))


# Hand labels for `contacts`: role, key and personal data; two of them wrong on purpose.
EXPECTED = (
    ("customer_id", "identifier", True, False), ("customer_name", "free_text", False, True), ("phone", "phone", False, True),
    ("balance", "currency", False, False), ("segment", "enum", False, False), ("joined_on", "date", False, True),
)


@query("profile_accuracy", with_(
    columns_ctes(("contacts",), (), **EXTRA),
    "labels_(col, role, is_key, personal) AS (VALUES " + ", ".join(f"({quote(c)}, {quote(r)}, {k}, {p})" for c, r, k, p in EXPECTED) + ")",
    select="SELECT count(*) FILTER (WHERE is_key AND grain = col) AS grain_hits, count(*) FILTER (WHERE is_key) AS grain_total, "
    "count(*) FILTER (WHERE role = guessed_role OR role = fingerprint) AS role_hits, count(role) AS role_total, "
    "count(*) FILTER (WHERE personal AND is_pii) AS personal_hits, count(*) FILTER (WHERE personal) AS personal_total, "
    "count(*) FILTER (WHERE NOT coalesce(personal, false) AND is_pii) AS personal_false "
    "FROM columns_ JOIN grains USING (tbl) LEFT JOIN labels_ USING (col)"))
def _(spark, sf_dir):
    known = Profile(derive(spark, sf_dir, "contacts"))
    labels = spark.createDataFrame(
        [("contacts", *row) for row in EXPECTED], "table string, column string, role string, is_key boolean, is_personal boolean")
    return scoring.profile_accuracy(known.columns, known.grains, labels)


@query("latest_by_key",
       "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def _(spark, sf_dir):
    history = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return scoring.latest_by_key(history, ["user_id", "event_type"], "event_id")


@query("recent_top_n",
       "SELECT user_id, event_type, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS place FROM events "
       "WHERE event_type <> 'error' AND value IS NOT NULL QUALIFY place <= 3")
def _(spark, sf_dir):
    history = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    other = history.where("event_type <> 'error' AND value IS NOT NULL")
    return scoring.recent_top_n(other, ["user_id", "event_type"], "event_id")
