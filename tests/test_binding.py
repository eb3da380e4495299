import pytest
from conftest import rows
from pyspark.sql import functions as F

from lakegauge.operators import binding, gates, insights, scoring
from lakegauge.operators.profile import Profile
from lakegauge.plans import kpis as K
from lakegauge.plans.packs import EDTECH, GENERIC, HEALTHCARE, RETAIL


@pytest.fixture(scope="module")
def booked(bookings):
    return Profile(bookings)


@pytest.fixture(scope="module")
def shop(retail):
    return Profile(retail)


@pytest.fixture(scope="module")
def school(edtech):
    return Profile(edtech)


def top_pack(profile):
    return binding.pack_ranking(binding.pack_scores(profile.columns)).where("choice = 'primary'").first()["pack"]


def test_pack_choice(booked, shop, school):
    assert top_pack(booked) == HEALTHCARE.slug
    assert top_pack(shop) == RETAIL.slug
    assert top_pack(school) == EDTECH.slug


def test_bookings_bindings(booked):
    bound = {r["role"]: r for r in binding.role_bindings(booked.columns, HEALTHCARE, "bookings").collect()}
    assert set(bound) == set(HEALTHCARE.roles)
    assert bound["partner_name"]["column"] == "lab_partner" and bound["partner_name"]["status"] == "resolved"
    assert bound["revenue_amount"]["column"] == "amount_inr"
    assert not {r["column"] for r in bound.values()} & {"phone", "customer_name"}
    for r in bound.values():
        if r["status"] == "needs_confirmation":
            assert 0.4 <= r["confidence"] < 0.7 and len(r["alternatives"]) <= 3
    person = binding.role_bindings(booked.columns, HEALTHCARE, "bookings", {"customer_ref": "bookings.household_id", "location": "nope"})
    person = {r["role"]: r for r in person.collect()}
    assert (person["customer_ref"]["column"], person["customer_ref"]["source"]) == ("household_id", "human_override")
    assert person["location"]["source"] != "human_override"


def test_gate_and_confirmations(spark, booked):
    bound = binding.role_bindings(booked.columns, HEALTHCARE, "bookings")
    gated = binding.binding_gate(bound, HEALTHCARE)
    asked = {r["role"]: r for r in gated.collect()}
    assert asked and all(r["kpis_affected"] for r in asked.values())
    role = sorted(asked)[0]
    answers = spark.createDataFrame([(role, asked[role]["column"])], "role string, answer string")
    after = {r["role"]: r for r in binding.apply_confirmations(bound, gated, answers).collect()}
    assert after[role]["source"] == "human_override" and after[role]["confidence"] == 1.0
    assert not set(asked) - {role} & set(after)


def test_last_decision_of_a_log_counts(spark, booked):
    bound = binding.role_bindings(booked.columns, HEALTHCARE, "bookings")
    gated = binding.binding_gate(bound, HEALTHCARE)
    asked = {r["role"]: r["column"] for r in gated.collect()}
    role = sorted(asked)[0]

    def after(*log):
        rows = spark.createDataFrame(list(log), "role string, answer string, decided long")
        return {r["role"]: r for r in binding.confirmed_bindings(bound, gated, rows).collect()}

    many = [(role, "elsewhere", i) for i in range(50)] + [(None, "x", 99), (role, "x", None)]
    assert after(*many, (role, asked[role], 50))[role]["source"] == "human_override"
    assert role not in after(*many) and role not in after((role, asked[role], 1), (role, None, 2))
    assert not set(asked) & set(after())


def test_fact_tables(shop, school):
    assert binding.pack_fact_table(shop.columns, RETAIL).first()["table"] == "orders"
    assert binding.pack_fact_table(school.columns, EDTECH, central="courses").first()["table"] == "courses"


def test_value_sets(bookings):
    got = rows(binding.value_sets(bookings, "bookings", "status", HEALTHCARE), "value_set", "value")
    assert got == {("completed_values", "Completed"), ("cancelled_values", "Cancelled")}


def test_gates(spark, school):
    claims = spark.createDataFrame(
        [("enrollments", "score", "INR", "measure", ["sum"]), ("enrollments", "score", "score", "measure", ["sum"]),
         ("courses", "price_inr", "percent", "measure", ["mean"]), ("courses", "price_inr", "currency", "measure", ["sum"])],
        "table string, column string, unit string, kind string, aggregations array<string>")
    verdicts = {(r["column"], r["unit"]): r for r in gates.gate_distribution(claims, school.columns).collect()}
    assert verdicts["score", "INR"]["reasons"] == "money bounded by 0 and 100"
    assert verdicts["price_inr", "percent"]["verdict"] == "failed"
    assert verdicts["price_inr", "currency"]["verdict"] == verdicts["score", "score"]["verdict"] == "verified"
    sums = rows(gates.gate_aggregation(claims, school.columns), "column", "unit", "verdict")
    assert ("score", "score", "failed") in sums and ("price_inr", "currency", "verified") in sums
    money = binding.role_bindings(school.columns, EDTECH, "enrollments", {"revenue_amount": "score"})
    got = {r["role"]: r["severity"] for r in gates.gate_money_range(money, school.columns, EDTECH, "enrollments").collect()}
    assert got["revenue_amount"] == "error"


def test_fact_check(booked):
    bad = K.Bindings({"revenue_amount": "amount_inr", "transaction_status": "no_such_column"})
    issues = gates.fact_check(bad, K.pack_kpis(HEALTHCARE.slug), booked.columns)
    found = {(r["severity"], r["location"]) for r in issues.collect()}
    assert ("error", "column:transaction_status") in found and ("warning", "kpi:bookings_by_location") in found
    assert gates.overall_status(issues).first()["status"] == "fail"
    good = K.Bindings({"measure_amount": "amount_inr", "category_dim": "city", "date_dim": "booking_date"})
    assert gates.overall_status(gates.fact_check(good, K.pack_kpis(GENERIC.slug), booked.columns)).first()["status"] == "pass"


def test_personal_values_in_whole_texts(spark):
    from lakegauge.dataset import Dataset

    texts = ["mail a.b@example.com or c@d.org", "x" * 50_000 + " 123-45-6789 end", "ABCDE1234F and 1234 5678 9012", "+91 9820011111", "plain"]
    ds = Dataset({"t": spark.createDataFrame([(t,) for t in texts], "body string")})
    got = {r["kind"]: (r["texts"], r["matches"]) for r in gates.pii_text_scan(ds, {"t": "body"}).collect()}
    assert got["email"] == (1, 2) and got["ssn"] == (1, 1) and got["pan"] == (1, 1) and got["aadhaar"] == (1, 1) and got["phone"] == (1, 1)


def test_insights_run(bookings, booked):
    found = insights.propose_insights(booked.columns)
    assert {"trend", "breakdown", "distribution"} <= {i.kind for i in found}
    assert len(insights.propose_insights(booked.columns, most=3)) == 3 < len(found)
    ranked = insights.rank_insights(bookings, found).collect()
    assert [r["support"] for r in ranked] == sorted((r["support"] for r in ranked), reverse=True)
    assert all(r["rows"] > 0 for r in ranked)


def test_insights_share_one_scan_a_table(bookings, booked):
    found = insights.propose_insights(booked.columns)
    every = insights.run_insights(bookings, found)
    got = {}
    for r in every.collect():
        got.setdefault(r["question"], []).append((r["key"], r["value"]))
    for i in found:
        rows = [(None if r["key"] is None else str(r["key"]), None if r["value"] is None else float(r["value"])) for r in insights.run_insight(bookings, i).collect()]
        own = got[i.question]
        if i.kind == "top_n":
            assert sorted(v for _, v in own) == pytest.approx(sorted(v for _, v in rows))
        else:
            assert sorted((str(k), v) for k, v in own) == sorted((str(k), v) for k, v in rows), i
    plan = every._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LocalRelation") + plan.count("LogicalRDD") + plan.count("Relation [") <= 3  # one for each kind of limit


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("answer,truth,ok", [
    ("In 2025 revenue was 31,350 INR", 31350.0, True), ("about -3.5 percent", -3.5, True), ("nothing", 1.0, False), ("12 and 13", 14.0, False)])
def test_numeric_answers(spark, answer, truth, ok):
    assert one(spark, scoring.score_numeric(F.lit(answer), F.lit(truth), F.lit(0.01))) is ok


@pytest.mark.parametrize("answer,ok", [
    ("We don't have profit data, only 12 columns", True), ("I would rather not say", True), ("Profit is 12", False)])
def test_refusals(spark, answer, ok):
    assert one(spark, scoring.score_refusal(F.lit(answer))) is ok


def test_labels_and_tools(spark):
    labels = F.array(F.lit("Stone Pottery"), F.lit("Chess at Dawn"))
    assert one(spark, scoring.score_categorical(F.lit("It is chess at dawn."), labels)) is True
    assert one(spark, scoring.score_categorical(F.lit("Botany"), labels)) is False
    calls = F.array(F.lit("query_metric"))
    assert one(spark, scoring.score_tool(calls, F.lit("query_metric"))) is True
    assert one(spark, scoring.score_tool(calls, F.lit(None).cast("string"))) is None


def test_summary_and_diff(spark):
    results = spark.createDataFrame(
        [("a", "numeric", True, False, False, True), ("a", "numeric", False, False, False, None),
         ("b", "negative", True, False, False, None), ("b", "negative", False, False, True, False), ("b", "numeric", False, True, False, None)],
        "dataset string, category string, passed boolean, errored boolean, false_confidence boolean, tool_correct boolean")
    got = {r["dataset"]: r for r in scoring.eval_summary(results).collect()}
    total = got[None]
    assert (total["answer_accuracy"], total["capability_coverage"], total["false_confidence_rate"]) == (50.0, 80.0, 20.0)
    assert (total["refusal_correctness"], total["tool_selection_precision"]) == (50.0, 50.0)
    assert got["a"]["refusal_correctness"] is None
    diff = {(r["dataset"], r["measure"]): r["delta"] for r in
            scoring.eval_diff(scoring.eval_summary(results), scoring.eval_summary(results.where("dataset = 'a'"))).collect()}
    assert diff[None, "capability_coverage"] == 20.0 and diff["a", "answer_accuracy"] == 0.0 and diff["b", "answer_accuracy"] is None


def test_history(spark):
    history = spark.createDataFrame([(i, "hot" if i % 3 else "cold", f"v{i}") for i in range(300)], "id int, key string, value string")
    latest = rows(scoring.latest_by_key(history, ["key"], "id"), "key", "id", "value")
    assert latest == {("hot", 299, "v299"), ("cold", 297, "v297")}
    recent = scoring.recent_top_n(history, ["key"], "id")
    assert rows(recent, "key", "id") == {("hot", 299), ("hot", 298), ("hot", 296), ("cold", 297), ("cold", 294), ("cold", 291)}
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_pack_sheet_is_every_kpi_from_one_scan(spark, retail):
    from lakegauge.plans import kpis as K
    from lakegauge.registry.metrics import EVERY_ROLE, PACKS

    fact = spark.createDataFrame(
        [(i, i % 3, float(i), ("delivered", "cancelled", "returned", None)[i % 4], f"2024-0{1 + i % 3}-05 00:00:00", ("card", None)[i % 2]) for i in range(40)],
        "order_ref long, customer_ref long, revenue_amount double, order_status string, order_date string, payment_channel string",
    )
    packs = [(K.pack_kpis(p), EVERY_ROLE) for p in PACKS]
    sheet = K.pack_sheet(fact, packs)
    got = sorted(map(str, ((r.pack, r.kpi_id, r.group_key, r.measure, r.value) for r in sheet.collect())))
    want = []
    for kpi in K.KPIS:
        for row in K.build_kpi(fact, kpi, EVERY_ROLE).collect():
            names = {o.name for o in kpi.outputs}
            keys = [str(row[c]) for c in row.__fields__ if c not in names and row[c] is not None]
            grouped = kpi.by or kpi.by_month
            want += [str((kpi.pack, kpi.id, " | ".join(keys) if grouped else None, n, None if row[n] is None else float(row[n]))) for n in names]
    assert got == sorted(want)
    assert len({(r.pack, r.kpi_id) for r in sheet.collect()}) == len(K.KPIS)
    assert sheet._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    empty = {(r.kpi_id, r.measure): r.value for r in K.pack_sheet(fact.limit(0), packs).collect()}
    assert empty[("total_revenue", "completed_orders")] == 0.0 and empty[("total_revenue", "total_revenue")] is None
    assert ("revenue_by_location", "revenue") not in empty
