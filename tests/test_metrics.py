import statistics

import pytest
from pyspark.sql import functions as F

from lakegauge.dataset import Dataset
from lakegauge.operators import graph
from lakegauge.operators.profile import Profile
from lakegauge.plans import kpis as K
from lakegauge.plans import metrics as M
from lakegauge.plans.metrics import Dimension, FilterSpec, JoinEdge, Metric, MetricError, build_metric

AMOUNT = Metric("total", "bookings", "amount_inr", "sum",
                dimensions=(Dimension("bookings", "city"), Dimension("bookings", "status")), time_column="booking_date")
TO_COURSE = JoinEdge("enrollments", "course_id", "courses", "course_id")


def test_total_and_default_filter(bookings):
    assert build_metric(bookings, AMOUNT).first()["value"] == 33350  # 5 x (1200 + 2500 + 800 + 650) + 4 x 1900
    done = M.value_set_filter(AMOUNT, ("Completed",))
    assert done.default_filters[0].column == "status"
    assert build_metric(bookings, done).first()["value"] == 31350  # without visits 5 and 17: 1200 and 800
    by_city = build_metric(bookings, done, group_by="city").collect()
    assert by_city[0]["grp"] == "Oslo" and by_city[0]["value"] == 12900 and [r["value"] for r in by_city] == sorted((r["value"] for r in by_city), reverse=True)


def test_months(bookings, edtech):
    months = {str(r["time_bucket"])[:7]: r["value"] for r in
              build_metric(bookings, M.value_set_filter(AMOUNT, ("Completed",)), time_grain="month").collect()}
    assert months["2025-05"] == 10800  # visits 8 to 15
    scores = Metric("s", "enrollments", "score", "mean", time_column="enrolled_on")
    assert build_metric(edtech, scores, time_grain="month").count() == 3


def test_refusals(bookings):
    with pytest.raises(MetricError, match="dimension"):
        build_metric(bookings, AMOUNT, group_by="phone")
    with pytest.raises(MetricError, match="grain"):
        build_metric(bookings, AMOUNT, time_grain="hour")
    with pytest.raises(MetricError, match="filter"):
        build_metric(bookings, AMOUNT, filters={"phone": 1})
    with pytest.raises(MetricError):
        FilterSpec("city", "like", ("x",))
    with pytest.raises(MetricError):
        FilterSpec("city", "eq", ("a", "b"))
    with pytest.raises(MetricError):
        Metric("m", "bookings", "amount_inr", "product")


def test_filter_values_are_never_sql(bookings):
    hostile = "Oslo' OR '1'='1"
    assert build_metric(bookings, AMOUNT, filters={"city": hostile}).first()["value"] is None


def test_all_aggregations(edtech):
    scores = [61.0, 73.5, 58.25, 90.0, 66.75, 84.5, 49.0, 77.0, 95.0]
    want = {"sum": sum(scores), "mean": statistics.mean(scores), "min": 49.0, "max": 95.0, "count": 9, "nunique": 9,
            "median": 73.5, "std": statistics.stdev(scores), "var": statistics.variance(scores)}
    for op, value in want.items():
        got = build_metric(edtech, Metric(op, "enrollments", "score", op)).first()["value"]
        assert got == pytest.approx(value, abs=1e-3), op
    sheet = M.metric_sheet(edtech, [Metric(op, "enrollments", "score", op) for op in want])
    assert {r["metric_id"]: pytest.approx(r["value"], abs=1e-3) for r in sheet.collect()} == want


def test_median_keeps_all_null_groups(spark):
    ds = Dataset({"t": spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None)], "g string, v double")})
    got = build_metric(ds, Metric("m", "t", "v", "median", dimensions=(Dimension("t", "g"),)), group_by="g")
    assert [tuple(r) for r in got.collect()] == [("a", 1.5), ("b", None)]


def test_measure_on_a_dimension(edtech):
    price = Metric("p", "enrollments", "price_inr", "sum", measure_table="courses", measure_path=(TO_COURSE,),
                   dimensions=(Dimension("courses", "course_name", (TO_COURSE,)),))
    got = {r["grp"]: r["value"] for r in build_metric(edtech, price, group_by="course_name").collect()}
    assert got["Pottery"] == 3 * 310.0 and sum(got.values()) == 930.0 + 1260.0 + 300.0 + 1120.0


@pytest.mark.parametrize("op", ["sum", "count", "min", "max", "mean", "nunique", "std", "var"])
@pytest.mark.parametrize("filters", [None, {"name": "n1"}, {"kind": "k1"}])
def test_aggregating_before_a_shuffled_join_changes_nothing(spark, op, filters):
    # one foreign key holds a third of the facts; some facts have no parent
    fact = spark.range(900).selectExpr(
        "case when id % 3 = 0 then 1 else id % 50 end as fk", "if(id % 11 = 0 or id % 50 = 7, null, 1e6 + cast(id % 17 as double)) as v",
        "concat('k', id % 2) as kind", "timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id % 90 as int)) as at")
    dim = spark.range(40).selectExpr("id as pk", "concat('n', id % 4) as name")
    ds = Dataset({"fact": fact, "dim": dim})
    path = (JoinEdge("fact", "fk", "dim", "pk"),)
    metric = Metric("m", "fact", "v", op, dimensions=(Dimension("dim", "name", path), Dimension("fact", "kind")), time_column="at")

    def ask():
        df = build_metric(ds, metric, group_by="name", time_grain="month", filters=filters)
        return df, [tuple(r) for r in df.collect()]

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    _, plain = ask()
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        df, early = ask()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(early) == len(plain) > 0
    assert sorted(map(str, (r[:-1] for r in early))) == sorted(map(str, (r[:-1] for r in plain)))
    for a, b in zip(sorted(early, key=str), sorted(plain, key=str)):
        assert a == b if op not in ("std", "var") else a[-1] == pytest.approx(b[-1], rel=1e-9)
    # the facts are summed up below the join with the dimension
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.split("\n")
    scans = [i for i, line in enumerate(lines) if "Range (0, 900" in line]
    assert scans and all("Aggregate" in "".join(lines[i - 4 : i]) for i in scans)


@pytest.mark.parametrize("op", ["std", "var"])
def test_merged_moments_of_distant_values(spark, op):
    rows = spark.createDataFrame([("a", 3, 1e9, 2.0), ("a", 1, 1e9 + 4, 0.0), ("b", 1, 5.0, 0.0), ("c", 0, None, None), (None, 2, 1.0, 8.0)], "k string, n long, mean double, square double")
    from lakegauge.plans.metrics import _merged_moments

    got = {r["k"]: r["value"] for r in _merged_moments(rows, ["k"], op).collect()}
    want = {"a": (2.0 + 12.0) / 3, "b": None, "c": None, None: 8.0}
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == (v if v is None else pytest.approx(v if op == "var" else v**0.5, rel=1e-12))


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(10).selectExpr("id", "id % 3 as g", "'x' as wide").write.parquet(path)
    ds = Dataset({"t": spark.read.parquet(path)})
    metric = Metric("m", "t", "id", "sum", dimensions=(Dimension("t", "g"),))
    plan = build_metric(ds, metric, filters={"g": 1})._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(g,1)" in plan and "wide" not in plan.split("ReadSchema")[1]


def test_catalogue_grants_sums_only_by_claim(spark, edtech):
    known = Profile(edtech)
    paths = graph.join_paths(known.edges, "enrollments", max_hops=M.MAX_HOPS)
    dims = {r["field_id"] for r in M.dimension_candidates(known.columns, paths).collect()}
    assert {"enrollments.status", "courses.course_name", "courses.subject"} <= dims
    assert not any("email" in d or "full_name" in d for d in dims)
    plain = {r["metric_id"]: r for r in M.metric_catalog(known.columns, paths, "enrollments", "enrollment_id").collect()}
    assert "median_score" in plain and "total_score" not in plain and "count_enrollments" in plain
    claims = spark.createDataFrame([("enrollments", "score", "measure", True, 0.9), ("enrollments", "course_id", "identifier", False, 0.9)],
                                   "table string, column string, kind string, sums boolean, confidence double")
    stated = {r["metric_id"]: r for r in M.metric_catalog(known.columns, paths, "enrollments", "enrollment_id", claims).collect()}
    assert stated["total_score"]["confidence"] == 0.6 and "status" in stated["total_score"]["caveat"]
    assert "average_course_id" not in stated and "average_course_id" in plain


HEALTH = K.Bindings(
    {"revenue_amount": "amount_inr", "transaction_status": "status", "transaction_date": "booking_date",
     "repeat_flag": "is_repeat_customer", "customer_ref": "customer_id", "location": "city",
     "partner_name": "lab_partner", "product_name": "package_name"},
    {"completed_values": ("Completed",), "cancelled_values": ("Cancelled",), "repeat_values": ("Yes",)})


def kpi(df, pack, name, bindings):
    return K.build_kpi(df, K.find_kpi(pack, name), bindings)


def test_booking_kpis(bookings):
    fact, pack = bookings.table("bookings"), "healthcare-diagnostics"
    assert kpi(fact, pack, "total_revenue", HEALTH).first()["total_revenue"] == 31350
    assert kpi(fact, pack, "cancellation_rate", HEALTH).first()["cancellation_percent"] == pytest.approx(8.33, abs=0.01)  # 2 of 24
    assert kpi(fact, pack, "repeat_customer_rate", HEALTH).first()["repeat_percent"] == pytest.approx(45.83, abs=0.01)  # visits 13 to 23
    assert kpi(fact, pack, "number_of_repeat_customers", HEALTH).first()["repeat_customers"] == 11
    assert kpi(fact, pack, "bookings_by_location", HEALTH).first()["location"] == "Oslo"
    months = {r["month"]: r["revenue"] for r in kpi(fact, pack, "monthly_revenue_trend", HEALTH).collect()}
    assert months["2025-05"] == 10800
    assert K.kpi_dry_run(fact, K.pack_kpis(pack), HEALTH).count() == 0
    assert K.kpi_assertions(fact, K.pack_kpis(pack), HEALTH).where("not passed").count() == 0


def test_retail_and_edtech_kpis(retail, edtech):
    shop = K.Bindings({"revenue_amount": "order_total", "transaction_status": "order_status", "location": "shipping_city"},
                      {"completed_values": ("delivered",), "cancelled_values": ("cancelled",), "returned_values": ("returned",)})
    orders, pack = retail.table("orders"), "retail-ecommerce"
    assert kpi(orders, pack, "total_revenue", shop).first()["total_revenue"] == 3728.0  # 4690 less 441 cancelled and 521 returned
    assert kpi(orders, pack, "average_order_value", shop).first()["average_order_value"] == 233.0
    assert kpi(orders, pack, "cancellation_rate", shop).first()["cancellation_percent"] == 10.0
    assert kpi(orders, pack, "return_rate", shop).first()["return_percent"] == 10.0
    assert kpi(orders, pack, "revenue_by_location", shop).first()["location"] == "Oslo"
    with pytest.raises(K.MissingRoles):
        kpi(orders, pack, "orders_by_payment_channel", shop)
    school = K.Bindings({"score": "score", "transaction_status": "status", "transaction_date": "enrolled_on"},
                        {"cancelled_values": ("dropped",)})
    enrolled = edtech.table("enrollments")
    assert kpi(enrolled, "edtech", "average_score", school).first().asDict() == {"average_score": 72.78, "scored_enrollments": 9}
    assert kpi(enrolled, "edtech", "dropout_rate", school).first()["dropout_percent"] == 10.0
    # an unbound value set matches nothing
    assert kpi(enrolled, "edtech", "completion_rate", school).first()["completion_percent"] == 0.0
    months = {r["month"]: r["enrollment_count"] for r in kpi(enrolled, "edtech", "monthly_enrollment_trend", school).collect()}
    assert months["2024-03"] == 5


def test_ungrouped_kpis_share_one_scan(bookings):
    scalar = tuple(k for k in K.pack_kpis("healthcare-diagnostics") if not k.by and not k.by_month)
    sheet = K.kpi_sheet(bookings.table("bookings"), scalar, HEALTH)
    plan = sheet._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and plan.count("LocalRelation") == 1  # the facts, and the names of the KPIs


def test_assertions_are_a_closed_set(spark):
    cols = {"x": F.col("x"), "name": F.col("name")}
    df = spark.createDataFrame([(5.0, "abc")], "x double, name string")

    def holds(check):
        return df.select(K.check_column(check, cols)).first()[0]

    assert holds(("and", (">=", "x", 0), ("<", ("abs", ("-", 0, "x")), 6)))
    assert holds(("not", ("==", ("%", "x", 2), 0))) and holds(("==", ("len", "name"), 3))
    assert holds(("==", ("max", "x", 9), 9)) and holds(("==", ("**", "x", 2), 25)) and holds(("==", "name", ("text", "abc")))
    assert K.check_text(("<=", "x", 100)) == "x <= 100"
    with pytest.raises(K.CheckError):
        K.check_column((">", "missing", 0), cols)
    with pytest.raises(K.CheckError):
        K.check_column(("reflect", "x"), cols)
