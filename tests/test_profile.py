import random
import time
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lakegauge.dataset import Dataset
from lakegauge.functions.numbers import rounded
from lakegauge.functions.percentiles import exact_percentiles
from lakegauge.operators import frequency, profile, quality, stored, temporal
from lakegauge.operators.profile import Profile, structural_columns


@pytest.fixture(scope="module")
def booked(bookings):
    return Profile(bookings)


def test_pii_flagged_by_name(booked):
    flagged = {r["column"] for r in booked.structural.where("is_pii").collect()}
    assert flagged == {"phone", "customer_name"}
    assert rows(profile.denied_columns(booked.structural), "table", F.array_join("denied", ",")) == {
        ("bookings", "customer_name,phone")}


def test_pii_can_be_switched_off(bookings):
    assert profile.structural_columns(bookings, pii=False).where("is_pii").count() == 0


def test_bookings_roles(booked):
    role = {r["column"]: r["guessed_role"] for r in booked.structural.collect()}
    assert role["booking_id"] == "identifier"
    assert role["report_delivery_date"] == "date"  # unique, but a date stays a date
    assert role["amount_inr"] == "numeric"
    assert role["status"] == "categorical"


def test_bookings_grain(booked):
    assert rows(booked.grains, "table", F.array_join("grain_columns", ","), "confidence") == {("bookings", "booking_id", 0.9)}


def test_edtech_profile(edtech):
    known = Profile(edtech)
    got = {(r["table"], r["column"]): r for r in known.columns.collect()}
    score = got["enrollments", "score"]
    assert (score["min_value"], score["max_value"], score["ambiguous"]) == (49.0, 95.0, True)
    assert (score["null_percent"], score["cardinality"]) == (10.0, 9)
    assert got["enrollments", "enrolled_on"]["guessed_role"] == "date"
    assert got["courses", "course_name"]["guessed_role"] == "categorical"
    assert got["students", "email"]["is_pii"]


def test_data_map_lists_no_personal_values(bookings):
    got = {r["column"]: r for r in Profile(bookings).data_map().collect()}
    assert got["phone"]["top_values"] is None
    assert [(t["value"], t["count"]) for t in got["city"]["top_values"]] == [("Oslo", 9), ("Turin", 8), ("Quito", 7)]
    assert got["amount_inr"]["p50"] == 1200.0  # 5 x 650, 5 x 800, 5 x 1200, 4 x 1900, 5 x 2500


def test_long_texts_are_counted_whole_and_shown_whole(spark):
    # equal for 600 characters, different after
    texts = ["x" * 600 + "a", "x" * 600 + "b", "x" * 600 + "a", "short"]
    ds = Dataset({"t": spark.createDataFrame([(t,) for t in texts], "body string")})
    freq = frequency.value_frequency(ds)
    stats = profile.column_stats(ds, freq).first()
    assert (stats["row_count"], stats["cardinality"]) == (4, 3)
    assert rows(profile.top_values(ds, freq), "value", "n") == set(Counter(texts).items())


def test_types_and_zeros(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (0.0D, true, date'2024-01-01', cast(1.50 as decimal(9,2)), array(1), cast(0.1 as float)), "
        "(-0.0D, false, date'2024-01-02', cast(2.25 as decimal(9,2)), array(2), cast(0.1 as float)) "
        "AS t(zero, flag, day, price, list, ratio)")
    ds = Dataset({"t": df})
    got = {r["column"]: r for r in profile.guess_role(profile.column_stats(ds, frequency.value_frequency(ds))).collect()}
    assert "list" not in got
    assert got["zero"]["cardinality"] == 1 and got["ratio"]["cardinality"] == 1
    assert (got["flag"]["guessed_role"], got["day"]["guessed_role"]) == ("boolean_flag", "date")
    assert (got["price"]["min_value"], got["price"]["max_value"]) == (1.5, 2.25)
    values = rows(frequency.named(frequency.value_frequency(ds), ds), "column", "value")
    assert {("flag", "true"), ("day", "2024-01-02"), ("price", "1.50"), ("ratio", "0.1")} <= values


def test_empty_table(spark):
    ds = Dataset({"t": spark.createDataFrame([], "a int, b string")})
    got = {r["column"]: r for r in Profile(ds).columns.collect()}
    assert got["a"]["null_percent"] == 0.0 and got["b"]["cardinality"] == 0
    assert not got["a"]["is_identifier"]


@pytest.mark.parametrize("text,is_date", [
    ("2024-01-05", True), ("2024-1-5", True), ("2024/01/05", True), ("2024-01-05 10:00:00", True),
    ("2024", False), ("2024-01", False), ("2024-13-01", False), ("9820011111", False), ("a-b", False),
    ("2024-01-01 foo", False), ("2024-01-01T", False), ("2024/01/01 10:00", True), ("2024-01/05", False), ("2024-01-01T10:00:00Z", True)])
def test_date_text(spark, text, is_date):
    from lakegauge.functions.text import is_date_text

    assert spark.range(1).select(is_date_text(F.lit(text))).first()[0] is is_date


@pytest.mark.parametrize("text,is_number", [
    ("13", True), (" 1.5e3 ", True), ("-.5", True), ("inf", True), ("1d", False), ("1f", False), ("kid", False), ("", False)])
def test_number_text(spark, text, is_number):
    from lakegauge.functions.text import is_number_text

    assert spark.range(1).select(is_number_text(F.lit(text))).first()[0] is is_number


def test_ratio_rounding(spark):
    assert spark.range(1).select(rounded(F.lit(9.0) / F.lit(60000.0), 4)).first()[0] == 0.0001


def _interpolated(values, p):
    values = sorted(values)
    at = (len(values) - 1) * p
    low, high = int(at), min(int(at) + 1, len(values) - 1)
    return values[low] + (values[high] - values[low]) * (at - low)


def test_exact_percentiles_against_sorting(spark):
    random.seed(3)
    data = {g: [round(random.gauss(0, 10), 3) for _ in range(n)] for g, n in (("a", 1), ("b", 2), ("c", 901), (None, 50))}
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs] + [("d", None)], "g string, v double")
    got = {(r["g"], r["point"]): r["value"] for r in exact_percentiles(df, ["g"], "v", [0.25, 0.5, 0.75]).collect()}
    assert set(g for g, _ in got) == set(data)
    for (g, p), value in got.items():
        assert value == pytest.approx(_interpolated(data[g], p))


def test_exact_percentiles_of_large_skewed_groups(spark, monkeypatch):
    # brackets in use: a third of all rows is one value
    from lakegauge.functions import percentiles as P

    monkeypatch.setattr(P, "ACCURACY", (1000, 1000))
    random.seed(5)
    values = [5.0] * 10_000 + [round(random.expovariate(0.1), 2) for _ in range(20_000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(6)
    got = {r["point"]: r["value"] for r in exact_percentiles(df, [], "v", [0.1, 0.25, 0.5, 0.9]).collect()}
    for p, value in got.items():
        assert value == pytest.approx(_interpolated(values, p))


def test_survey_findings(survey):
    known = Profile(survey)
    found = quality.quality_report(known.frequency, known.structural).collect()
    assert [f["id"] for f in found] == [
        "mixed_types:survey.band",
        "dominant_value:survey.site",
        "dominant_value:survey.verdict",
        "high_null:survey.mood",
        "inconsistent_format:survey.cut",
        "single_value:survey.mood",
        "single_value:survey.state_flag",
    ]
    by_id = {f["id"].split(".")[-1]: f for f in found}
    assert '"band" mixes text labels (low, mid) with numeric-looking values (7) - 30.0% look numeric.' == by_id["band"]["summary"]
    assert by_id["site"]["summary"].startswith("94.0% of 100 non-null rows")
    assert 'small/Small' in by_id["cut"]["summary"]
    assert [tuple(t) for t in by_id["verdict"]["top_values"]] == [
        ("open", 85, 85.0), ("yes", 10, 10.0), ("no", 5, 5.0)]
    again = quality.quality_report(known.frequency, known.structural).collect()
    assert again == found


def test_bookings_have_no_severe_finding(booked):
    found = quality.quality_report(booked.frequency, booked.structural)
    assert found.where("severity = 'high'").count() == 0


def test_temporal(booked, edtech):
    got = temporal.temporal_profile(booked.frequency, booked.structural).first()
    assert got["column"] == "report_delivery_date"  # equally full, more distinct days
    assert got["granularity"] == "month" or got["granularity"] == "day"
    known = Profile(edtech)
    spans = {r["table"]: r for r in temporal.temporal_profile(known.frequency, known.structural).collect()}
    assert str(spans["enrollments"]["min_value"])[:10] == "2024-02-03"
    assert spans["enrollments"]["distinct_n"] == 9


def test_temporal_gap_text(spark):
    days = [f"2024-{m:02d}-{d:02d}" for m in (1, 2, 5) for d in range(1, 29)]
    ds = Dataset({"t": spark.createDataFrame([(d,) for d in days], "day string").select(F.col("day").cast("date"))})
    known = Profile(ds)
    got = temporal.temporal_profile(known.frequency, known.structural).first()
    assert (got["granularity"], got["gaps"]) == ("day", "65 missing days in 149-day span")


def test_inspect_and_compare(bookings, booked):
    card = profile.inspect_column(bookings, booked.structural, "bookings", "city").first()
    assert card["sample_values"] == ["Oslo", "Quito", "Turin"]
    assert profile.inspect_column(bookings, booked.structural, "bookings", "phone").first()["sample_values"] == []
    with pytest.raises(ValueError, match="unknown column"):
        profile.inspect_column(bookings, booked.structural, "bookings", "nope")
    with pytest.raises(ValueError, match="denied"):
        profile.inspect_column(bookings, booked.structural, "bookings", "city", denied=("CITY",))
    assert profile.compare_columns(bookings, booked.structural, "bookings", ["age", "amount_inr"]).count() == 2


def test_approximate_stats(bookings):
    got = {r["column"]: r for r in profile.approximate_stats(bookings).collect()}
    assert got["city"]["cardinality"] == 3 and got["city"]["null_percent"] == 0.0


def test_samples_are_cut_before_the_shuffle(bookings):
    plan = profile.top_values(bookings, frequency.value_frequency(bookings))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_table_digests_tell_rows_apart_but_not_their_order(spark):
    def digest(rows):
        table = spark.createDataFrame(rows, "id int, name string, score double, tags array<string>")
        return stored.table_digests(Dataset({"t": table})).first().digest

    rows = [(1, "a", 0.5, ["x"]), (2, None, 1.5, None), (2, None, 1.5, None), (None, "", None, [])]
    assert digest(rows) == digest(rows[::-1]) != digest(rows[:3])
    changed = [rows[:2] + rows[3:], [(1, "a", 0.5, None), (2, "-", 1.5, None), *rows[2:]], [(1, "", 0.5, None), *rows[1:]]]
    assert len({digest(rows), *map(digest, changed)}) == 4
    assert digest([]) == "0"


def test_only_changed_tables_are_profiled_again(spark, tmp_path, monkeypatch):
    profiled = []

    def spied(ds, **options):
        profiled.append(list(ds.names))
        return structural_columns(ds, **options)

    monkeypatch.setattr(stored, "structural_columns", spied)
    store = stored.ProfileStore(spark, str(tmp_path / "profiles"))
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "id int, name string"), spark.createDataFrame([(1,), (1,)], "n int")
    first = store.columns(Dataset({"a": a, "b": b}))
    want = structural_columns(Dataset({"a": a, "b": b})).drop("column_id")
    assert sorted(map(str, first.select(want.columns).collect())) == sorted(map(str, want.collect()))
    again = store.columns(Dataset({"b": b, "a": a.orderBy(F.desc("id"))}))
    assert profiled == [["a", "b"]] and again.count() == 3
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "profiles" / "a").rglob("*.parquet")}
    more = store.columns(Dataset({"a": a, "b": b.union(b)}))
    assert profiled == [["a", "b"], ["b"]] and more.where("table = 'b'").first().row_count == 4
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "profiles" / "a").rglob("*.parquet")} == files
    assert len(list((tmp_path / "profiles" / "b").iterdir())) == 1
    half = next((tmp_path / "profiles" / "b").iterdir()) / "_SUCCESS"
    half.unlink()
    assert store.columns(Dataset({"a": a, "b": b.union(b)})).count() == 3 and profiled[-1] == ["b"] and half.exists()


def test_large_columnar_tables_are_counted_in_scans_of_some_columns(spark, tmp_path, monkeypatch):
    made = spark.range(600).selectExpr("id", "id % 7 as few", "'t' || id as name", "if(id % 3 = 0, null, id / 4) as part")
    made.repartition(1).write.parquet(str(tmp_path / "p"))
    made.write.csv(str(tmp_path / "c"), header=True)
    columnar = Dataset({"t": spark.read.parquet(str(tmp_path / "p")).withColumn("more", F.col("id") * 2)})
    lines = Dataset({"t": spark.read.csv(str(tmp_path / "c"), header=True)})
    scans = lambda ds: frequency.value_frequency(ds)._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    once = rows(frequency.value_frequency(columnar), "column_id", "value", "number", "n")
    assert scans(columnar) == scans(lines) == 1
    monkeypatch.setattr(frequency, "SCAN_BYTES", 1)
    assert scans(columnar) == 5 and scans(lines) == 1  # text lines are read once at any size
    assert rows(frequency.value_frequency(columnar), "column_id", "value", "number", "n") == once


def test_rows_of_one_row_group_are_counted_by_many_tasks(spark, tmp_path, monkeypatch):
    made = spark.range(3000).selectExpr("id", "'same' as word", "if(id % 3 = 0, null, id / 4) as `a part`", "array(id) as list")
    made.union(made.where("id < 500")).coalesce(1).write.parquet(str(tmp_path / "p"))
    table = spark.read.parquet(str(tmp_path / "p"))
    # rows that come from a shuffle have no fixed place, and are not dealt out
    ds = Dataset({"t": table, "u": table.select("id", "word").distinct(), "empty": table.where("id < 0")})
    once = rows(frequency.value_frequency(ds), "column_id", "value", "number", "n")
    assert ("word", "same", 3500) in rows(frequency.named(frequency.value_frequency(ds), ds).where("table = 't'"), "column", "value", "n")
    monkeypatch.setattr(frequency, "DEAL_FROM", 0)
    monkeypatch.setattr(frequency, "DEAL_BYTES", 1024)
    cells = frequency.stacked(ds.only(["t"]), lambda c: True, frequency._slots, ("whole", "real", "text"), apart=True)
    by_task = [r["count"] for r in cells.groupBy(F.spark_partition_id()).count().collect()]
    assert len(by_task) > 9 and max(by_task) < sum(by_task) / 4 and sum(by_task) == 3 * 3500  # one value's rows too
    dealt = frequency.value_frequency(ds)
    assert dealt._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 2
    assert rows(dealt, "column_id", "value", "number", "n") == once


def test_the_frequency_table_is_written_in_parts_that_give_their_shuffles_back(spark, tmp_path, monkeypatch):
    made = spark.range(3000).selectExpr("id", "if(id % 2 = 0, null, 'w' || id % 9) as word", "id / 4 as part", "cast(null as string) as none")
    made.union(made.where("id < 500")).coalesce(1).write.parquet(str(tmp_path / "p"))
    table = spark.read.parquet(str(tmp_path / "p"))
    ds = Dataset({"t": table, "u": table.select("id", "word").distinct(), "empty": table.where("id < 0"), "held": spark.createDataFrame([(1, None)], "a int, b string")})
    monkeypatch.setattr(frequency, "DEAL_FROM", 0)
    assert len(frequency.frequency_parts(ds)) == 1  # small tables need one job
    monkeypatch.setattr(frequency, "SCAN_BYTES", 1)
    parts = frequency.frequency_parts(ds)
    ids = [{r[0] for r in part.select("column_id").distinct().collect()} for part in parts]
    assert len(parts) > 4 and sum(map(len, ids)) == len(set().union(*ids)) == 8
    once = sorted(frequency.value_frequency(ds).collect(), key=str)
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    on_disk = lambda: {f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllFiles()) if f.getName().startswith("shuffle_")}
    before = on_disk()
    known = Profile(ds)
    assert sorted(known.frequency.collect(), key=str) == once
    until = time.time() + 20
    while on_disk() - before and time.time() < until:  # files go in the background
        time.sleep(0.2)
    assert not on_disk() - before
