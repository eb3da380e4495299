import time

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException, ParseException

from lakegauge.dataset import Dataset, constant_rows
from lakegauge.operators import explore, gates
from lakegauge.sources import database, files, sinks


@pytest.fixture(scope="module")
def guard(spark, tmp_path_factory, retail):
    folder = str(tmp_path_factory.mktemp("guard"))
    paths = sinks.redacted_export(retail, {}, folder)
    spark.range(3).write.mode("overwrite").option("path", folder + "/outside").saveAsTable("outside")
    yield explore.GuardedSql(
        spark, lambda s: Dataset({n: s.read.parquet(p) for n, p in paths.items()}),
        {"customers": ["full_name", "email_address"]}, max_rows=5)
    spark.sql("DROP TABLE IF EXISTS outside")


def test_guarded_select(guard):
    got = guard.query("SELECT city, count(*) AS n FROM customers GROUP BY city ORDER BY n DESC, city -- done").collect()
    assert tuple(got[0]) == ("Oslo", 3) and len(got) == 4
    assert guard.query("WITH x AS (SELECT order_id FROM orders) SELECT * FROM x").count() == 5
    assert "full_name" not in guard.query("SELECT c.* FROM customers c").columns


@pytest.mark.parametrize("sql", [
    "SELECT full_name FROM customers", "SELECT city FROM customers WHERE email_address LIKE 'a%'",
    "SELECT city FROM customers ORDER BY full_name", "SELECT count(*) FROM customers GROUP BY full_name",
    "SELECT city, max(full_name) FROM customers GROUP BY city HAVING max(full_name) > 'a'",
    "WITH x AS (SELECT full_name FROM customers) SELECT 1 FROM x"])
def test_guard_denied_columns(guard, sql):
    with pytest.raises(AnalysisException):
        guard.query(sql)


@pytest.mark.parametrize("sql", [
    "DROP TABLE orders", "DELETE FROM orders", "INSERT INTO orders SELECT * FROM orders", "CREATE TABLE x AS SELECT 1",
    "SELECT 1; SELECT 2", "SELECT city FROM customers) LIMIT 1000 --"])
def test_guard_refuses_other_statements(guard, sql):
    with pytest.raises(ParseException):
        guard.query(sql)


def test_guard_refuses_files_functions_and_other_tables(guard, tmp_path):
    with pytest.raises(explore.GuardError):
        guard.query(f"SELECT * FROM parquet.`{tmp_path}`")
    for sql in ("SELECT reflect('java.lang.Math', 'abs', -1)", "SELECT Java_Method('a', 'b')", "SELECT input_file_name() FROM orders"):
        with pytest.raises(explore.GuardError):
            guard.query(sql)
    with pytest.raises(explore.GuardError):
        guard.query("SELECT * FROM outside")
    with pytest.raises(explore.GuardError):
        guard.query("SELECT * FROM default.outside")
    for sql in ("SELECT * FROM global_temp.hidden", "SELECT 1 WHERE EXISTS (SELECT 1 FROM outside)",
                "WITH x AS (SELECT * FROM outside) SELECT * FROM x", "SELECT (SELECT max(reflect('a', 'b')) FROM orders)"):
        with pytest.raises(explore.GuardError):
            guard.query(sql)


def test_guard_keeps_the_wrapper_and_refuses_no_literal(guard):
    with pytest.raises(ParseException):
        guard.query("select city from customers) union all (select city from customers")
    got = guard.rows("SELECT 'please reflect' AS a, 'spark_catalog' AS b FROM orders ORDER BY order_id")
    assert len(got) == 5 and tuple(got[0]) == ("please reflect", "spark_catalog")
    assert guard.query("SELECT city FROM customers WHERE customer_id IN (SELECT customer_id FROM orders)").count() > 0


def test_time_limit(spark):
    slow = spark.range(10**13).agg(F.sum(F.sqrt("id")))
    start = time.time()
    with pytest.raises(TimeoutError):
        explore.rows_within(slow, seconds=1)
    assert time.time() - start < 60
    assert len(explore.rows_within(spark.range(500))) == 200


def test_adhoc_aggregate(edtech):
    assert explore.adhoc_aggregate(edtech, "enrollments", "score", "mean").first()["value"] == pytest.approx(72.78, abs=0.01)
    by = explore.adhoc_aggregate(edtech, "enrollments", "score", "max", "status", {"course_id": 201}).collect()
    assert [tuple(r) for r in by] == [("completed", 73.5), ("active", 61.0)]
    with pytest.raises(ValueError):
        explore.adhoc_aggregate(edtech, "enrollments", "score", "mean", "nope")
    with pytest.raises(ValueError):
        explore.adhoc_aggregate(edtech, "enrollments", "score", "mean", denied=("score",))


def test_sample_contains_is_literal(bookings):
    hit = explore.sample_contains(bookings, "bookings", ["booking_id", "package_name"], "IRON").collect()
    assert len(hit) == 5
    assert explore.sample_contains(bookings, "bookings", ["package_name"], "%").count() == 0
    with pytest.raises(explore.GuardError):
        explore.sample_contains(bookings, "bookings", ["phone"], personal=("phone",))


def test_value_set(edtech):
    got = explore.coverage_summary(edtech, "enrollments", "status", ["active", "finished", "completed"]).first()
    assert (got["matched"], got["absent"], got["real_values"], got["coverage_ratio"]) == (2, "finished", 3, 0.6667)
    assert gates.gate_value_set(explore.coverage_summary(edtech, "enrollments", "status", ["active", "finished"])).first()["verdict"] == "failed"
    partial = gates.gate_value_set(explore.coverage_summary(edtech, "enrollments", "status", ["active"])).first()
    assert (partial["verdict"], partial["warning"]) == ("verified", True)


def test_search_records(retail):
    got = explore.search_records(retail, "customers", {"city": "Turin"}, ("full_name", "email_address"), ["customer_id"])
    assert got.columns == ["customer_id", "signup_date", "city", "loyalty_tier"] and got.count() == 2
    with pytest.raises(explore.GuardError):
        explore.search_records(retail, "customers", {"full_name": "x"}, ("full_name",))


@pytest.mark.parametrize("fmt", ["csv", "tsv", "json", "parquet"])
def test_redacted_files_round_trip(spark, retail, tmp_path, fmt):
    paths = sinks.redacted_export(retail, {"customers": ["full_name", "email_address"]}, str(tmp_path), fmt)
    back = files.read_table(spark, paths["customers"])
    assert set(back.columns) == {"customer_id", "signup_date", "city", "loyalty_tier"}
    want = rows(retail.table("customers"), "customer_id", "city")
    assert rows(back, "customer_id", "city") == want
    assert set(files.load_dataset(spark, str(tmp_path)).names) == {"customers", "orders", "order_items"}


def test_text_with_quotes_and_line_breaks(spark, tmp_path):
    ds = Dataset({"t": spark.createDataFrame([(1, 'say "hi",\nthen go'), (2, None)], "id int, body string")})
    path = sinks.redacted_export(ds, {}, str(tmp_path), "csv")["t"]
    assert rows(files.read_table(spark, path, quoted_line_breaks=True), "id", "body") == {(1, 'say "hi",\nthen go'), (2, None)}


def test_json_array_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n {"x": 1},\n {"x": 2}\n]')
    (tmp_path / "b.json").write_text('{"x": 1}\n{"x": 2}\n{"x": 3}\n')
    (tmp_path / "2 c.jsonl").write_text('{"x": 9}\n')
    (tmp_path / "notes.txt").write_text("no table")
    ds = files.load_dataset(spark, str(tmp_path))
    assert rows(files.row_counts(ds), "table", "row_count") == {("a", 2), ("b", 3), ("t_2_c", 1)}


def test_empty_directory(spark, tmp_path):
    with pytest.raises(ValueError, match="no readable files"):
        files.load_dataset(spark, str(tmp_path))


def test_fingerprint_changes_with_the_source(spark, retail):
    first = files.source_fingerprint(retail).first()[0]
    assert len(first) == 16 and files.source_fingerprint(retail).first()[0] == first
    fewer = Dataset({**retail.tables, "orders": retail.table("orders").limit(19)})
    renamed = Dataset({**retail.tables, "orders": retail.table("orders").withColumnRenamed("order_id", "oid")})
    assert len({first, files.source_fingerprint(fewer).first()[0], files.source_fingerprint(renamed).first()[0]}) == 3


def test_label_of_a_database_is_cut_where_asked():
    label = "Quarterly figures of the north"
    assert sinks.schema_name("ab12", label) == "client_quarterly_figures_of_ab12"
    assert sinks.schema_name("ab12", label, 40) == "client_quarterly_figures_of_the_north_ab12"


def test_warehouse(spark, retail):
    name = sinks.warehouse_load(retail, "ab12", "My Upload.csv")
    assert name == "client_my_upload_csv_ab12" and spark.table(f"{name}.orders").count() == 20
    sinks.warehouse_drop(spark, "ab12", "My Upload.csv")
    assert not spark.catalog.databaseExists(name)
    for bad in ("AB", "a-b", "", "x" * 33):
        with pytest.raises(ValueError):
            sinks.schema_name(bad)


def test_normalised_rows(spark):
    df = spark.createDataFrame([(float("nan"), "a"), (1.5, None)], "x double, y string")
    assert {r["row"] for r in sinks.json_rows(df).collect()} == {'{"x":null,"y":"a"}', '{"x":1.5,"y":null}'}


def test_database_options(monkeypatch):
    monkeypatch.setenv("DB_SECRET", "s3")
    assert database.resolve_secrets("jdbc:postgresql://h/d?password=${DB_SECRET}").endswith("password=s3")
    with pytest.raises(ValueError):
        database.resolve_secrets("${NOT_SET_ANYWHERE}")
    assert database.schema_of("jdbc:postgresql://h/d") == "public"
    assert database.schema_of("jdbc:postgresql://h/d?currentSchema=sales") == "sales"
    assert database.schema_of("jdbc:postgresql://h/d?options=-c%20search_path%3Dclient_a") == "client_a"
    with pytest.raises(ValueError):
        database.schema_of("jdbc:postgresql://h/d?currentSchema=a'b")
    assert database.dialect_of("jdbc:sqlite:/x.db") == "sqlite"
    with pytest.raises(ValueError):
        database.dialect_of("jdbc:unknown:x")
    assert database.partition_options(1, 100, "id", 4)["numPartitions"] == "4"
    assert database.partition_options(None, None, "id", 4) == {}


def test_constant_rows_need_no_job(spark):
    df = constant_rows(spark, [(1, ["a"]), (2, [])], "x int, y array<string>")
    assert "LocalRelation" in df._jdf.queryExecution().optimizedPlan().toString()
    assert constant_rows(spark, [], "x int").count() == 0


@pytest.mark.parametrize("sql", [
    "select * from identifier('outside')", "select * from identifier('out' || 'side')",
    "select * from outside where exists (with outside as (select 1) select * from outside)",
    "select city from customers where 1 in (with outside as (select 1 as y) select y from outside) union all select cast(id as string) from outside",
    "select (select max(id) from outside)", "select * from customers, lateral (select id from outside)",
    "with recursive r as (select id from outside union all select id + 1 from r where id < 0) select * from r",
    "select * from (select id from outside) pivot (max(id) for id in (1))", "select transform(order_id) using 'cat' from orders",
    "select input_file_block_start() from orders", "select * from customers where city in (select id from outside)"])
def test_guard_sees_through_names_and_scopes(guard, sql):
    with pytest.raises((explore.GuardError, ParseException)):
        guard.query(sql)


@pytest.mark.parametrize("sql", [
    "select _metadata.file_path from orders", "select * from customers c where exists (select c.full_name)"])
def test_guard_hides_file_facts(guard, sql):
    with pytest.raises(AnalysisException):
        guard.query(sql)


@pytest.mark.parametrize("sql", [
    "with customers as (select order_id from orders) select * from customers",
    "with recursive r as (select 1 as n union all select n + 1 from r where n < 3) select * from r",
    "select * from (select city, order_id from customers c join orders o on c.customer_id = o.customer_id) pivot (count(order_id) for city in ('Oslo'))",
    "select distinct city from customers union select 'x' except select 'y' intersect select 'z'",
    "select city, row_number() over (partition by city order by customer_id) as n from customers",
    "select * from values (1), (2) t(a), range(2)", "select explode(array(1, 2)) as a from orders order by a limit 3 offset 1",
    "select city from customers tablesample (50 percent)", "select 1", "select max((select count(*) from orders)) from customers",
    "select * from identifier('orders')", "select * from orders o, lateral (select o.order_id + 1 as b)"])
def test_guard_lets_queries_on_views_through(guard, sql):
    assert guard.query(sql).count() <= 5


def test_time_limit_cancels_only_its_own_jobs(spark):
    from concurrent.futures import ThreadPoolExecutor

    slow = spark.range(0, 64, 1, 16).selectExpr("java_method('java.lang.Thread', 'sleep', 700L) as slept")
    begun = time.time()
    with ThreadPoolExecutor(2) as pool:
        first = pool.submit(explore.rows_within, slow, 0.6, 100)
        second = pool.submit(explore.rows_within, spark.range(100), 60, 7)
        assert len(second.result()) == 7
        with pytest.raises(TimeoutError):
            first.result()
    assert time.time() - begun < 20
    with explore.time_limit(spark, 60), pytest.raises(TimeoutError):
        explore.rows_within(slow, 0.5)
    assert spark.range(3).count() == 3 and not spark.sparkContext.getJobTags()


def test_answers_are_constants(spark, guard):
    got = guard.answer("SELECT city, count(*) AS n FROM customers GROUP BY city", seconds=60)
    assert got.count() == 4 and got.columns == ["city", "n"]
    assert guard.answer("SELECT city FROM customers WHERE 1 = 0").schema.simpleString() == "struct<city:string>"
