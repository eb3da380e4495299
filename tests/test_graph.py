import fixtures
import pytest
from conftest import rows
from pyspark.sql import functions as F

from lakegauge.dataset import Dataset
from lakegauge.operators import grain, graph, relations
from lakegauge.operators.profile import Profile


@pytest.fixture(scope="module")
def shop(retail):
    return Profile(retail)


@pytest.fixture(scope="module")
def school(edtech):
    return Profile(edtech)


def test_retail_joins(shop):
    found = rows(shop.edges, "from_table", "from_column", "to_table", "to_column")
    assert {("orders", "customer_id", "customers", "customer_id"), ("order_items", "order_id", "orders", "order_id")} <= found
    assert rows(shop.grains.where("table = 'customers'"), F.array_join("grain_columns", ",")) == {("customer_id",)}


def test_retail_fact_and_reach(shop):
    roles = {r["table"]: r["role"] for r in shop.entities.collect()}
    assert roles["orders"] == "fact"
    reached = graph.join_paths(shop.edges, "orders")
    assert {r["table"] for r in reached.collect()} == {"orders", "customers", "order_items"}


def test_retail_fan_out(shop):
    safe = {r["table"]: r["safe"] for r in graph.safe_to_aggregate(graph.join_paths(shop.edges, "orders")).collect()}
    assert safe["customers"] is True and safe["order_items"] is False
    back = {r["table"]: r["safe"] for r in graph.safe_to_aggregate(graph.join_paths(shop.edges, "order_items")).collect()}
    assert back["orders"] is True


def test_edtech_graph(school):
    roles = {r["table"]: r["role"] for r in school.entities.collect()}
    assert roles == {"enrollments": "fact", "courses": "dimension", "students": "dimension"}
    edge = school.edges.where("from_table = 'enrollments' and to_table = 'courses' and from_column = 'course_id'").first()
    assert (edge["cardinality"], edge["fan_out_risk"], edge["origin"], edge["confidence"]) == ("N:1", False, "declared", 1.0)


def test_declared_edges_replace_inferred_ones(school):
    of_column = school.edges.where("from_table = 'enrollments' and from_column = 'student_id'")
    assert {r["origin"] for r in of_column.collect()} == {"declared"}


def test_bridge(spark):
    known = Profile(fixtures.bridge(spark))
    grains = {r["table"]: (r["grain_columns"], r["confidence"]) for r in known.grains.collect()}
    assert grains["loans"] == (["reader_id", "book_id"], 0.85)
    roles = {r["table"]: r["role"] for r in known.entities.collect()}
    assert roles["loans"] == "bridge"
    out = known.edges.where("from_table = 'loans'").collect()
    assert len(out) == 2 and all(e["cardinality"] == "N:N" and e["fan_out_risk"] for e in out)


def test_nullable_composite_is_no_key(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, None)], "a int, b int")
    assert grain.composite_key(df, {"a": 2, "b": 2}, 4) is None


def test_composite_search(spark):
    df = spark.range(1000).selectExpr("id div 10 as a", "id % 10 as b", "id % 7 as c", "id div 200 as d")
    cards = {"a": 100, "b": 10, "c": 7, "d": 5}
    assert grain.composite_key(df, cards, 1000) == ("a", "b")
    assert grain.composite_key(df.unionAll(df.limit(1)), cards, 1001) is None


def test_key_of_four_columns(spark):
    df = spark.range(1296).selectExpr("id % 6 as a", "id div 6 % 6 as b", "id div 36 % 6 as c", "id div 216 as d", "id % 5 as e")
    cards = {"a": 6, "b": 6, "c": 6, "d": 6, "e": 5}
    assert grain.composite_key(df, cards, 1296) is None
    assert grain.composite_key(df, cards, 1296, widest=4) == ("a", "b", "c", "d")


@pytest.mark.parametrize("slice_keys", [1, 40, 10**6])
def test_keys_of_several_tables_by_slices(spark, slice_keys):
    wide = spark.range(1296).selectExpr("id % 6 as a", "id div 6 % 6 as b", "id div 36 % 6 as c", "id div 216 as d", "id % 5 as e")
    pairs = spark.range(2000).selectExpr("id div 40 as x", "id % 40 as y", "'t' || (id % 7) as `o d`", "if(id = 5, null, id % 1999) as z")
    rare = pairs.union(pairs.where("x = 49 and y = 39"))  # one repeat among 2001 rows
    cards = {"x": 50, "y": 40, "o d": 7}
    tables = [
        grain.Candidates("wide", 1296, {"a": 6, "b": 6, "c": 6, "d": 6, "e": 5}), grain.Candidates("pairs", 2000, cards),
        grain.Candidates("rare", 2001, cards), grain.Candidates("nulls", 2000, {"x": 50, "z": 1998}, frozenset({"z"})),
        grain.Candidates("seen", 2000, {"x": 50, "z": 1998}),
    ]
    ds = Dataset({"wide": wide, "pairs": pairs, "rare": rare, "nulls": pairs, "seen": pairs})
    found = grain.search_keys(ds, tables, widest=4, slice_keys=slice_keys)
    assert found == {"wide": ("a", "b", "c", "d"), "pairs": ("x", "y")}
    assert grain.search_keys(ds, [], slice_keys=slice_keys) == {}


def test_slice_scan_reads_only_candidates_and_makes_few_texts(spark, tmp_path):
    spark.range(1000).selectExpr("id div 10 as a", "id % 10 as b", "id as unused").write.parquet(str(tmp_path / "t"))
    ds = Dataset({"t": spark.read.parquet(str(tmp_path / "t"))})
    one = grain.Candidates("t", 1000, {"a": 100, "b": 10})
    keys = grain._keys(ds, [(one, ("a", "b"))], {"t": 64})
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert "unused" not in plan.split("ReadSchema")[1] and "Exchange" not in plan
    assert 0 < keys.count() < 100


def test_key_hashes_cross_the_network_and_few_keys_are_tested_whole(spark, monkeypatch):
    """Of three unique pairs one is looked at over all keys; hashes that collide refute nothing."""
    df = spark.range(5000).selectExpr("id div 50 as a", "id % 50 as b", "id % 50 + 100 as c", "id % 50 + 200 as d")
    cards = {"a": 100, "b": 50, "c": 50, "d": 50}
    seen, keys = [], grain._keys
    monkeypatch.setattr(grain, "_keys", lambda ds, asked, slices=None: seen.append((len(asked), slices)) or keys(ds, asked, slices))
    monkeypatch.setattr(grain, "GROWTH", 4)
    assert grain.composite_key(df, cards, 5000, slice_keys=500) == ("a", "b")
    assert [n for n, slices in seen if not slices] == [1]
    plan = keys(Dataset({"t": df}), [(grain.Candidates("t", 5000, cards), ("a", "b"))]).groupBy("combo", "h").count()
    assert "key#" not in plan._jdf.queryExecution().optimizedPlan().toString().split("Project")[0]
    monkeypatch.setattr(grain, "_keys", lambda *asked: keys(*asked).withColumn("h", F.lit(1)))
    assert grain.composite_key(df, cards, 5000, slice_keys=500) == ("a", "b")
    assert grain.composite_key(df.union(df.limit(1)), cards, 5001, slice_keys=500) is None


def test_all_keys_of_a_large_table_are_tested_a_slice_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(grain, "PASS_FROM", 2000)
    df = spark.range(3000).selectExpr("id div 50 as a", "id % 50 as b", "if(id = 17, null, id % 50) as c")
    cards = {"a": 60, "b": 50, "c": 50}
    tables = {"clean": df, "small": df.where("a < 20"), "null": df, **{f"twice{i}": df.union(df.where(f"a = {i} and b = {i}")) for i in range(8)}}
    ds = Dataset(tables)
    rows = {t: 1000 if t == "small" else 3000 if t in ("clean", "null") else 3001 for t in tables}
    asked = [(grain.Candidates(t, rows[t], cards), ("a", "c" if t == "null" else "b")) for t in tables]
    looked, repeated = [], grain._repeated

    def spied(ds, asked, slices=None):
        keys = grain._keys(ds, asked, slices)
        looked.append(({c.table: keys.where(f"combo = {i}").count() for i, (c, _) in enumerate(asked)}))
        return repeated(ds, asked, slices)

    monkeypatch.setattr(grain, "_repeated", spied)
    assert {c.table for c, _ in grain._left(ds, asked)} == {"clean", "small"}
    assert len(looked) == grain.PASSES and looked[0]["small"] == 1000 and "small" not in looked[1]
    seen = [p["clean"] for p in looked]
    assert sum(seen) == 3000 and max(seen) < 1500  # each key in one pass
    assert any(f"twice{i}" not in looked[-1] for i in range(8))  # what one pass refutes is not looked at again
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_composite_of_two_texts_compares_joined_texts(spark):
    # joined by pipes both rows read a|b|c
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("a", "c")], "x string, y string")
    assert grain.composite_key(df, {"x": 2, "y": 2}, 3) is None


def test_near_unique_and_full_row(spark):
    near = Dataset({"t": spark.range(1000).selectExpr("cast(greatest(id, 1) as string) as code", "cast(greatest(id, 1) % 2 as string) as side")})
    got = Profile(near).grains.first()
    assert got["grain_columns"] == ["code"] and got["confidence"] == 0.6
    plain = Dataset({"t": spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "x int, y string")})
    got = Profile(plain).grains.first()
    assert got["grain_columns"] == ["x", "y"] and got["confidence"] == 0.3


def test_overlap_with_a_hot_value(spark):
    # a third of the child rows share one value, and another third is null
    child = spark.range(3000).selectExpr("id as row_id", "case when id % 3 = 0 then 1 when id % 3 = 1 then null else id end as parent_id")
    parent = spark.range(2000).selectExpr("id as parent_id", "cast(id as string) as label")
    ds = Dataset({"child": child, "parent": parent})
    found = relations.check_relationship(ds, "child", "parent_id", "parent", "parent_id").first()
    # distinct: 1 and 1000 values id % 3 = 2, of which those below 2000 exist
    assert found["overlap_ratio"] == round((1 + 666) / 1001, 4)
    assert found["orphan_ratio"] == round((1000 - 666) / 2000, 4)
    known = Profile(ds)
    edge = relations.infer_relationships(known.frequency, known.structural).where(
        "from_column = 'parent_id' and to_column = 'parent_id'").first()
    assert edge["orphan_ratio"] == found["orphan_ratio"] and edge["cardinality"] == "N:1"


@pytest.mark.parametrize("a,b,score", [
    ("customer_id", "customer_id", 1.0), ("customer_id", "customer", 0.6), ("student_id", "id", 0.6),
    ("order_total", "order_status", 1 / 3), ("abc", "xyz", 0.0)])
def test_name_similarity(spark, a, b, score):
    from lakegauge.functions.text import name_similarity

    assert spark.range(1).select(name_similarity(F.lit(a), F.lit(b))).first()[0] == pytest.approx(score)


def test_check_relationship_refuses_unknown_columns(retail):
    with pytest.raises(ValueError):
        relations.check_relationship(retail, "orders", "nope", "customers", "customer_id")


def test_value_index_multiplies_no_rows(spark):
    """Forty parents hold each value; a child row meets one posting, not forty rows."""
    parents = {f"p{i:02}": spark.range(200).withColumnRenamed("id", f"p{i:02}_id") for i in range(40)}
    child = spark.range(300).selectExpr("id as c_id", "id % 100 as p00_id", "id + 1000 as far")
    known = Profile(Dataset({**parents, "c": child}))
    pairs = relations.candidate_pairs(known.structural)
    facts = relations.edge_facts(known.frequency, pairs)
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" in plan and plan.index("explode") < plan.index("array_intersect")  # taken apart above the counting
    got = {(r.from_table, r.from_column, r.to_table): (r.overlap_ratio, r.cardinality, r.orphan_ratio) for r in facts.collect()}
    assert got[("c", "p00_id", "p00")] == (1.0, "N:1", 0.0)
    assert all(v[0] == 0.0 and v[2] == 1.0 for k, v in got.items() if k[1] == "far")
