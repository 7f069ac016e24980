"""Tables as a graph, on the driver's smallest tables and by plan."""

import pytest

from loomspan.errors import TraversalIntoScalar
from loomspan.operators.tables import Table, TableGraph
from loomspan.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark):
    a = spark.createDataFrame([(1, 10, "x", 1.5), (2, 20, None, None), (3, None, "y", 0.5), (4, 99, "x", 2.5)], "id int, b int, name string, score double")
    b = spark.createDataFrame([(10, "p"), (20, "q")], "id int, name string")
    return TableGraph(Table("a", a, "id", {"to": ("b", "b")}), Table("b", b, "id"))


def keys(df):
    return [r["key"] for r in df.collect()]


def test_absent_and_dangling(small):
    assert keys(small.find("a").order_by("to.name").run()) == ["a/3", "a/4", "a/1", "a/2"] or keys(small.find("a").order_by("to.name").limit(9).run()) == ["a/3", "a/4", "a/1", "a/2"]
    assert keys(small.find("a").order_by("score", "desc").limit(4).run()) == ["a/4", "a/1", "a/3", "a/2"]
    assert sorted(keys(small.find("a").where_exists("to").run())) == ["a/1", "a/2", "a/4"]
    assert sorted(keys(small.find("a").where_exists("to.name").run())) == ["a/1", "a/2"]
    assert sorted(keys(small.find("a").where_ne("name", "x").run())) == ["a/3"]
    assert keys(small.find("a").where_eq("to.$id", "b/20").run()) == ["a/2"]
    assert keys(small.find("a").where_exists("none").run()) == []
    assert small.find("a").limit(0).run().isEmpty()
    with pytest.raises(TraversalIntoScalar):
        small.find("a").where_eq("name.x", 1).run()


def test_only_mentioned_links_are_joined_and_filters_reach_the_scan(spark):
    plan = catalogue.queries()["q_eq"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "EqualTo(p_size,10)" in plan
    plan = catalogue.queries()["q_and_path1"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") >= 1 and "GreaterThanOrEqual(c_acctbal" in plan


def test_registered_queries_have_sql():
    q, s = catalogue.queries(), catalogue.oracle_sql()
    assert set(s) == set(q)
