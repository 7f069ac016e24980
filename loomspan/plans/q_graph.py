"""Queries over tables as a graph: filters, paths, order, pages, points, maps, lexical scans, materialisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.plans.data import read, tables, world

_CUSTOMER = {"name": "c_name", "acctbal": "c_acctbal"}


def _filtered(table: str, kind: str, path: str, value, select: dict):
    def run(spark, sf_dir):
        return tables(spark, sf_dir).find(table).where(kind, path, value).run(None, select)

    return run


_PART = {"name": "p_name", "size": "p_size", "price": "p_retailprice"}
_ORDER = {"status": "o_orderstatus", "total": "o_totalprice"}
_PART_SQL = "SELECT 'part/' || p_partkey AS key, p_name AS name, p_size AS size, p_retailprice AS price FROM part WHERE "
_ORDER_SQL = "SELECT 'orders/' || o_orderkey AS key, o_orderstatus AS status, o_totalprice AS total FROM orders WHERE "
_CUSTOMER_SQL = "SELECT 'customer/' || c_custkey AS key, c_name AS name, c_acctbal AS acctbal FROM customer WHERE "


def q_and_path1(spark, sf_dir):
    q = tables(spark, sf_dir).find("customer").where_eq("nation.n_name", "NATION_7").where_gte("c_acctbal", 0)
    return q.run(None, _CUSTOMER)


def q_and_path2(spark, sf_dir):
    """Customers of a region, by way of their nation: best balance first by name."""
    q = tables(spark, sf_dir).find("customer").where_eq("nation.region.r_name", "AFRICA").where_gte("c_acctbal", 0)
    return q.order_by("c_name", "desc").limit(10).run(None, _CUSTOMER | {"region": "nation.region.r_name"})


def q_and_many(spark, sf_dir):
    q = tables(spark, sf_dir).find("part").where_prefix("p_type", "S").where_contains("p_name", "ring").where_gt("p_size", 10).where_lt("p_size", 40).where_exists("p_brand")
    return q.run(None, _PART)


def q_typed(spark, sf_dir):
    """A comparison across types matches nothing; equality minds the number's form: only the last of the three has rows."""
    find = lambda: tables(spark, sf_dir).find("part")
    return find().where_gt("p_name", 5).run(None, _PART).unionByName(find().where_eq("p_size", 10.0).run(None, _PART)).unionByName(find().where_eq("p_size", 10).run(None, _PART))


def q_order_page(spark, sf_dir):
    return tables(spark, sf_dir).find("orders").order_by("o_totalprice").offset(100).limit(50).run(None, _ORDER)


def q_order_desc_ties(spark, sf_dir):
    return tables(spark, sf_dir).find("part").order_by("p_size", "desc").limit(50).run(None, _PART)


def q_order_path(spark, sf_dir):
    return tables(spark, sf_dir).find("orders").where_gte("o_totalprice", 1000).order_by("customer.c_acctbal", "desc").offset(10).limit(20).run(None, _ORDER | {"acctbal": "customer.c_acctbal"})


def q_unordered_limit(spark, sf_dir):
    return tables(spark, sf_dir).find("customer").limit(25).run(None, _CUSTOMER)


def q_first(spark, sf_dir):
    return tables(spark, sf_dir).find("orders").where_eq("o_orderstatus", "F").first(_ORDER)


def q_late_materialize(spark, sf_dir):
    """The dearest orders; customer, nation and region are joined to the page only."""
    q = tables(spark, sf_dir).find("orders").order_by("o_totalprice", "desc").limit(100)
    return q.run(None, _ORDER | {"customer": "customer.c_name", "nation": "customer.nation.n_name", "region": "customer.nation.region.r_name"})


def q_key(spark, sf_dir):
    return tables(spark, sf_dir).find("customer").where_gte("$key", "customer/14").where_lt("$key", "customer/15").run(None, _CUSTOMER | {"nation": "nation", "nation_id": "nation.$id"})


def map_node(spark, sf_dir):
    return world(spark, sf_dir).entries("nation/3").select("key", "kind", "value")


def map_set(spark, sf_dir):
    return tables(spark, sf_dir).map("nation")


def point_get(spark, sf_dir):
    return tables(spark, sf_dir).get("customer", 42, _CUSTOMER)


def node_state(spark, sf_dir):
    return tables(spark, sf_dir).node_state("nation", 5)


def graph_query(spark, sf_dir):
    """Members of a set by a path through their links, over state tables."""
    spec = {"filters": [{"kind": "eq", "path": "region.name", "value": "ASIA"}, {"kind": "gte", "path": "rank", "value": 3}], "order": {"path": "rank", "direction": "desc"}}
    return world(spark, sf_dir).query("world.nations", spec)


def lex_range(spark, sf_dir):
    return world(spark, sf_dir).lex("world.nations", {"start_at": "nation/1", "end_before": "nation/2"})


def lex_depth2(spark, sf_dir):
    return world(spark, sf_dir).lex("world.nations", {"depth": 2, "follow_links": True, "prefix": "n"})


def lex_reverse_limit(spark, sf_dir):
    return world(spark, sf_dir).lex("world.nations", {"reverse": True, "limit": 7})


def mat_shallow(spark, sf_dir):
    g = world(spark, sf_dir)
    return g.shallow(g.nodes.where(F.col("node").startswith("nation/")))


def mat_deep(spark, sf_dir):
    return world(spark, sf_dir).materialize(read(spark, sf_dir, "nation").select(F.concat(F.lit("nation/"), F.col("n_nationkey")).alias("root")))


QUERIES = {
    "q_eq": _filtered("part", "eq", "p_size", 10, _PART), "q_ne": _filtered("orders", "ne", "o_orderstatus", "F", _ORDER), "q_gt": _filtered("orders", "gt", "o_totalprice", 400000, _ORDER),
    "q_gte": _filtered("part", "gte", "p_retailprice", 950.0, _PART), "q_lt": _filtered("customer", "lt", "c_acctbal", 0, _CUSTOMER), "q_lte": _filtered("part", "lte", "p_size", 5, _PART),
    "q_prefix": _filtered("part", "prefix", "p_name", "small", _PART), "q_contains": _filtered("part", "contains", "p_name", "widget", _PART), "q_exists": _filtered("customer", "exists", "c_acctbal", None, _CUSTOMER),
    "q_and_path1": q_and_path1, "q_and_path2": q_and_path2, "q_and_many": q_and_many, "q_typed": q_typed, "q_order_page": q_order_page, "q_order_desc_ties": q_order_desc_ties,
    "q_order_path": q_order_path, "q_unordered_limit": q_unordered_limit, "q_first": q_first, "q_late_materialize": q_late_materialize, "q_key": q_key,
    "map_node": map_node, "map_set": map_set, "point_get": point_get, "node_state": node_state, "graph_query": graph_query,
    "lex_range": lex_range, "lex_depth2": lex_depth2, "lex_reverse_limit": lex_reverse_limit, "mat_shallow": mat_shallow, "mat_deep": mat_deep,
}

_REGION_JSON = """'{"$id":"region/' || r_regionkey || '","name":"' || r_name || '","rank":' || r_regionkey || '}'"""

SQL = {
    "q_eq": _PART_SQL + "p_size = 10", "q_ne": _ORDER_SQL + "o_orderstatus <> 'F'", "q_gt": _ORDER_SQL + "o_totalprice > 400000", "q_gte": _PART_SQL + "p_retailprice >= 950.0",
    "q_lt": _CUSTOMER_SQL + "c_acctbal < 0", "q_lte": _PART_SQL + "p_size <= 5", "q_prefix": _PART_SQL + "starts_with(p_name, 'small')", "q_contains": _PART_SQL + "contains(p_name, 'widget')", "q_exists": _CUSTOMER_SQL + "c_acctbal IS NOT NULL",
    "q_and_path1": _CUSTOMER_SQL.replace("WHERE", "LEFT JOIN nation ON c_nationkey = n_nationkey WHERE") + "n_name = 'NATION_7' AND c_acctbal >= 0",
    "q_and_path2": """SELECT 'customer/' || c_custkey AS key, c_name AS name, c_acctbal AS acctbal, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
        LEFT JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'AFRICA' AND c_acctbal >= 0 ORDER BY c_name DESC, 'customer/' || c_custkey LIMIT 10""",
    "q_and_many": _PART_SQL + "starts_with(p_type, 'S') AND contains(p_name, 'ring') AND p_size > 10 AND p_size < 40 AND p_brand IS NOT NULL",
    "q_typed": _PART_SQL + "p_size = 10",
    "q_order_page": _ORDER_SQL + "true ORDER BY o_totalprice NULLS FIRST, 'orders/' || o_orderkey LIMIT 50 OFFSET 100",
    "q_order_desc_ties": _PART_SQL + "true ORDER BY p_size DESC NULLS LAST, 'part/' || p_partkey LIMIT 50",
    "q_order_path": """SELECT 'orders/' || o_orderkey AS key, o_orderstatus AS status, o_totalprice AS total, c_acctbal AS acctbal FROM orders LEFT JOIN customer ON o_custkey = c_custkey
        WHERE o_totalprice >= 1000 ORDER BY c_acctbal DESC NULLS LAST, 'orders/' || o_orderkey LIMIT 20 OFFSET 10""",
    "q_unordered_limit": _CUSTOMER_SQL + "true ORDER BY 'customer/' || c_custkey LIMIT 25",
    "q_first": _ORDER_SQL + "o_orderstatus = 'F' ORDER BY 'orders/' || o_orderkey LIMIT 1",
    "q_late_materialize": """SELECT o.*, c_name AS customer, n_name AS nation, r_name AS region FROM (SELECT 'orders/' || o_orderkey AS key, o_orderstatus AS status, o_totalprice AS total FROM orders
        ORDER BY o_totalprice DESC NULLS LAST, 'orders/' || o_orderkey LIMIT 100) o JOIN orders x ON o.key = 'orders/' || x.o_orderkey
        LEFT JOIN customer ON x.o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
    "q_key": """SELECT 'customer/' || c_custkey AS key, c_name AS name, c_acctbal AS acctbal, 'nation/' || c_nationkey AS nation, 'nation/' || n_nationkey AS nation_id FROM customer
        LEFT JOIN nation ON c_nationkey = n_nationkey WHERE 'customer/' || c_custkey >= 'customer/14' AND 'customer/' || c_custkey < 'customer/15'""",
    "map_node": """SELECT 'name' AS key, 'scalar' AS kind, '"' || n_name || '"' AS value FROM nation WHERE n_nationkey = 3 UNION ALL
        SELECT 'rank', 'scalar', CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'region', 'link', 'region/' || n_regionkey FROM nation WHERE n_nationkey = 3""",
    "map_set": """SELECT 'nation/' || n_nationkey AS key, '{"$id":"nation/' || n_nationkey || '","n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS value FROM nation""",
    "point_get": _CUSTOMER_SQL + "c_custkey = 42",
    "node_state": """SELECT 'nation/5' AS node, 'n_name' AS field, 'scalar' AS kind, n_name AS value FROM nation WHERE n_nationkey = 5 UNION ALL
        SELECT 'nation/5', 'n_nationkey', 'scalar', CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_nationkey = 5 UNION ALL SELECT 'nation/5', 'region', 'link', 'region/' || n_regionkey FROM nation WHERE n_nationkey = 5""",
    "graph_query": f"""SELECT 'nation/' || n_nationkey AS key, '{{"$id":"nation/' || n_nationkey || '","name":"' || n_name || '","rank":' || n_nationkey || ',"region":' || {_REGION_JSON} || '}}' AS value
        FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND n_nationkey >= 3""",
    "lex_range": "SELECT k AS path, k AS key, 'link' AS kind, k AS value FROM (SELECT 'nation/' || n_nationkey AS k FROM nation) WHERE k >= 'nation/1' AND k < 'nation/2'",
    "lex_depth2": """SELECT 'nation/' || n_nationkey AS path, 'nation/' || n_nationkey AS key, 'link' AS kind, 'nation/' || n_nationkey AS value FROM nation UNION ALL
        SELECT 'nation/' || n_nationkey || '.name', 'name', 'scalar', '"' || n_name || '"' FROM nation""",
    "lex_reverse_limit": "SELECT k AS path, k AS key, 'link' AS kind, k AS value FROM (SELECT 'nation/' || n_nationkey AS k FROM nation) ORDER BY k DESC LIMIT 7",
    "mat_shallow": """SELECT 'nation/' || n_nationkey AS node, '{"$id":"nation/' || n_nationkey || '","name":"' || n_name || '","rank":' || n_nationkey || ',"region":{"$link":"region/' || n_regionkey || '"}}' AS value FROM nation""",
    "mat_deep": f"""SELECT 'nation/' || n_nationkey AS root, '{{"$id":"nation/' || n_nationkey || '","name":"' || n_name || '","rank":' || n_nationkey || ',"region":' || {_REGION_JSON} || '}}' AS value
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
}
