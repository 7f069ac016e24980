"""Queries of traversal, text search and vector search."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.operators import fanin, text, traverse, vector
from loomspan.plans.data import read, tables, world

_ALL = {"limit": None}


def _star(spark, sf_dir):
    g = tables(spark, sf_dir, "customer", "nation", "region")
    return g, g.edges(), g.nodes()


def _rows(t: traverse.Traversal):
    return t.rows.select("node", F.col("depth").cast("int").alias("depth"))


def trav_out(spark, sf_dir):
    """All customers' nations and regions."""
    g, edges, nodes = _star(spark, sf_dir)
    return _rows(traverse.traverse(g.nodes("customer"), edges, nodes, _ALL | {"maxDepth": 2}))


def trav_in(spark, sf_dir):
    """What links to a region, over two steps."""
    g, edges, nodes = _star(spark, sf_dir)
    return _rows(traverse.traverse(spark.createDataFrame([("region/2",)], "node string"), edges, nodes, _ALL | {"maxDepth": 2, "direction": "inbound"}))


def trav_both(spark, sf_dir):
    g, edges, nodes = _star(spark, sf_dir)
    return _rows(traverse.traverse(spark.createDataFrame([("nation/4",)], "node string"), edges, nodes, _ALL | {"maxDepth": 2, "direction": "both", "includeStart": True}))


def trav_edge_fields(spark, sf_dir):
    """One field's edges only, and the first 10 rows a queue would return."""
    g, edges, nodes = _star(spark, sf_dir)
    t = traverse.traverse(g.nodes("nation"), edges, nodes, {"maxDepth": 3, "edgeFields": ["region"], "includeStart": True, "limit": 10})
    return _rows(t).withColumn("limited", F.lit(t.result_limit_reached))


def trav_filter(spark, sf_dir):
    """Members of a set and what they link to, of which one name is returned."""
    spec = {"maxDepth": 2, "includeStart": True, "limit": None, "filters": [{"kind": "contains", "path": "name", "value": "A"}]}
    return _rows(world(spark, sf_dir).traverse("world.nations", spec))


def trav_paths(spark, sf_dir):
    """The path by which a queue first meets each node."""
    g, edges, nodes = _star(spark, sf_dir)
    t = traverse.traverse(g.nodes("nation"), edges, nodes, _ALL | {"maxDepth": 1})
    return t.rows.select("node", F.array_join("path", ">").alias("path"), "via.field")


def trav_dfs(spark, sf_dir):
    """Depth first from the world's nations: the stack takes the last one first."""
    t = world(spark, sf_dir).traverse("world.nations", {"strategy": "dfs", "maxDepth": 3, "limit": None, "includeStart": True})
    return t.rows.select("node", F.col("depth").cast("int").alias("depth"), "rank")


def closure_root(spark, sf_dir):
    """All orders and what they reach."""
    g = tables(spark, sf_dir)
    return traverse.closure(g.nodes("orders"), g.edges())


def _documents(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.create_map(F.lit("text"), F.col("text")).alias("fields"), "lang", "source")


def _two_fields(spark, sf_dir):
    """Conversations' messages with their role as a second field."""
    c = read(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.create_map(F.lit("text"), F.col("text"), F.lit("role"), F.col("role")).alias("fields"), "role")


_QUERY = "idiot thnd heatly"
_RANK = ("id", "score")


def text_bm25(spark, sf_dir):
    return text.search(_documents(spark, sf_dir), _QUERY, {"limit": 10}, digits=6).select(*_RANK)


def text_bm25_all(spark, sf_dir):
    return text.search(_documents(spark, sf_dir), _QUERY, {"limit": None}, digits=6).select(*_RANK)


def text_bm25_page(spark, sf_dir):
    return text.search(_documents(spark, sf_dir), _QUERY, {"offset": 20, "limit": 10}, digits=6).select(*_RANK)


def text_bm25_fields(spark, sf_dir):
    """Weighted fields, of which one is searched; lengths and frequencies stay those of the whole documents."""
    config = text.collection_config({"text": 2.0, "role": 0.5})
    return text.search(_two_fields(spark, sf_dir), "the user", {"fields": ["text"], "limit": 25}, config, digits=6).select(*_RANK)


def text_bm25_weights(spark, sf_dir):
    config = text.collection_config({"text": 2.0, "role": 0.5}, k1=1.5, b=0.5)
    return text.search(_two_fields(spark, sf_dir), "the user", {"limit": None}, config, digits=6).select(*_RANK)


def text_bm25_candidates(spark, sf_dir):
    """Messages as candidates, repeated ids by conversation: the last one of each counts."""
    c = read(spark, sf_dir, "conversations")
    rows = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("ordinal"), F.col("conv_id").alias("id"), F.create_map(F.lit("text"), F.col("text")).alias("fields"))
    return text.search(text.candidates(rows), "the of", {"limit": 20}, digits=6).select(*_RANK)


def text_bm25_query_source(spark, sf_dir):
    """Candidates that a query selects: documents of one language."""
    rows = _documents(spark, sf_dir).where("lang = 'en'").withColumn("ordinal", F.col("id"))
    return text.search(text.candidates(rows), _QUERY, {"limit": 10}, digits=6).select(*_RANK)


def text_hits(spark, sf_dir):
    """Terms found in each field."""
    out = text.search(_two_fields(spark, sf_dir), "the user", {"limit": None}, digits=6)
    return out.select("id", F.explode("hits").alias("h")).select("id", "h.field", F.array_join("h.terms", " ").alias("terms"), F.round("h.score", 6).alias("score"))


def text_snippets(spark, sf_dir):
    out = text.search(_two_fields(spark, sf_dir), "the user", {"limit": 50, "includeSnippets": True, "includeMetadata": True}, digits=6)
    return out.select("id", "role", F.explode("snippets").alias("s")).select("id", "role", "s.field", "s.text")


def text_index_stats(spark, sf_dir):
    return text.stats(_documents(spark, sf_dir)).withColumn("average_length", F.round("average_length", 6))


def text_postings(spark, sf_dir):
    """The index of the conversations: term frequencies by field."""
    return text.postings(_two_fields(spark, sf_dir))[0]


def fanin_text(spark, sf_dir):
    """The best of two languages, each ranked by its own peer."""
    docs = _documents(spark, sf_dir)
    answers = {f"peer-{x}": text.search(docs.where(F.col("lang") == x), "de en la", {"limit": 10}, digits=6).select(*_RANK) for x in ("fr", "es")}
    return fanin.merge_text(fanin.union(answers)).select("id", "score", "peer")


def _vector(spec: dict, metric: str):
    def run(spark, sf_dir):
        e = read(spark, sf_dir, "embeddings")
        query = e.where("vec_id = 7").first()["embedding"]
        out = vector.search(e, query, {"limit": 10} | spec, metric, "vec_id", "embedding", {"label": "label"}, dim=len(query))
        return out.withColumn("distance", F.round("distance", 6) + F.lit(0.0))

    return run


QUERIES = {
    "trav_out": trav_out, "trav_in": trav_in, "trav_both": trav_both, "trav_edge_fields": trav_edge_fields, "trav_filter": trav_filter, "trav_paths": trav_paths, "trav_dfs": trav_dfs, "closure_root": closure_root,
    "text_bm25": text_bm25, "text_bm25_all": text_bm25_all, "text_bm25_page": text_bm25_page, "text_bm25_fields": text_bm25_fields, "text_bm25_weights": text_bm25_weights, "text_bm25_candidates": text_bm25_candidates,
    "text_bm25_query_source": text_bm25_query_source, "text_hits": text_hits, "text_snippets": text_snippets, "text_index_stats": text_index_stats, "text_postings": text_postings, "fanin_text": fanin_text,
    "vec_l2": _vector({}, "l2"), "vec_dot": _vector({}, "dot"), "vec_cosine": _vector({}, "cosine"), "vec_filter_ids": _vector({"filter": {"ids": [3, 5, 8, 13, 21, 34]}, "limit": 4}, "l2"),
    "vec_filter_meta": _vector({"filter": {"metadata": {"eq": {"label": 1}, "exists": ["label"]}}, "includeMetadata": True}, "cosine"), "vec_filter_prefix": _vector({"filter": {"idPrefix": "1"}}, "cosine"),
}

_LINKS = """e AS (SELECT 'customer/' || c_custkey AS s, 'nation' AS f, 'nation/' || c_nationkey AS t FROM customer UNION ALL SELECT 'nation/' || n_nationkey, 'region', 'region/' || n_regionkey FROM nation)"""
_WORDS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')"


def _bm25(rows: str, query: str, tail: str, k1: float = 1.2, b: float = 0.75, weight: str = "1.0", only: str = "true", out: str = "") -> str:
    """`rows` selects (id, field, text); scores are summed over terms and fields."""
    terms = ", ".join(f"('{t}')" for t in sorted(set(query.split())))
    hits = out or "SELECT id, round(sum(part), 6) AS score FROM s GROUP BY id"
    return f"""WITH d AS ({rows}), w AS (SELECT id, field, {_WORDS.format("text")} AS w FROM d), q(t) AS (VALUES {terms}),
    l AS (SELECT id, sum(len(w)) AS n FROM w GROUP BY id HAVING sum(len(w)) > 0), g AS (SELECT count(*) AS N_, avg(n) AS a FROM l),
    tf AS (SELECT id, field, t, len(list_filter(w, lambda x: x = t)) AS tf FROM w, q), df AS (SELECT t, count(DISTINCT id) AS df FROM tf WHERE tf > 0 GROUP BY t),
    s AS (SELECT tf.id, tf.field, tf.t, ln((N_ - df + 0.5) / (df + 0.5) + 1) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * l.n / a)) * ({weight}) AS part
          FROM tf JOIN df ON tf.t = df.t JOIN l ON tf.id = l.id, g WHERE tf > 0 AND ({only})) {hits} {tail}"""


_DOC_ROWS = "SELECT doc_id AS id, 'text' AS field, text FROM documents"
_MSG_ROWS = "SELECT conv_id * 1000 + turn AS id, 'text' AS field, text FROM conversations UNION ALL SELECT conv_id * 1000 + turn, 'role', role FROM conversations"
_BEST = "ORDER BY score DESC, id LIMIT "


def _nearest(expr: str, where: str = "true", n: int = 10, extra: str = "") -> str:
    return f"""WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 7), v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE {where})
    SELECT vec_id AS id{extra}, round({expr}, 6) + 0.0 AS distance FROM v, q ORDER BY {expr}, vec_id LIMIT {n}"""


_L2, _DOT = "list_distance(e, q)", "-list_inner_product(e, q)"
_COS = "1 - list_inner_product(e, q) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(q, q)))"

SQL = {
    "trav_out": f"WITH {_LINKS} SELECT DISTINCT t AS node, CASE f WHEN 'nation' THEN 1 ELSE 2 END AS depth FROM e WHERE f = 'nation' OR s IN (SELECT t FROM e WHERE f = 'nation')",
    "trav_in": f"WITH {_LINKS} SELECT s AS node, 1 AS depth FROM e WHERE t = 'region/2' UNION ALL SELECT s, 2 FROM e WHERE t IN (SELECT s FROM e WHERE t = 'region/2')",
    "trav_both": f"""WITH {_LINKS}, r AS (SELECT t FROM e WHERE s = 'nation/4') SELECT 'nation/4' AS node, 0 AS depth UNION ALL SELECT s, 1 FROM e WHERE t = 'nation/4' UNION ALL SELECT t, 1 FROM r
        UNION ALL SELECT s, 2 FROM e WHERE t IN (SELECT t FROM r) AND s <> 'nation/4'""",
    "trav_edge_fields": "SELECT 'nation/' || n_nationkey AS node, 0 AS depth, true AS limited FROM nation ORDER BY 1 LIMIT 10",
    "trav_filter": "SELECT 'nation/' || n_nationkey AS node, 0 AS depth FROM nation WHERE contains(n_name, 'A') UNION ALL SELECT DISTINCT 'region/' || r_regionkey, 1 FROM region JOIN nation ON n_regionkey = r_regionkey WHERE contains(r_name, 'A')",
    "trav_paths": "SELECT 'region/' || n_regionkey AS node, min('nation/' || n_nationkey) || '>region/' || n_regionkey AS path, 'region' AS field FROM nation GROUP BY n_regionkey",
    "trav_dfs": """WITH n AS (SELECT 'nation/' || n_nationkey AS node, n_regionkey, row_number() OVER (ORDER BY 'nation/' || n_nationkey DESC) - 1 AS pos FROM nation), r AS (SELECT n_regionkey, min(pos) AS pos FROM n GROUP BY n_regionkey)
        SELECT node, 0 AS depth, pos + (SELECT count(*) FROM r WHERE r.pos < n.pos) AS rank FROM n UNION ALL SELECT 'region/' || n_regionkey, 1, pos + 1 + (SELECT count(*) FROM r o WHERE o.pos < r.pos) FROM r""",
    "closure_root": """SELECT 'orders/' || o_orderkey AS node FROM orders UNION SELECT 'customer/' || o_custkey FROM orders UNION SELECT 'nation/' || c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)
        UNION SELECT 'region/' || n_regionkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders))""",
    "text_bm25": _bm25(_DOC_ROWS, _QUERY, _BEST + "10"), "text_bm25_all": _bm25(_DOC_ROWS, _QUERY, ""), "text_bm25_page": _bm25(_DOC_ROWS, _QUERY, _BEST + "10 OFFSET 20"),
    "text_bm25_fields": _bm25(_MSG_ROWS, "the user", _BEST + "25", weight="CASE tf.field WHEN 'text' THEN 2.0 ELSE 0.5 END", only="tf.field = 'text'"),
    "text_bm25_weights": _bm25(_MSG_ROWS, "the user", "", 1.5, 0.5, weight="CASE tf.field WHEN 'text' THEN 2.0 ELSE 0.5 END"),
    "text_bm25_candidates": _bm25("SELECT conv_id AS id, 'text' AS field, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id", "the of", _BEST + "20"),
    "text_bm25_query_source": _bm25(_DOC_ROWS + " WHERE lang = 'en'", _QUERY, _BEST + "10"),
    "text_hits": _bm25(_MSG_ROWS, "the user", "", out="SELECT id, field, string_agg(t, ' ' ORDER BY t) AS terms, round(sum(part), 6) AS score FROM s GROUP BY id, field"),
    "text_snippets": "WITH top AS (" + _bm25(_MSG_ROWS, "the user", _BEST + "50") + f"""), m AS ({_MSG_ROWS}), c AS (SELECT conv_id * 1000 + turn AS id, role FROM conversations)
        SELECT top.id, c.role, m.field, left(m.text, 240) AS text FROM top JOIN m ON top.id = m.id JOIN c ON top.id = c.id""",
    "text_index_stats": f"""WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents) SELECT (SELECT count(*) FROM w WHERE len(w) > 0) AS documents, (SELECT count(DISTINCT t) FROM (SELECT unnest(w) AS t FROM w)) AS terms,
        CAST((SELECT sum(len(w)) FROM w) AS BIGINT) AS total_terms, round((SELECT sum(len(w)) FROM w) / (SELECT count(*) FROM w WHERE len(w) > 0), 6) AS average_length""",
    "text_postings": f"WITH d AS ({_MSG_ROWS}) SELECT term, id, field, count(*) AS tf FROM (SELECT id, field, unnest({_WORDS.format('text')}) AS term FROM d) GROUP BY 1, 2, 3",
    "fanin_text": "SELECT * FROM (SELECT *, 'peer-fr' AS peer FROM (" + _bm25(_DOC_ROWS + " WHERE lang = 'fr'", "de en la", _BEST + "10") + ")) UNION ALL SELECT * FROM (SELECT *, 'peer-es' AS peer FROM (" + _bm25(_DOC_ROWS + " WHERE lang = 'es'", "de en la", _BEST + "10") + "))",
    "vec_l2": _nearest(_L2), "vec_dot": _nearest(_DOT), "vec_cosine": _nearest(_COS), "vec_filter_ids": _nearest(_L2, "vec_id IN (3, 5, 8, 13, 21, 34)", 4),
    "vec_filter_meta": _nearest(_COS, "label = 1", extra=", label"), "vec_filter_prefix": _nearest(_COS, "starts_with(CAST(vec_id AS VARCHAR), '1')"),
}
