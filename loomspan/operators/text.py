"""BM25 ranking over declared collections and ad-hoc candidates.

A document is (id, fields map<string,string>, ...). Term frequencies are per field, lengths per document over all indexed
fields, document frequencies over documents. For the few terms of a query everything is counted in one aggregation of the
documents, without postings; `postings` builds them for collections that are searched often.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.errors import InvalidSpec
from loomspan.operators.predicates import paged
from loomspan.plans import specs
from loomspan.sources import indexes

K1, B = 1.2, 0.75
_BREAK = r"[^\p{IsAlphabetic}\p{N}_]+"


def analyze(text: Column, lowercase: bool = True) -> Column:
    """Terms: runs of letters, digits and underscores."""
    return F.array_remove(F.split(F.lower(text) if lowercase else text, _BREAK), "")


def terms_of(text: str, lowercase: bool = True) -> list[str]:
    """The same on the driver, for queries: distinct and sorted."""
    out, run = set(), []
    for c in (text.lower() if lowercase else text) + " ":
        if c.isalnum() or c == "_":
            run.append(c)
        elif run:
            out.add("".join(run))
            run = []
    return sorted(out)


def collection_config(fields: dict[str, float] | None = None, analyzer: dict | None = None, k1: float = K1, b: float = B) -> dict:
    """Weights by field (None: every field, weight 1), and the formula's constants, checked."""
    if fields is not None and not fields:
        raise InvalidSpec("a collection needs a field")
    if any(w < 0 for w in (fields or {}).values()) or k1 < 0 or not 0 <= b <= 1:
        raise InvalidSpec("weights, k1 and b must be in range")
    return {"fields": fields, "lowercase": (analyzer or {}).get("lowercase", True), "k1": k1, "b": b}


def tokens(docs: DataFrame, config: dict) -> DataFrame:
    """(id, field, terms) of each indexed field."""
    rows = docs.select("id", F.explode("fields").alias("field", "text"))
    if config["fields"] is not None:
        rows = rows.where(F.col("field").isin(list(config["fields"])))
    return rows.select("id", "field", analyze(F.col("text"), config["lowercase"]).alias("terms"))


def postings(docs: DataFrame, config: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Term counts (term, id, field, tf) and document lengths (id, length)."""
    own = tokens(docs, config or collection_config())
    counted = own.select("id", "field", F.explode("terms").alias("term")).groupBy("term", "id", "field").agg(F.count("*").alias("tf"))
    lengths = own.groupBy("id").agg(F.sum(F.size("terms")).alias("length")).where("length > 0")
    return counted, lengths


def stats(docs: DataFrame, config: dict | None = None) -> DataFrame:
    """One row: documents with a term, distinct terms, all terms, average length."""
    own = tokens(docs, config or collection_config())
    total = own.groupBy("id").agg(F.sum(F.size("terms")).alias("n")).where("n > 0").agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_terms"))
    distinct = own.select(F.explode("terms").alias("term")).agg(F.countDistinct("term").alias("terms"))
    return total.crossJoin(distinct).select("documents", "terms", "total_terms", (F.col("total_terms") / F.greatest("documents", F.lit(1))).alias("average_length"))


def _weight(config: dict, field: Column) -> Column:
    if not config["fields"]:
        return F.lit(1.0)
    return F.coalesce(F.try_element_at(F.create_map(*[x for k, w in config["fields"].items() for x in (F.lit(k), F.lit(float(w)))]), field), F.lit(1.0))


def _is(term: str):
    return lambda t: t == F.lit(term)


def scores(docs: DataFrame, query: str, config: dict | None = None, fields: list[str] | None = None) -> DataFrame:
    """(id, score, hits) of every document with a positive score; hits: array of (field, terms, score).

    One pass counts the query's terms and the length of each document. What the collection says of a term (its document
    frequency, and the number and average length of documents) is a one-row aggregate of that pass's result.
    """
    config = config or collection_config()
    wanted = terms_of(query, config["lowercase"])
    if not wanted:
        return docs.select("id").where(F.lit(False)).select("id", F.lit(0.0).alias("score"), F.lit(None).cast("array<struct<field:string,terms:array<string>,score:double>>").alias("hits"))
    own = tokens(docs, config)
    tf = [F.size(F.filter("terms", _is(w))).alias(f"t{i}") for i, w in enumerate(wanted)]
    per_field = own.select("id", "field", F.size("terms").alias("n"), *tf)
    names = [f"t{i}" for i in range(len(wanted))]
    per_doc = per_field.groupBy("id").agg(F.sum("n").alias("length"), *[F.sum(c).alias(c) for c in names], F.collect_list(F.when(sum(F.col(c) for c in names) > 0, F.struct("field", *names))).alias("fields"))
    per_doc = per_doc.where("length > 0")
    whole = per_doc.agg(F.count("*").alias("N"), F.avg("length").alias("avg"), *[F.count(F.when(F.col(c) > 0, 1)).alias(f"df{i}") for i, c in enumerate(names)])
    rows = per_doc.where(sum(F.col(c) for c in names) > 0).join(F.broadcast(whole), how="cross")  # the one row of collection statistics
    return _scored(rows, wanted, config, fields)


def _scored(rows: DataFrame, wanted: list[str], config: dict, fields: list[str] | None) -> DataFrame:
    """Scores from rows (id, length, fields: counts t0, t1, ... by field, N, avg, df0, df1, ...)."""
    k1, b = config["k1"], config["b"]

    def part(f: Column, i: int) -> Column:
        idf = F.log((F.col("N") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5) + 1)
        n = f[f"t{i}"].cast("double")
        return idf * n * (k1 + 1) / (n + k1 * (1 - b + b * F.col("length") / F.col("avg"))) * _weight(config, f["field"])

    def hit(f: Column) -> Column:
        found = F.array_compact(F.array(*[F.when(f[f"t{i}"] > 0, F.lit(w)) for i, w in enumerate(wanted)]))
        return F.struct(f["field"].alias("field"), found.alias("terms"), sum((part(f, i) for i in range(1, len(wanted))), part(f, 0)).alias("score"))

    scored = F.col("fields")
    if fields is not None:
        scored = F.filter(scored, lambda f: f["field"].isin(list(fields)))
    hits = F.filter(F.transform(scored, hit), lambda h: h["score"] > 0)
    rows = rows.withColumn("hits", F.array_sort(hits))
    score = F.aggregate("hits", F.lit(0.0), lambda s, h: s + h["score"])
    return rows.withColumn("score", score).where("score > 0").select("id", "score", "hits")


def index_tables(config: dict):
    """What a stored index holds: postings by term, lengths by id, and the collection's one row of statistics."""

    def tables(docs: DataFrame) -> dict[str, tuple[DataFrame, str]]:
        counted, lengths = postings(docs, config)
        return {"postings": (counted, "term"), "lengths": (lengths, "id"), "totals": (lengths.agg(F.count("*").alias("N"), F.avg("length").alias("avg")), "N")}

    return tables


def search_stored(docs: DataFrame, path: str, query: str, spec: dict | None = None, config: dict | None = None, digits: int | None = None) -> DataFrame:
    """`search` over the index stored at `path`, which is built if missing; the spec's stalePolicy says what happens if `docs` have changed.

    Only postings of the query's terms are read (sorted by term, so others are skipped) and only lengths of their documents joined.
    """
    spec, config = _checked(spec), config or collection_config()
    table = indexes.opened(docs, path, index_tables(config), spec["stalePolicy"])
    wanted = terms_of(query, config["lowercase"])
    if not wanted:
        return _page(docs, scores(docs, query, config, spec["fields"]), spec, digits)
    found = table("postings").where(F.col("term").isin(wanted))
    names = [f"t{i}" for i in range(len(wanted))]
    counts = [F.coalesce(F.sum(F.when(F.col("term") == w, F.col("tf"))), F.lit(0)).alias(c) for c, w in zip(names, wanted)]
    per_doc = found.groupBy("id", "field").agg(*counts).groupBy("id").agg(*[F.sum(c).alias(c) for c in names], F.collect_list(F.struct("field", *names)).alias("fields"))
    whole = per_doc.agg(*[F.count(F.when(F.col(c) > 0, 1)).alias(f"df{i}") for i, c in enumerate(names)])
    rows = per_doc.join(table("lengths"), "id").crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(table("totals")))  # one row each
    return _page(docs, _scored(rows, wanted, config, spec["fields"]), spec, digits)


def _checked(spec: dict | None) -> dict:
    spec = specs.filled(spec, specs.TEXT_SEARCH)
    if spec["stalePolicy"] not in ("allow", "refresh", "reject"):
        raise InvalidSpec(f"not a policy: {spec['stalePolicy']}")
    for name in ("limit", "candidateLimit"):
        if spec[name] is not None and spec[name] < 1:
            raise InvalidSpec(f"{name} must be positive")
    return spec


def search(docs: DataFrame, query: str, spec: dict | None = None, config: dict | None = None, digits: int | None = None) -> DataFrame:
    """The page of matches by falling score, ties by id: id, score, hits and what the spec includes.

    `digits` rounds scores before they order matches, so that equal documents tie in any engine.
    """
    spec = _checked(spec)
    return _page(docs, scores(docs, query, config, spec["fields"]), spec, digits)


def _page(docs: DataFrame, out: DataFrame, spec: dict, digits: int | None) -> DataFrame:
    if digits is not None:
        out = out.withColumn("score", F.round("score", digits))
    order = [F.desc("score"), F.asc("id")]
    out = paged(out, order, spec["offset"] or 0, spec["limit"]) if spec["offset"] or spec["limit"] is not None else out.orderBy(*order)
    if spec["explain"]:
        out = out.withColumn("explain", F.concat(F.lit("bm25 over "), F.size("hits").cast("string"), F.lit(" fields")))
    if spec["includeSnippets"] or spec["includeMetadata"]:
        extra = [c for c in docs.columns if c not in ("id", "fields")] if spec["includeMetadata"] else []
        more = docs.select("id", *extra, *([snippets(F.col("fields"), spec["fields"]).alias("snippets")] if spec["includeSnippets"] else []))
        out = out.join(more, "id").orderBy(F.desc("score"), "id")
    return out


def snippets(fields: Column, only: list[str] | None = None, most: int = 3, chars: int = 240) -> Column:
    """The first fields by name, at most `most`, each with its first `chars` characters."""
    entries = F.array_sort(F.map_entries(fields))
    if only is not None:
        entries = F.filter(entries, lambda e: e["key"].isin(list(only)))
    return F.transform(F.slice(entries, 1, most), lambda e: F.struct(e["key"].alias("field"), F.substring(e["value"], 1, chars).alias("text")))


def candidates(rows: DataFrame, spec: dict | None = None, preselected: bool = False) -> DataFrame:
    """Documents from ad-hoc candidates (ordinal, id, fields): `candidateLimit` of them, then the last of each id at its first place.

    Candidates that an ordered or limited query has preselected are refused unless the spec's policy allows them.
    """
    spec = _checked(spec)
    if preselected and spec["candidatePolicy"] != "allow_preselected_candidates":
        raise InvalidSpec("the candidates are a page of a query")
    if spec["candidateLimit"] is not None:
        rows = paged(rows, [F.asc("ordinal")], 0, spec["candidateLimit"])
    if spec["fields"] is not None:
        rows = rows.withColumn("fields", F.map_filter("fields", lambda k, _: k.isin(list(spec["fields"]))))
    return rows.groupBy("id").agg(F.max_by("fields", "ordinal").alias("fields"), F.min("ordinal").alias("ordinal"))


def candidate_counts(rows: DataFrame, spec: dict | None = None) -> DataFrame:
    """One row about a search over `candidates(rows, spec)`: candidates offered, documents searched, and whether the limit left some out."""
    spec = _checked(spec)
    searched = candidates(rows, spec).agg(F.count("*").alias("searched_count"))
    most = F.lit(spec["candidateLimit"]).cast("long")
    offered = rows.agg(F.count("*").alias("offered"))
    cut = F.coalesce(F.col("offered") > most, F.lit(False))
    return offered.crossJoin(searched).select(F.when(cut, most).otherwise(F.col("offered")).alias("candidate_count"), "searched_count", cut.alias("truncated_candidates"))  # one row each


def string_leaves(value: Column, paths: list[str] | None = None) -> Column:
    """Fields map of a JSON text: the string leaves named by dotted path, array places counted; or only selected paths.

    A selected path that holds an object or array yields its string leaves joined by spaces, in path order.
    """
    from pyspark.sql import SparkSession

    from loomspan.functions.leaves import selected_leaves
    from loomspan.sources.tables import importable

    importable(SparkSession.active())

    return selected_leaves(paths)(value)
