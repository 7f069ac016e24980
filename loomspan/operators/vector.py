"""Exact nearest neighbours by three metrics, with filters on ids and metadata."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.errors import InvalidSpec
from loomspan.operators.predicates import paged
from loomspan.plans import specs
from loomspan.sources import indexes

METRICS = ("l2", "dot", "cosine")


def _sum(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)


def distance(vector: Column, query: Column, metric: str, query_norm: Column | None = None) -> Column:
    """Distance of two arrays of doubles: root of squared differences, negative product, or one minus cosine (1 for a zero vector)."""
    if metric == "l2":
        return F.sqrt(_sum(vector, query, lambda x, y: (x - y) * (x - y)))
    product = _sum(vector, query, lambda x, y: x * y)
    if metric == "dot":
        return -product
    if metric != "cosine":
        raise InvalidSpec(metric)
    own = F.sqrt(_sum(vector, vector, lambda x, y: x * y))
    other = F.sqrt(_sum(query, query, lambda x, y: x * y)) if query_norm is None else query_norm
    return F.when((own == 0) | (other == 0), F.lit(1.0)).otherwise(1.0 - product / (own * other))


def validated(query: list[float], dim: int | None, limit: int | None) -> list[float]:
    """The query as doubles; errors for a wrong dimension, values that aren't finite, or a limit below one."""
    if limit is None or limit < 1:
        raise InvalidSpec("limit must be positive")
    if dim is not None and len(query) != dim:
        raise InvalidSpec(f"dimension {len(query)}, expected {dim}")
    if not all(math.isfinite(x) for x in query):
        raise InvalidSpec("the query isn't finite")
    return [float(x) for x in query]


def filtered(vectors: DataFrame, f: dict | None, id_col: str = "id", metadata: dict[str, str] | None = None) -> DataFrame:
    """Rows that pass `ids`, `idPrefix` and the metadata predicates eq, prefix and exists; metadata: key -> column."""
    if not f:
        return vectors
    meta = metadata or {}
    if f.get("ids"):
        vectors = vectors.where(F.col(id_col).isin(list(f["ids"])))
    if f.get("idPrefix"):
        vectors = vectors.where(F.col(id_col).cast("string").startswith(f["idPrefix"]))
    tests = f.get("metadata") or {}
    for key, value in (tests.get("eq") or {}).items():
        vectors = vectors.where(F.col(meta[key]) == F.lit(value)) if key in meta else vectors.where(F.lit(False))
    for key, value in (tests.get("prefix") or {}).items():
        vectors = vectors.where(F.col(meta[key]).cast("string").startswith(value)) if key in meta else vectors.where(F.lit(False))
    for key in tests.get("exists") or []:
        vectors = vectors.where(F.col(meta[key]).isNotNull()) if key in meta else vectors.where(F.lit(False))
    return vectors


def search(vectors: DataFrame, query: list[float], spec: dict, metric: str = "l2", id_col: str = "id", vector_col: str = "embedding", metadata: dict[str, str] | None = None, dim: int | None = None) -> DataFrame:
    """The `limit` nearest rows: id, distance and, if asked, metadata and vector; ties by id.

    The query is a literal, so a scan computes distances and keeps a heap of `limit` rows in each task. Rows without a
    vector aren't in the collection; a vector of another dimension than the query's is an error as soon as it is read.
    """
    spec = specs.filled(spec, specs.VECTOR_SEARCH)
    q = validated(query, dim, spec["limit"])
    rows = filtered(vectors, spec["filter"], id_col, metadata).where(F.col(vector_col).isNotNull())
    own = F.size(vector_col)
    checked = F.when(own == len(q), F.col(vector_col)).otherwise(F.raise_error(F.concat(F.lit("dimension "), own.cast("string"), F.lit(f", expected {len(q)}"))))
    rows = rows.withColumn(vector_col, checked)
    literal = F.lit(q) if q else F.array().cast("array<double>")
    norm = F.lit(math.sqrt(sum(x * x for x in q)))
    rows = rows.withColumn("distance", distance(F.col(vector_col).cast("array<double>"), literal, metric, norm))
    out = [F.col(id_col).alias("id"), "distance"]
    if spec["includeMetadata"]:
        out += [F.col(c).alias(k) for k, c in (metadata or {}).items()]
    if spec["includeVector"]:
        out.append(F.col(vector_col).alias("vector"))
    return paged(rows.select(*out), [F.asc("distance"), F.asc("id")], 0, spec["limit"])


def index_tables(vectors: DataFrame) -> dict[str, tuple[DataFrame, str]]:
    """What a stored collection holds: its vectors, range-sorted by id."""
    return {"vectors": (vectors, "id")}


def search_stored(vectors: DataFrame, path: str, query: list[float], spec: dict, metric: str = "l2", metadata: dict[str, str] | None = None, dim: int | None = None) -> DataFrame:
    """`search` over the vectors (id, embedding, ...) stored at `path`; the spec's stalePolicy says what happens if `vectors` have changed: the source is searched, the stored ones are, or an error."""
    policy = specs.filled(spec, specs.VECTOR_SEARCH)["stalePolicy"]
    if policy not in ("fallback_exact", "allow_stale", "error"):
        raise InvalidSpec(f"not a policy: {policy}")
    table = indexes.opened(vectors, path, index_tables, policy)
    return search(vectors if table is None else table("vectors"), query, spec, metric, metadata=metadata, dim=dim)


def assemble_chunks(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vectors from raw records: `items` (id, dim, n_chunks, deleted), `chunks` (id, n, values).

    Returns (id, state, embedding): complete, incomplete (chunks are missing or the length is wrong) or deleted.
    """
    parts = chunks.dropDuplicates(["id", "n"]).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "values"))).alias("parts"))
    out = items.join(parts, "id", "left").withColumn("embedding", F.flatten(F.col("parts.values")))
    whole = (F.size("parts") == F.col("n_chunks")) & (F.size("embedding") == F.col("dim"))
    state = F.when(F.col("deleted"), "deleted").when(F.coalesce(whole, F.lit(False)), "complete").otherwise("incomplete")
    return out.select("id", state.alias("state"), F.when(state == "complete", F.col("embedding")).alias("embedding"))


def stats(assembled: DataFrame) -> DataFrame:
    """One row: how many vectors are complete, deleted and incomplete."""
    return assembled.agg(*[F.count(F.when(F.col("state") == s, 1)).alias(n) for n, s in (("vectors", "complete"), ("deleted", "deleted"), ("incomplete", "incomplete"))])
