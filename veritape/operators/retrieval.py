"""Exact filtered nearest neighbours and what is made of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritape.functions.numbers import signal_class, squared_distance
from veritape.functions.text import context_lines, is_noise
from veritape.operators.dedup import first_wins
from veritape.operators.nearest import matrix, nearest, usable
from veritape.session import cut

SUFFIX_EXPLAIN = "growth decline guidance margins"  # fixed values: words added to a query before it is embedded
SUFFIX_DIAGNOSE = "guidance miss"


def top_k(vectors: DataFrame, query: list[float], k: int, where: Column | None = None, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows with ``distance``, filtered first. Each task keeps k rows; no shuffle of the table."""
    rows = vectors if where is None else vectors.where(where)
    q = F.lit([float(x) for x in query]).cast("array<double>")
    return rows.withColumn("distance", squared_distance(F.col(vec_col), q)).orderBy("distance", id_col).limit(k)


def retrieve_context(vectors: DataFrame, query: list[float], k: int = 6, where: Column | None = None, id_col: str = "id", doc_col: str = "document") -> DataFrame:
    """Twice ``k`` nearest, the first of equal documents, without noise, then the ``k`` best."""
    near = top_k(vectors, query, 2 * k, where, id_col)
    unique = first_wins(near, [doc_col], [F.asc("distance"), F.asc(id_col)])
    return unique.where(~is_noise(F.col(doc_col))).orderBy("distance", id_col).limit(k)


def company_contexts(vectors: DataFrame, queries: DataFrame, k: int = 6) -> DataFrame:
    """company, context: :func:`retrieve_context` for each company's own ``query`` over its own rows, joined to lines. ``vectors`` has the company as a column."""
    order = [F.col("distance").asc_nulls_last(), F.asc("id")]
    w = Window.partitionBy("company").orderBy(*order)
    own = vectors.join(queries, "company").withColumn("distance", squared_distance(F.col("embedding"), F.col("query").cast("array<double>"))).drop("query", "embedding")
    near = own.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= 2 * k)
    unique = first_wins(near.drop("__rn"), ["company", "document"], order).where(~is_noise(F.col("document")))
    best = unique.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k)
    return best.groupBy("company").agg(context_lines(F.transform(F.array_sort(F.collect_list(F.struct("__rn", "document"))), lambda x: x.document)).alias("context"))


def signal_top_k(vectors: DataFrame, query: list[float], k: int = 8, where: Column | None = None, id_col: str = "id", doc_col: str = "document") -> DataFrame:
    """Of four times ``k`` nearest, unique and without noise, the ``k`` best of each signal class."""
    near = first_wins(top_k(vectors, query, 4 * k, where, id_col), [doc_col], [F.asc("distance"), F.asc(id_col)]).where(~is_noise(F.col(doc_col)))
    classed = near.withColumn("signal", signal_class(F.col("result"), F.col("reason")))
    w = Window.partitionBy("signal").orderBy("distance", id_col)
    return classed.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def batch_top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vec_col: str = "embedding", query_id: str = "query_id", query_vec: str = "query", max_queries: int = 1024) -> DataFrame:
    """The ``k`` nearest rows for each query, rows without a distance last. Blocks are measured in the tasks; see ``operators/nearest.py``.

    Over ``max_queries`` queries are taken in blocks of about two thirds as many, by the hash of their id; each block's
    result is written, so that one block at a time is broadcast.
    """
    n = queries.count()
    if n > max_queries:
        blocks = -(-3 * n // (2 * max_queries))
        held = cut(queries.withColumn("__block", F.pmod(F.xxhash64(query_id), F.lit(blocks))), "queries")
        parts = [cut(batch_top_k(vectors, held.where(F.col("__block") == b).drop("__block"), k, id_col, vec_col, query_id, query_vec, n), "nearest") for b in range(blocks)]
        return reduce(DataFrame.unionAll, parts)
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).cast("array<double>").alias("__q"))
    common = asked.where("__q is not null").groupBy(F.size("__q").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    width = common.w if common else 0
    good, odd = usable(F.col("__q"), width) & (F.size("__q") > 0), usable(F.col(vec_col).cast("array<double>"), width)
    w = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), id_col)

    def plain(rows: DataFrame, some: DataFrame) -> DataFrame:
        return rows.crossJoin(F.broadcast(some)).withColumn("distance", squared_distance(F.col(vec_col), F.col("__q"))).drop("__q")

    # queries without a vector like most others' are few; they are measured pair by pair
    pairs = plain(vectors, asked.where(~good))
    ids, q = matrix(asked.where(good), "query_id", "__q", max(width, 1))
    if len(ids):
        # to such queries a row without finite components is as far as to any other, so the least k of them are enough
        zero = F.array_repeat(F.lit(0.0), width)
        unlike = vectors.where(~odd).withColumn("__d", squared_distance(F.col(vec_col), zero)).orderBy(F.asc_nulls_last("__d"), id_col).limit(k).drop("__d")
        near = nearest(vectors.where(odd), ids, q, k, id_col, vec_col, asked.schema["query_id"].dataType)
        pairs = pairs.unionByName(near).unionByName(plain(unlike, asked.where(good)))
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def chat_context(rows: DataFrame, id_col: str = "id", doc_col: str = "document") -> DataFrame:
    """One row: the lines that a chat prompt takes from retrieved rows (quarter, result, document), nearest first. At most k rows are gathered."""
    line = F.concat(F.lit("["), F.coalesce("quarter", F.lit("")), F.lit("] Claim ("), F.coalesce("result", F.lit("")), F.lit("): "), F.col(doc_col))
    ordered = F.array_sort(F.collect_list(F.struct("distance", F.col(id_col).alias("i"), line.alias("line"))))
    return rows.agg(F.array_join(F.transform(ordered, lambda x: x.line), "\n").alias("context"))
