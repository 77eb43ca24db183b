"""The k nearest rows of many queries in one pass: blocks of rows against blocks of queries inside each task.

A matrix product gives each pair's distance up to rounding; pairs that may be among a query's k nearest by that are
measured again term by term, as :func:`veritape.functions.numbers.squared_distance` does, so the distances are the same
to the last bit. A task keeps k distances a query, passes on at most k rows a query and ``ROWS`` rows read, ties by id
included, and never holds pairs beyond one block. What tasks pass on is ranked by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS = 4096
QUERIES = 1024


def usable(vector: Column, width: int) -> Column:
    inner = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == width) & inner, F.lit(False))


def _candidates(v: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs that hold each query's ``k`` nearest rows within its bound; some more by rounding."""
    with np.errstate(all="ignore"):
        qq, vv = (q * q).sum(axis=1), (v * v).sum(axis=1)
        about = qq[:, None] + vv[None, :] - 2 * (q @ v.T)
        slack = 8 * v.shape[1] * np.finfo(np.float64).eps * (qq + vv.max())
        limit = bound + slack
        inside = ~(about > limit[:, None])
        if len(v) > k and inside.sum() > 4 * k * len(q):
            limit = np.fmin(limit, np.partition(about, k - 1, axis=1)[:, k - 1] + 2 * slack)
            inside = ~(about > limit[:, None])
    return np.nonzero(inside)


def _measured(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    total = np.zeros(len(v))
    with np.errstate(all="ignore"):
        for j in range(v.shape[1]):
            apart = v[:, j] - q[:, j]
            total += apart * apart
    return total


class _Best:
    """Each query's k least distances so far; what is farther than the greatest of them is not passed on."""

    def __init__(self, q: np.ndarray, k: int, bound: np.ndarray | None):
        self.q, self.k = q, k
        self.first = np.full(len(q), np.inf) if bound is None else bound
        self.held = np.full((len(q), k), np.inf)

    def add(self, v: np.ndarray, order: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, distance) of the rows ``v`` that may be among the nearest of the queries ``asked``; ``order`` is the rows' rank by id."""
        bound = np.minimum(self.first[asked], self.held[asked].max(axis=1))
        at, row = _candidates(v, self.q[asked], bound, self.k)
        query, d = asked[at], _measured(v[row], self.q[asked[at]])
        sort = np.lexsort((order[row], d, query))
        query, row, d = query[sort], row[sort], d[sort]
        begin = np.searchsorted(query, query)
        place = np.arange(len(query)) - begin
        keep = place < self.k
        query, row, d, place = query[keep], row[keep], d[keep], place[keep]
        new = np.full((len(self.q), self.k), np.inf)
        new[query, place] = d
        there = np.unique(query)
        self.held[there] = np.partition(np.concatenate([self.held[there], new[there]], axis=1), self.k - 1, axis=1)[:, : self.k]
        near = ~(d > self.held[query].max(axis=1))
        return query[near], row[near], d[near]


def nearest(rows: DataFrame, ids: pa.Array, q: np.ndarray, k: int, id_col: str, vec_col: str, query_type: T.DataType, bound: np.ndarray | None = None, cells: dict[int, np.ndarray] | None = None, cell_col: str = "ivf_cell") -> DataFrame:
    """The columns of ``rows`` with query_id and distance: all rows that can be among a query's ``k`` nearest.

    Vectors of ``rows`` have the queries' width and finite components. ``bound``: the greatest squared distance that is wanted
    of each query. ``cells``: the queries that look into each cell; without it all look at all rows.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("query_id", query_type), T.StructField("distance", T.DoubleType())])
    names, width = schema.names, q.shape[1]
    sent = rows.sparkSession.sparkContext.broadcast((ids, q, bound, cells))

    def blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray | None]]:
        groups = [(batch, None)]
        if sent.value[3] is not None:
            cell = batch.column(names.index(cell_col)).to_numpy(zero_copy_only=False)
            groups = [(batch.filter(pa.array(cell == c)), sent.value[3].get(int(c))) for c in np.unique(cell)]
            groups = [g for g in groups if g[1] is not None]
        for part, asked in groups:
            for i in range(0, part.num_rows, ROWS):
                yield part.slice(i, ROWS), asked

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of ``ROWS`` rows at least, but the last: the session may send shorter ones, and each would pass on k rows a query."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= ROWS:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, bound, _ = sent.value
        best, every = _Best(q, k, bound), np.arange(len(q))
        for batch in gathered(batches):
            for part, asked in blocks(batch):
                v = part.column(names.index(vec_col)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
                order = np.empty(len(v), np.int64)
                order[pc.sort_indices(part.column(names.index(id_col))).to_numpy()] = np.arange(len(v))
                asked = every if asked is None else asked
                for i in range(0, len(asked), QUERIES):
                    query, row, d = best.add(v, order, asked[i : i + QUERIES])
                    taken = part.take(pa.array(row, pa.int64()))
                    yield pa.RecordBatch.from_arrays([*taken.columns, ids.take(pa.array(query, pa.int64())), pa.array(d)], names=names)

    return rows.mapInArrow(tasks, schema)


def matrix(queries: DataFrame, id_col: str, vec_col: str, width: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and vectors of a bounded block of queries."""
    found = queries.select(id_col, vec_col).toArrow().combine_chunks()
    column = lambda i: found.column(i).combine_chunks() if isinstance(found.column(i), pa.ChunkedArray) else found.column(i)
    return column(0), column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


