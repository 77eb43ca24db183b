"""A text embedder trained in Spark: hashed words weighted by rarity, and a truncated decomposition of their table.

A text is a row of the term table: the buckets of its words, each with 1 + ln(times in the text), times
ln((1 + texts) / (1 + texts with the bucket)) + 1, the row of length one. Training finds the leading right
singular vectors of that table over all texts. A block of random directions (buckets by ``width`` + ``SPARE``
numbers, a few megabytes whatever the input) is multiplied by the table's Gram matrix once a pass: each task
multiplies its rows by the block and back, one row a bucket leaves the task, and Spark adds them up by
bucket. The driver holds the block only, makes it orthonormal between passes, and solves the small problem
inside it at the end. Counts of texts by bucket and the products cover every text; nothing is sampled.

Texts and questions are projected by the same weights, so they lie in one space, and cosines or distances of
the unit vectors compare them. Texts that are null, hold no word, or whose words project to nothing have the zero
vector. A table with fewer independent texts than ``width`` leaves the last components zero; an empty table all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritape.session import cut, drop_cut

BUCKETS = 8192
WIDTH = 64
SPARE = 16  # directions beyond the width, which sharpen the last components
PASSES = 4  # over all texts
FLATTEN = 0.5  # a component is divided by its singular value to this power, so that common themes don't drown the rest
CHUNK = 1 << 15  # terms of a task that are multiplied at once
CHUNK_ROWS = 64  # and rows, at most
BAG_ROWS = 500  # texts whose words a task counts at once
KNOWN_WORDS = 200_000  # whose buckets a task remembers


def terms(text: Column, n: int = BUCKETS) -> Column:
    """The bucket of each word of letters or digits of any script, repeats included."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{Nd}]+)"), 1)
    return F.transform(words, lambda t: (F.conv(F.substring(F.md5(t), 1, 7), 16, 10).cast("int") % n).cast("int"))


def inverse_frequency(df: Column, n_texts: Column | int) -> Column:
    return F.log((1.0 + n_texts) / (1.0 + df)) + 1.0


def text_counts(texts: DataFrame, text_col: str = "text", n_buckets: int = BUCKETS) -> DataFrame:
    """bucket, df: in how many texts each bucket occurs."""
    return _counts(texts.select(terms(F.col(f"`{text_col}`"), n_buckets).alias("at")))


def _counts(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode(F.array_distinct("at")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("df"))


def bags(texts: DataFrame, text_col: str = "text", n_buckets: int = BUCKETS, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep``, and of each text its different buckets in order (``at``) and how often each occurs (``times``)."""
    # words are hashed in tasks, where each different one is hashed once, not at every place
    words = F.split(F.lower(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))), r"[^\p{L}\p{Nd}]+")
    rows = texts.select(*[F.col(f"`{c}`") for c in keep], words.alias("__words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {"": -1}
        for whole in batches:
            for first in range(0, whole.num_rows, BAG_ROWS):
                batch = whole.slice(first, BAG_ROWS)
                lists = batch.column(batch.num_columns - 1)
                made = _bagged(_hashed(lists.flatten(), n_buckets, known), np.diff(lists.offsets.to_numpy()), n_buckets)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*keep, "at", "times"])

    schema = T.StructType([*rows.schema.fields[:-1], *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("at", "times")]])
    return rows.mapInArrow(run, schema)


def _hashed(words: pa.StringArray, n: int, known: dict[str, int]) -> np.ndarray:
    """The bucket of each word as :func:`terms` has it; -1 for empty ones, which no text has. ``known``: those of words seen before."""
    coded = words.dictionary_encode()
    if len(known) > KNOWN_WORDS:
        known.clear()
        known[""] = -1
    found = np.empty(len(coded.dictionary), np.int64)
    for i, w in enumerate(coded.dictionary.to_pylist()):
        if (h := known.get(w)) is None:
            h = known[w] = int(hashlib.md5(w.encode()).hexdigest()[:7], 16) % n
        found[i] = h
    return found[coded.indices.to_numpy()]


def _bagged(flat: np.ndarray, lens: np.ndarray, n: int) -> tuple[pa.ListArray, pa.ListArray]:
    """For each list of buckets the different ones and their numbers."""
    cell = np.repeat(np.arange(len(lens)), lens) * n + flat
    cell, times = np.unique(cell[flat >= 0], return_counts=True)
    ends = pa.array(np.searchsorted(cell, np.arange(len(lens) + 1) * n).astype(np.int32))
    return tuple(pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (cell % n, times))


def _rows(ats: pa.ListArray, counts: pa.ListArray, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Weighted rows in chunks: the rows' numbers, where each begins, buckets, weights. Rows without terms are left out."""
    at, times = (x.flatten().to_numpy(zero_copy_only=False) for x in (ats, counts))
    lens = np.diff(ats.offsets.to_numpy())
    rows = np.flatnonzero(lens)
    begins = np.concatenate(([0], np.cumsum(lens[rows])))
    value = (1 + np.log(times)) * idf[at]
    if len(rows):
        value /= np.repeat(np.sqrt(np.add.reduceat(value * value, begins[:-1])), lens[rows])
    first = 0
    while first < len(rows):
        last = min(first + CHUNK_ROWS, max(first + 1, int(np.searchsorted(begins, begins[first] + CHUNK, "right")) - 1), len(rows))
        a, b = begins[first], begins[last]
        yield rows[first:last], begins[first:last] - a, at[a:b], value[a:b]
        first = last


def _dense(begins: np.ndarray, at: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that a chunk uses, and its rows by these alone: with few rows they are few, and a dense product is far quicker than a sparse one."""
    place = np.zeros(n, np.int64)
    place[at] = 1
    used = np.flatnonzero(place)
    place[used] = np.arange(len(used))
    out = np.zeros((len(begins), len(used)))
    out[np.repeat(np.arange(len(begins)), np.diff(begins, append=len(at))), place[at]] = value
    return used, out


def _gram(rows: DataFrame, idf: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The block multiplied by the Gram matrix of the weighted term table."""
    width = block.shape[1]
    names = [f"v{i}" for i in range(width)]
    sent = rows.sparkSession.sparkContext.broadcast((idf, block))  # BUCKETS x (WIDTH + SPARE) numbers

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity, q = sent.value
        total = np.zeros(q.shape)
        for batch in batches:
            for _, begins, at, value in _rows(batch.column(0), batch.column(1), rarity):
                used, x = _dense(begins, at, value, len(rarity))
                total[used] += x.T @ (x @ q[used])
        used = np.flatnonzero(total.any(axis=1))
        yield pa.record_batch([pa.array(used, pa.int32()), *[pa.array(total[used, i]) for i in range(width)]], names=["bucket", *names])

    summed = rows.select("at", "times").mapInArrow(tasks, "bucket int, " + ", ".join(f"{c} double" for c in names)).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names])
    out = np.zeros(block.shape)
    found = summed.toArrow()  # one row a bucket
    out[found.column(0).to_numpy()] = np.stack([found.column(c).to_numpy() for c in names], axis=1)
    sent.destroy()
    return out


@dataclass
class Embedder:
    """The rarity of each bucket and its row of the projection."""

    idf: np.ndarray
    projection: np.ndarray

    def _vectors(self, ats: pa.ListArray, counts: pa.ListArray) -> np.ndarray:
        out = np.zeros((len(ats), self.projection.shape[1]))
        for row, begins, at, value in _rows(ats, counts, self.idf):
            p = np.add.reduceat(self.projection[at] * value[:, None], begins, axis=0)  # sums of a row alone, so that equal texts have equal vectors
            norm = np.sqrt((p * p).sum(axis=1))
            out[row] = p / np.where(norm > 0, norm, 1)[:, None]
        return out.astype(np.float32)

    def embed(self) -> Callable[[Column], Column]:
        """What the analysis takes: text to a vector of floats, of length one or zero."""
        n = len(self.idf)

        @F.pandas_udf("array<float>")
        def vectors(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in lists:
                lists = pa.array(part, pa.list_(pa.int32()))
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                yield pd.Series(list(self._vectors(*_bagged(flat, np.diff(lists.offsets.to_numpy()), n))))

        return lambda text: vectors(terms(text, n))

    def embed_bags(self, rows: DataFrame) -> DataFrame:
        """The other columns of :func:`bags` and ``embedding``: the vectors that :meth:`embed` gives the texts."""
        keep = [c for c in rows.columns if c not in ("at", "times")]
        width = self.projection.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = self._vectors(batch.column("at"), batch.column("times"))
                ends = pa.array(np.arange(0, made.size + 1, width, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.ListArray.from_arrays(ends, pa.array(made.ravel()))], [*keep, "embedding"])

        return rows.mapInArrow(run, T.StructType([*rows.select(*keep).schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]))

    def save(self, spark: SparkSession, path: str) -> None:
        named = [(i, float(w), [float(x) for x in p]) for i, (w, p) in enumerate(zip(self.idf, self.projection))]
        spark.createDataFrame(named, "bucket int, idf double, projection array<double>").coalesce(1).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Embedder:
        rows = spark.read.parquet(path).orderBy("bucket").collect()  # BUCKETS rows
        return Embedder(np.array([r.idf for r in rows]), np.array([r.projection for r in rows]))


def fit(texts: DataFrame, text_col: str = "text", n_buckets: int = BUCKETS, width: int = WIDTH, passes: int = PASSES, flatten: float = FLATTEN, seed: int = 7) -> Embedder:
    """Train on all of ``texts``. Sums of floats depend on the order of tasks in their last digits."""
    held = cut(bags(texts, text_col, n_buckets), "terms")
    model = fit_bags(held, n_buckets, width, passes, flatten, seed)
    drop_cut(held)
    return model


def fit_bags(held: DataFrame, n_buckets: int = BUCKETS, width: int = WIDTH, passes: int = PASSES, flatten: float = FLATTEN, seed: int = 7) -> Embedder:
    """Train on :func:`bags` that are written, as each pass reads them."""
    n = held.count()
    df = np.zeros(n_buckets)
    counts = _counts(held).toArrow()  # one row a bucket
    df[counts.column(0).to_numpy()] = counts.column(1).to_numpy()
    idf = np.log((1 + n) / (1 + df)) + 1
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((n_buckets, min(width + SPARE, n_buckets))))[0]
    for i in range(passes):
        product = _gram(held, idf, block)
        if i + 1 < passes:
            block = np.linalg.qr(product)[0]
    small = block.T @ product
    squares, turn = np.linalg.eigh((small + small.T) / 2)
    lead = np.argsort(-squares)[:width]
    squares, found = squares[lead], block @ turn[:, lead]
    real = squares > max(squares[0], 0) * 1e-9
    found = found * np.sign(found[np.abs(found).argmax(axis=0), np.arange(len(lead))])
    scaled = np.where(real, found / np.where(real, squares, 1) ** (flatten / 2), 0)
    return Embedder(idf, np.pad(scaled, ((0, 0), (0, width - len(lead)))))
