"""What the corpus operators share: Arrow maps, span digests and connected components."""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from veritape.session import cut, drop_cut  # noqa: F401

BATCH_ROWS = 1000


def arrow_map(df: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema: str) -> DataFrame:
    """Apply ``rows`` to each Arrow batch of ``df``; memory is that of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = rows(batch)
                yield from out.to_batches() if isinstance(out, pa.Table) else (out,)

    return df.mapInArrow(run, schema)


def measured_cut(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
    """:func:`cut`, and aggregates over the rows that it wrote: taken as they are written, so no job reads them again for it.

    Every job costs the driver a plan, its compiled code and its history, so an operator of many steps counts this way.
    """
    seen = Observation()
    out = cut(df.observe(seen, *[c.alias(k) for k, c in measures.items()]), name)
    found = seen.get
    if set(measures) - set(found):  # a plan that was found to be empty as it ran observes nothing
        found = out.agg(*[c.alias(k) for k, c in measures.items()]).first().asDict()
    return out, {k: found[k] for k in measures}


def counted_cut(df: DataFrame, name: str) -> DataFrame:
    """:func:`cut` of a table that knows its number of rows: see :func:`rows_of`."""
    out, found = measured_cut(df, name, n=F.count(F.lit(1)))
    out._veritape_rows = found["n"]
    return out


def rows_of(df: DataFrame) -> int:
    """Rows of a table: without a job if :func:`counted_cut` wrote it, else counted once."""
    if not hasattr(df, "_veritape_rows"):
        df._veritape_rows = df.count()
    return df._veritape_rows


def release() -> None:
    """Give memory that a worker no longer uses back to the system: Spark keeps its Python workers from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def spent(df: DataFrame) -> None:
    """After a step of several jobs in the session of ``df``: its broadcasts, plans and shuffles leave the driver.

    Spark keeps them until the driver's JVM happens to collect its garbage, and the heap grows instead as long as it may,
    by the tables of all steps so far. Results don't depend on it.
    """
    gc.collect()  # Python's references hold theirs in the JVM
    df.sparkSession._jvm.System.gc()


def short_batches(df: DataFrame) -> DataFrame:
    """``df``; its session sends ``BATCH_ROWS`` rows an Arrow batch from now on, unless it was set to other than Spark's default.

    Texts are long: the default of 10,000 rows takes tens of MB in the JVM and again in each Python worker.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key) == "10000":
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


def texts_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id (as long) and the text, under names of our own: extra columns can't clash."""
    return short_batches(df).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def span_text(spans: list[tuple[int, int, int]], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then by the kinds' order, comma-joined. Spans are (start, kind index, end)."""
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans))


def sha256_hex(x: str | bytes) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def pack(*arrays: np.ndarray | bytes, level: int = 3) -> bytes:
    """Arrays and byte strings, each with its type and length; integers are stored byte plane by byte plane."""
    head, body = [], []
    for a in arrays:
        if isinstance(a, bytes):
            head.append(f"b{len(a)}")
            body.append(a)
        else:
            head.append(f"{a.dtype.str[1:]}:{len(a)}")
            body.append(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(level=level).compress(";".join(head).encode() + b"\n" + b"".join(body))


def unpack(data: bytes) -> list:
    data = zstandard.ZstdDecompressor().decompress(data)
    at = data.index(b"\n")
    head, at, out = data[:at].decode().split(";"), at + 1, []
    for h in head:
        if h[0] == "b":
            out.append(data[at : at + int(h[1:])])
            at += int(h[1:])
        else:
            kind, n = h.split(":")
            size = int(kind[1:]) * int(n)
            out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, size, at).reshape(int(kind[1:]), -1).T).view(f"<{kind}").ravel())
            at += size
    return out


def bounded_sample(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """At most ``most`` rows of a written table, those of least hash of ``keys``.

    The rows are thinned by hash before they are ordered, so all tasks together send little more than ``most``; if keys
    repeat so much that too few are left, the others are ordered too.
    """
    h = F.pmod(F.xxhash64(*keys), F.lit(1 << 30))
    n = df.count()
    rows = df.withColumn("__h", h)
    if n > 2 * most:
        thin = rows.where(F.col("__h") < int((1 << 30) * min(1.0, 1.5 * most / n)))
        rows = thin if thin.count() >= most else rows
    return rows.orderBy("__h", *keys).limit(most).drop("__h")


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(id, component_id) of every id in ``edges`` (a, b: long); component_id is the smallest id reachable.

    Alternating large-star and small-star rounds over a written edge table. No step gathers a
    node's neighbours: each is a map-side combined minimum and a join that adaptive execution may
    split. A round at most doubles how far a minimum travels, so rounds grow with the logarithm of
    the longest path. An empty table gives an empty result; self links and repeated links are ignored.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    measures = {"n": F.count(F.lit(1)), "total": F.sum(F.col("v").cast("decimal(38,0)")), "mixed": F.bit_xor(F.xxhash64("u", "v"))}
    now, stats = measured_cut(e, name, **measures)
    before = None
    while stats != before and stats["n"]:
        before = stats
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low2, "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low2.select("u", F.col("m").alias("v")))
        after, stats = measured_cut(small.where("u <> v").distinct(), name, **measures)
        drop_cut(now)
        now = after
    # at the fixed point each u has one v, the root
    return now.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionAll(
        now.select(F.col("v").alias("id"), F.col("v").alias("component_id"))
    ).groupBy("id").agg(F.min("component_id").alias("component_id"))
