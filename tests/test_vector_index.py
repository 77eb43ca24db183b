"""The vector index against a scan."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritape.operators import retrieval
from veritape.operators.vector_index import NO_CELL, VectorIndex, recall

SCHEMA = "id long, company string, embedding array<float>, node string"


def points(seed=3, n=600, width=8):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, width)) * 4
    rows = [(i, f"c{i % 5}", [float(x) for x in centers[i % 12] + rng.normal(size=width) * 0.3], "clash") for i in range(n)]
    rows += [(n + i, "c0", rows[0][2], "copy") for i in range(40)]  # a tight group of equal vectors
    rows += [(9001, "c0", None, None), (9002, "c0", [1.0] * 3, None), (9003, "c0", [float("nan")] * width, None), (9004, "c0", [1.0] * (width - 1) + [None], None), (9005, "c0", [], None), (9006, "c1", [float("inf")] + [0.0] * (width - 1), None)]
    return rows


def brute(rows, q, k, keep=lambda r: True):
    def dist(v):
        return sum((float(np.float32(a)) - b) ** 2 for a, b in zip(v, q, strict=True))

    good = [r for r in rows if r[2] is not None and len(r[2]) == len(q) and None not in r[2] and np.isfinite(r[2]).all() and keep(r)]
    return [r[0] for r in sorted(good, key=lambda r: (round(dist(r[2]), 9), r[0]))[:k]]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rows = points()
    df = spark.createDataFrame(rows, SCHEMA)
    return rows, df, VectorIndex.build(df, str(tmp_path_factory.mktemp("index") / "a"), sort=("company",))


def test_equals_scan(built):
    rows, df, index = built
    rng = np.random.default_rng(9)
    for q in [[float(x) for x in rows[5][2]], [0.0] * 8, [float(x) for x in rng.normal(size=8) * 4]]:
        for k in (1, 7, 60, 5000):
            assert [r.id for r in index.top_k(q, k).collect()] == brute(rows, q, k)
        got = [r.id for r in index.top_k(q, 9, F.col("company") == "c3").collect()]
        assert got == brute(rows, q, 9, lambda r: r[1] == "c3")
        assert [r.id for r in retrieval.top_k(df.where("id < 9000"), q, 9).collect()] == brute(rows, q, 9)
    assert index.top_k(rows[5][2], 3).columns == [*df.columns, "distance"]
    assert index.top_k(rows[5][2], 3, F.col("company") == "none").count() == 0
    with pytest.raises(ValueError):
        index.top_k([1.0], 3)


def test_reads_few_cells(built):
    rows, _, index = built
    plan = index.top_k(rows[5][2], 5)._jdf.queryExecution().toString()
    scan = plan[plan.index("FileScan parquet") :]
    read = re.search(r"PartitionFilters: \[.*?ivf_cell#\d+ (?:IN|INSET) \(?([\d, ]+)|PartitionFilters: \[.*?\(ivf_cell#\d+ = (\d+)", scan)
    assert read and 0 < len((read[1] or read[2]).split(",")) < len(index.cells) / 3
    assert "ivf_radius" in scan[scan.index("PushedFilters") :]
    assert len(index.cells) == index.rows().where("ivf_cell >= 0").select("ivf_cell").distinct().count()
    assert index.rows().where(f"ivf_cell = {NO_CELL}").count() == 6


def test_batch_append_and_recall(spark, built, tmp_path):
    rows, df, whole = built
    index = VectorIndex.build(df.where("id % 4 <> 2"), str(tmp_path / "b"), cells=20).append(df.where("id % 4 = 2"))
    assert index.rows().count() == len(rows) and int(index.n.sum()) == index.rows().where("ivf_cell >= 0").count()
    queries = df.where("id % 10 = 0 or id > 9000").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    want = {r[0]: brute(rows, r[2], 6) for r in rows if r[0] % 10 == 0 and r[0] < 9000}

    def lists(found):
        out = {}
        for r in found.orderBy("query_id", "rank").collect():
            out.setdefault(r.query_id, []).append(r.id)
        return out

    assert lists(index.batch_top_k(queries, 6)) == want
    import veritape.operators.vector_index as module

    before, module.PAIRS = module.PAIRS, 200
    try:
        assert lists(whole.batch_top_k(queries, 6)) == want
    finally:
        module.PAIRS = before
    assert 1 <= index.calibrate(0.95) <= len(index.cells) and VectorIndex(spark, index.path).probes() == index.probes()
    exact = index.batch_top_k(queries, 6)
    got = recall(index.batch_top_k(queries, 6, probes=index.probes()), exact.select("query_id", "id"), "id")
    assert got.agg(F.avg("recall")).first()[0] >= 0.9 and got.count() == len(want)


def test_empty(spark, tmp_path):
    none = VectorIndex.build(spark.createDataFrame([], SCHEMA), str(tmp_path / "c"))
    assert none.top_k([1.0, 2.0], 3).count() == 0 and none.rows().count() == 0
    with pytest.raises(ValueError):
        none.append(spark.createDataFrame(points(n=4), SCHEMA))
    bad = VectorIndex.build(spark.createDataFrame([(1, "a", None, None)], SCHEMA), str(tmp_path / "d"))
    assert bad.top_k([1.0], 3).count() == 0 and bad.rows().count() == 1
    one = VectorIndex.build(spark.createDataFrame([(1, "a", [1.0, 2.0], None), (2, "a", [1.0, 2.0], None)], SCHEMA), str(tmp_path / "e"))
    assert [r.id for r in one.top_k([0.0, 0.0], 3).collect()] == [1, 2]
    queries = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, query array<double>")
    assert none.batch_top_k(queries, 3).count() == 0 and one.batch_top_k(queries, 3).count() == 2


def test_recall_on_the_tables(spark):
    from veritape.plans import registry

    found = registry.QUERIES["vector_index_recall"](spark, "/root/testdata/sf0.01").agg(F.avg("recall"), F.count("*")).first()
    assert found[0] >= 0.9 and found[1] == 5


def test_block_search_passes_on_few_rows(spark):
    """Tasks pass on a small share of the pairs, with the distances of a scan to the last bit; odd vectors come last."""
    import math

    from pyspark.sql import functions as F

    from veritape.operators.nearest import matrix, nearest
    from veritape.operators.retrieval import batch_top_k

    rng = random.Random(3)
    made = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(made + made[:5])), "id long, embedding array<double>").coalesce(2)
    queries = rows.where("id < 40").selectExpr("id query_id", "embedding query")
    ids, q = matrix(queries, "query_id", "query", 8)
    assert nearest(rows, ids, q, 3, "id", "embedding", queries.schema["query_id"].dataType).count() <= 40 * 3 * 2
    got = {(r.query_id, r["rank"]): (r.id, r.distance) for r in batch_top_k(rows, queries, 3).collect()}
    for query, (i, v) in zip(ids.to_pylist(), enumerate(q.tolist())):
        scan = sorted((sum_of(v, x), n) for n, x in enumerate(made + made[:5]))[:3]
        assert [got[query, k + 1] for k in range(3)] == [(n, d) for d, n in scan]
    odd = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [math.nan, 0.0]), (5, [math.inf, 0.0])], "id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "query_id long, query array<double>")
    found = {(r.query_id, r["rank"]): r.id for r in batch_top_k(odd, asked, 5).collect()}
    assert [found[1, k] for k in range(1, 6)] == [1, 5, 4, 2, 3] and [found[2, k] for k in range(1, 6)] == [1, 2, 3, 4, 5]
    assert batch_top_k(odd, asked.where(F.lit(False)), 5).count() == 0


def test_block_search_passes_on_as_few_rows_of_short_batches(spark):
    """A session that sends fewer rows an Arrow batch gets the same rows: operators over texts set it so."""
    from veritape.operators.nearest import matrix, nearest

    rng = random.Random(4)
    rows = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(3000)], "id long, embedding array<double>").coalesce(1)
    queries = rows.where("id < 40").selectExpr("id query_id", "embedding query")
    ids, q = matrix(queries, "query_id", "query", 8)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, got = spark.conf.get(key), []
    try:
        for n in ("10000", "100"):
            spark.conf.set(key, n)
            got.append(sorted((r.query_id, r.id, r.distance) for r in nearest(rows, ids, q, 3, "id", "embedding", queries.schema["query_id"].dataType).collect()))
    finally:
        spark.conf.set(key, before)
    assert got[0] == got[1] and len(got[0]) == 120


def sum_of(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += (y - x) * (y - x)
    return total
