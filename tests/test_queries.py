"""Each query against its SQL equivalent in DuckDB, over whole tables."""

import os

import duckdb
import pytest

from veritape.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def normal(v):
    return tuple(normal(x) for x in v) if isinstance(v, (list, tuple)) else repr(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(normal(r[c]) for c in columns) for r in df.collect())
    found = duck.sql(registry.ORACLES[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert got == sorted(tuple(normal(r[i]) for i in at) for r in found.fetchall())


def test_rows_only(spark):
    assert registry.QUERIES["model_claim_filter"](spark, SF).count() > 0
    best = registry.QUERIES["fuzzy_similar"](spark, SF).collect()
    import difflib

    names = [r.n_name for r in spark.read.parquet(f"{SF}/nation.parquet").collect()]
    want = difflib.get_close_matches("natoin-7", [n.lower() for n in sorted(names)], n=1, cutoff=0.5)
    assert [r.n_name.lower() for r in best] == want


def test_queries_in_blocks(spark):
    from veritape.operators.retrieval import batch_top_k

    v = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 200").select("vec_id", "embedding")
    q = v.where("vec_id % 10 = 0").selectExpr("vec_id query_id", "embedding query")
    whole, parts = batch_top_k(v, q, 3, "vec_id"), batch_top_k(v, q, 3, "vec_id", max_queries=8)
    assert parts.columns == whole.columns and whole.count() == 3 * q.count() > 24
    assert sorted(map(str, parts.collect())) == sorted(map(str, whole.collect()))
