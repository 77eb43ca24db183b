"""The trained embedder."""

import collections
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from veritape.models import hashed_embedding
from veritape.operators import embedder

TOPICS = [[f"t{t}w{i}" for i in range(40)] for t in range(12)]


@pytest.fixture(scope="module")
def trained(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choices(TOPICS[i % 12], k=14) + rng.choices(["the", "of", "and", "to"], k=10)).capitalize() + ".") for i in range(600)]
    rows += [(1000, None), (1001, ""), (1002, "?! --"), (1003, rows[0][1]), (1004, "the " * 60000 + TOPICS[3][0]), (1005, "ÜBER straße 東京 42"), (1006, "neverseen")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    return df, embedder.fit(df, n_buckets=1024, width=16)


def vectors(df, embed):
    return {r.id: np.array([np.nan if x is None else x for x in r.v]) for r in df.select("id", embed(F.col("text")).alias("v")).collect()}


def test_equals_dense(spark, trained, tmp_path):
    """The projection against a dense decomposition, and the vectors in SQL from the stored weights."""
    df, model = trained
    lists = {r.id: r.at for r in df.select("id", embedder.terms(F.col("text"), 1024).alias("at")).collect()}
    x = np.zeros((len(lists), 1024))
    for i, at in enumerate(lists.values()):
        for b in at:
            x[i, b] += 1
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1
    assert np.allclose(idf, model.idf)
    x = np.where(x > 0, 1 + np.log(np.maximum(x, 1)), 0) * idf
    x /= np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-300)[:, None]
    s = np.linalg.svd(x, compute_uv=False)[:16]
    p = model.projection * s**embedder.FLATTEN  # undoes the flattening
    assert np.allclose(np.linalg.norm(x @ p, axis=0)[:11], s[:11], rtol=1e-2)  # the themes' components are found
    assert np.abs(p.T @ p - np.eye(16)).max() < 0.2
    model.save(spark, str(tmp_path / "m"))
    again = embedder.Embedder.load(spark, str(tmp_path / "m"))
    assert (again.idf == model.idf).all() and (again.projection == model.projection).all()
    df.write.parquet(str(tmp_path / "rows"))
    sql = f"""WITH w AS (SELECT * FROM '{tmp_path}/m/*.parquet'), t AS (SELECT id, CAST('0x' || substr(md5(w), 1, 7) AS INTEGER) % 1024 AS bucket, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{Nd}}]+')) AS w FROM '{tmp_path}/rows/*.parquet') GROUP BY ALL),
     v AS (SELECT id, i, sum((1 + ln(n)) * idf * projection[i]) AS x FROM t JOIN w USING (bucket), range(1, 17) r(i) GROUP BY id, i)
     SELECT id, i, x / nullif(sqrt(sum(x * x) OVER (PARTITION BY id)), 0) AS x FROM v ORDER BY id, i"""
    got = vectors(df, again.embed())
    want = {}
    for i, _, v in duckdb.sql(sql).fetchall():
        want.setdefault(i, []).append(v or 0.0)
    assert len(want) == 604
    for i, v in got.items():
        assert np.allclose(v, want.get(i, np.zeros(16)), atol=1e-5), i


def test_odd_texts(trained):
    df, model = trained
    got = vectors(df, model.embed())
    for i in (1000, 1001, 1002):
        assert not got[i].any()
    assert (got[1003] == got[0]).all()
    assert all(abs(np.linalg.norm(v) - 1) < 1e-5 for i, v in got.items() if i < 1000)


def test_questions_find_their_theme(spark, trained):
    """Questions that share no word with most texts of their theme: the learned space knows the theme, word hashes don't."""
    df, model = trained
    rng = random.Random(5)
    asked = spark.createDataFrame([(t, "What of " + " and ".join(rng.sample(TOPICS[t], 2)) + "?") for t in range(12)], "id long, text string")

    def right(embed):
        texts, questions = vectors(df.where("id < 600"), embed), vectors(asked, embed)
        ids = np.array(sorted(texts))
        table = np.stack([texts[i] for i in ids])
        return np.mean([(ids[np.argsort(-(table @ q), kind="stable")[:30]] % 12 == t).mean() for t, q in questions.items()])

    learned, hashed = right(model.embed()), right(hashed_embedding)
    assert learned > 0.9 and learned > hashed + 0.2


def test_few_texts(spark):
    none = embedder.fit(spark.createDataFrame([], "text string, id long"), n_buckets=64, width=8)
    assert not none.projection.any() and none.projection.shape == (64, 8)
    few = spark.createDataFrame([(1, "a b c", 5), (2, "c d", 6), (3, None, 7)], "id long, text string, at int")
    model = embedder.fit(few, n_buckets=64, width=8)
    assert (np.abs(model.projection).max(axis=0) > 0).sum() == 2  # as many components as independent texts
    assert {i: bool(v.any()) for i, v in vectors(few, model.embed()).items()} == {1: True, 2: True, 3: False}
    wide = embedder.fit(few, n_buckets=4, width=8)
    assert wide.projection.shape == (4, 8)


def test_hashed_embedding(spark):
    """The stand-in: signed hashes of the different words, of length one; nulls where there is no word."""
    df = spark.createDataFrame([(1, "b a b"), (2, "a, B"), (3, "--"), (4, None)], "id long, text string")
    h = {r.w: r.h for r in spark.createDataFrame([("a",), ("b",)], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    want = np.zeros(64)
    for x in h.values():
        want[x % 64] += 1 if (x >> 33) % 2 == 0 else -1
    got = {r.id: r.v for r in df.select("id", hashed_embedding(F.col("text")).alias("v")).collect()}
    assert np.allclose(got[1], want / np.linalg.norm(want)) and got[1] == got[2]
    assert got[3] == [None] * 64


def test_bags_give_the_same_vectors(spark, trained):
    df, model = trained
    rows = embedder.bags(df, n_buckets=1024, keep=("id",))
    assert rows.columns == ["id", "at", "times"]
    hashed = {r.id: collections.Counter(r.at) for r in df.select("id", embedder.terms(F.col("text"), 1024).alias("at")).collect()}
    for r in rows.collect():
        assert r.at == sorted(r.at) and dict(zip(r.at, r.times, strict=True)) == hashed[r.id]
    one, other = vectors(df, model.embed()), {r.id: np.array(r.embedding) for r in model.embed_bags(rows).collect()}
    assert one.keys() == other.keys() and all((one[i] == other[i]).all() for i in one)


def test_products_of_chunks(trained, spark, monkeypatch):
    """The Gram product by dense chunks of rows against one of all rows, with rows that are empty or longer than a chunk."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    lists = [sorted(rng.choice(50, size=k, replace=False).tolist()) for k in (0, 3, 40, 1, 0, 12, 50, 7, 0)]
    times = [[int(t) for t in rng.integers(1, 9, len(x))] for x in lists]
    idf, q = rng.random(50) + 1, rng.standard_normal((50, 6))
    x = np.zeros((len(lists), 50))
    for i, (at, n) in enumerate(zip(lists, times)):
        x[i, at] = (1 + np.log(n)) * idf[at]
    x /= np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    for rows, chunk in ((64, 1 << 15), (2, 1 << 15), (64, 20), (1, 1)):
        monkeypatch.setattr(embedder, "CHUNK_ROWS", rows)
        monkeypatch.setattr(embedder, "CHUNK", chunk)
        total, seen = np.zeros((50, 6)), []
        for row, begins, at, value in embedder._rows(pa.array(lists, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32())), idf):
            assert len(row) <= rows and (len(at) <= chunk or len(row) == 1)
            used, part = embedder._dense(begins, at, value, 50)
            total[used] += part.T @ (part @ q[used])
            seen += row.tolist()
        assert seen == [1, 2, 3, 5, 6, 7] and np.allclose(total, x.T @ (x @ q))
