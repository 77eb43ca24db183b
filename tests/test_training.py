"""Exact samples and the trained classifier."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from veritape.models import model_claims, probability
from veritape.operators import classifier, dataset

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("n", [0, 1, 2, 50, 999, 1499, 1500, 4000])
def test_smallest(spark, n):
    df = spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey", "c_name")
    want = [r.c_custkey for r in df.orderBy(*dataset.stable_order(F.col("c_custkey"))).limit(n).collect()]
    found = dataset.smallest(df, "c_custkey", n)
    assert sorted(r.c_custkey for r in found.collect()) == sorted(want)
    plan = found._jdf.queryExecution().toString()
    assert "TakeOrdered" not in plan and "Limit" not in plan and "SinglePartition" not in plan


def test_smallest_repeats(spark):
    df = spark.createDataFrame([(1, "a")] * 30 + [(2, None)] * 5 + [(None, "x"), (1, "b")], "k long, v string")
    for n in (0, 3, 20, 36, 37, 99):
        assert dataset.smallest(df, "k", n).count() == min(n, 37)
    assert dataset.smallest(df.limit(0), "k", 3).count() == 0
    assert dataset.balanced(df.where("k = 1"), df.where("k = 2"), "k").groupBy("k").count().orderBy("k").collect() == [(1, 5), (2, 5)]


@pytest.fixture(scope="module")
def trained(spark):
    rng = random.Random(3)
    good, bad = "revenue profit margin growth demand increased".split(), "thank you question operator please next".split()
    rows = []
    for i in range(900):
        y = i % 3 == 0
        words = [rng.choice(good if rng.random() < (0.8 if y else 0.25) else bad) for _ in range(rng.randrange(3, 12))]
        rows.append((i, " ".join(words).capitalize() + ".", int(y)))
    rows += [(2000, None, 1), (2001, "", 0), (2002, "12 %", None), (2003, rows[0][1], None)]
    df = spark.createDataFrame(rows, "id long, text string, label int")
    return df, classifier.fit(df, n_buckets=512)


def test_classifier(spark, trained, tmp_path):
    df, model = trained
    scored = df.where(classifier.fold(F.col("text")) == 0).withColumn("score", model.probability(F.col("text")))
    got = classifier.evaluate(scored).first()
    assert got.accuracy > 0.85 and got.f1 > 0.78 and got.brier < 0.12 and got.n > 50
    mean = scored.where("label is not null").agg(F.avg("score"), F.avg("label")).first()
    assert abs(mean[0] - mean[1]) < 0.1  # calibrated
    model.save(spark, str(tmp_path / "m"))
    again = classifier.Classifier.load(spark, str(tmp_path / "m"))
    assert again == model
    # the scores again in SQL, from the stored weights
    df.write.parquet(str(tmp_path / "rows"))
    duck = duckdb.connect()
    sql = f"""
    with w as (select * from '{tmp_path}/m/*.parquet'), rows as (select id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') as t from '{tmp_path}/rows/*.parquet'),
    terms as (select id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) as term from rows),
    placed as (select distinct id, (('0x' || md5(term)[1:7])::bigint % 512)::int as bucket from terms),
    m as (select id, sum(weight) / sqrt(count(*)) as m from placed join w using (bucket) group by id)
    select id, 1 / (1 + exp(-((coalesce(m, 0) + (select weight from w where bucket = -1)) * (select weight from w where bucket = -2) + (select weight from w where bucket = -3)))) as score from rows left join m using (id)"""
    want = dict(duck.sql(sql).fetchall())
    found = {r.id: r.score for r in df.withColumn("score", again.probability(F.col("text"))).collect()}
    assert found.keys() == want.keys() and all(math.isclose(found[k], want[k], rel_tol=1e-9) for k in want)
    soft = df.select("id", probability(model.logits()(F.col("text"))).alias("p")).collect()
    assert all(math.isclose(r.p, found[r.id], rel_tol=1e-9) for r in soft)


def test_classifier_in_the_analysis(spark, trained):
    df, model = trained
    rows = df.select(F.lit("c").alias("company"), F.lit("2024-Q1").alias("quarter"), F.col("text").alias("sentence"), "id")
    kept = model_claims(rows, model.logits(), order=["id"], threshold=0.6).collect()
    assert kept and all(r.confidence >= 0.6 for r in kept)


def test_gradient(spark, trained):
    """One sum over all tasks against plain numbers."""
    import numpy as np

    rows = spark.createDataFrame([(1.0, [0, 2]), (0.0, [1]), (1.0, [])], "y double, at array<int>").repartition(3)
    w, bias = np.array([0.5, -1.0, 2.0, 0.0]), 0.25
    g, free = classifier._gradient(rows, w, bias)
    want, residuals = np.zeros(4), 0.0
    for y, at in ((1, [0, 2]), (0, [1]), (1, [])):
        v = 1 / math.sqrt(max(len(at), 1))
        r = 1 / (1 + math.exp(-(sum(w[i] * v for i in at) + bias))) - y
        residuals += r
        for i in at:
            want[i] += r * v
    assert np.allclose(g, want) and math.isclose(free, residuals)


def test_classifier_edges(spark):
    one = spark.createDataFrame([("good text", 1), ("more text", 1)], "text string, label int")
    assert set(classifier.fit(one, n_buckets=8).weights) == {0.0}
    empty = classifier.fit(one.limit(0), n_buckets=8)
    assert empty.bias == 0.0 and one.select(empty.probability(F.col("text")).alias("p")).first().p == 0.5


def test_quality_on_the_tables(spark):
    from veritape.plans import registry

    got = registry.QUERIES["classifier_quality"](spark, SF).first()
    print(got)
    assert got.n > 2000 and got.accuracy > 0.9 and got.f1 > 0.9
