"""Training sets: split, balance, merge and shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritape.functions.text import is_numeric_claim
from veritape.operators.dedup import first_wins


def stable_order(key: Column) -> list[Column]:
    """A shuffle that any engine can repeat: by MD5 of the key, then the key."""
    return [F.md5(key.cast("string")), key]


def smallest(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` first rows in stable order, exactly, without sorting them: rows are counted by the first digits of their hash,
    then those of the one group where the n-th row falls by the next digits, until that group is wanted as a whole.

    A round counts at most 4,096 groups, and about log n / log 4,096 rounds are needed. Rows of equal key are told apart by all
    their columns; of rows that are equal throughout any may go.
    """
    digits = 3
    h = F.concat(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
    rows, low, rest = df.withColumn("__h", h), "", n
    while True:
        inside = rows.where(F.startswith("__h", F.lit(low))) if low else rows
        counts = sorted((r.d, r.m) for r in inside.groupBy(F.substring("__h", len(low) + 1, digits).alias("d")).agg(F.count("*").alias("m")).collect())
        for d, m in counts:
            if rest <= m:
                break
            rest -= m
        else:
            return df  # there are no more than n
        low += d
        last = F.substring("__h", 1, len(low))
        if rest == m:
            return rows.where(last <= low).drop("__h")
        if rest == 0:
            return rows.where(last < low).drop("__h")
        if len(low) >= 64:  # equal rows: so many of them
            return rows.where(last < low).unionByName(rows.where(last == low).limit(rest)).drop("__h")


def balanced(positive: DataFrame, negative: DataFrame, key: str) -> DataFrame:
    """All of the smaller side and as many rows of the other, chosen by stable order."""
    n, m = positive.count(), negative.count()
    pick = lambda df, count: df if count <= min(n, m) else smallest(df, key, min(n, m))
    return pick(positive, n).unionByName(pick(negative, m))


def split_by_score(sentences: DataFrame, score: Column, least: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """(verified, others). Only rows that look numeric are scored: the cheap filter stands in its own branch before the model."""
    likely = sentences.withColumn("is_claim_candidate", is_numeric_claim(F.col("sentence")))
    scored = likely.where("is_claim_candidate").withColumn("__s", score)
    passed = (F.col("__s.label") != 2) & (F.col("__s.confidence") > least)
    drop = ["__s", "is_claim_candidate"]
    others = likely.where("not is_claim_candidate").drop("is_claim_candidate").unionByName(scored.where(~F.coalesce(passed, F.lit(False))).drop(*drop))
    return scored.where(passed).drop(*drop), others


def merge_labelled(claims: DataFrame, others: DataFrame, order: str) -> DataFrame:
    """sentence, label: the union without repeated sentences, a claim before another and then the first, in stable shuffled order."""
    both = claims.select("sentence", F.lit("CLAIM").alias("label"), F.lit(0).alias("__o"), F.col(order).alias("__ord")).unionByName(others.select("sentence", F.lit("NON_CLAIM").alias("label"), F.lit(1).alias("__o"), F.col(order).alias("__ord")))
    return first_wins(both, ["sentence"], [F.asc("__o"), F.asc("__ord")]).select("sentence", "label").orderBy(*stable_order(F.col("sentence")))


def rescued(sentences: DataFrame, claims: DataFrame, likely: Column, key: Column) -> DataFrame:
    """Claims and the likely ones among the rest, the first of equal keys."""
    rest = sentences.withColumn("__k", key).join(claims.withColumn("__k", key).select("__k").distinct(), "__k", "left_anti").where(likely).drop("__k")
    return first_wins(claims.withColumn("__t", F.lit(0)).unionByName(rest.withColumn("__t", F.lit(1)), allowMissingColumns=True).withColumn("__k", key), ["__k"], [F.asc("__t"), F.asc("sentence")]).drop("__t", "__k")
