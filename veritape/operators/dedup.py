"""First-wins and last-wins deduplication, and the set operations built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``, which should be total. Null keys are a key."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    w = Window.partitionBy(*cols).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last in ``order``: a map-side combined maximum instead of a sort."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return best.select(*keys, "__r.*").select(*df.columns)


def anti_remainder(left: DataFrame, right: DataFrame, key_left: Column, key_right: Column) -> DataFrame:
    """Rows of ``left`` whose key isn't in ``right``. Null keys stay."""
    r = right.select(key_right.alias("__k")).where("__k is not null").distinct()
    return left.withColumn("__lk", key_left).join(r, F.col("__lk") == F.col("__k"), "left_anti").drop("__lk")


def first_nonempty(tiers: list[DataFrame], scope: list[str] | None = None) -> DataFrame:
    """All rows of the first non-empty frame, as a whole or for each ``scope`` key."""
    parts = [t.withColumn("__tier", F.lit(i)) for i, t in enumerate(tiers)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    if scope is None:
        best = rows.agg(F.min("__tier").alias("__best"))
        return rows.join(F.broadcast(best), F.col("__tier") == F.col("__best")).drop("__tier", "__best")
    best = rows.groupBy(*scope).agg(F.min("__tier").alias("__best"))
    return rows.join(best, scope).where("__tier = __best").drop("__tier", "__best")
