"""As-of left join with two fallbacks, and the tier that gave each match."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_with_fallback(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str | None = None) -> DataFrame:
    """Each row of ``left`` with ``match`` (struct of the right row, null if none) and ``match_type``.

    Per key: the row of the same ``at``, else the greatest one not after it, else the greatest of all; order is that of text.
    ``right`` is unique in (key, right_at). The match depends on (key, at) only, so it is found once
    for each distinct pair, which a map-side combined aggregate leaves: pairs and right rows go in one
    stream per key and the last right row is carried forward. The join back is on both columns, so a
    key with very many left rows spreads over its quarters, and adaptive execution broadcasts a small
    match table or splits a skewed partition.
    """
    right_at = right_at or at
    fields = [c for c in right.columns if c != key]
    r = right.select(F.col(key).alias("__k"), F.col(right_at).alias("__t"), F.lit(0).alias("__side"), F.struct(*fields).alias("__r"))
    pairs = left.select(F.col(key).alias("__k"), F.col(at).alias("__t")).distinct().withColumn("__side", F.lit(1))
    both = pairs.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy("__k").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__prev", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    top = r.groupBy("__k").agg(F.max_by("__r", "__t").alias("__top")).select(F.col("__k").alias("__tk"), "__top")
    found = seen.join(top, F.col("__k") == F.col("__tk"), "left")
    kind = (
        F.when(F.col("__prev")[right_at] == F.col("__t"), "EXACT_MATCH")
        .when(F.col("__prev").isNotNull(), "FALLBACK_PREV_QUARTER")
        .when(F.col("__top").isNotNull(), "FALLBACK_LATEST")
        .otherwise("NO_COMPANY_DATA")
    )
    matched = found.select("__k", "__t", F.coalesce("__prev", "__top").alias("match"), kind.alias("match_type"))
    out = left.join(matched, left[key].eqNullSafe(F.col("__k")) & left[at].eqNullSafe(F.col("__t")))
    return out.select(*[left[c] for c in left.columns], "match", "match_type")
