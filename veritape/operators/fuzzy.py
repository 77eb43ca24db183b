"""Three-tier company lookup: exact, substring, similarity."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CUTOFF = 0.5


@F.pandas_udf(T.DoubleType())
def gestalt_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of ``a`` (a candidate) to ``b`` (what is looked for), in this order: it isn't symmetric. Built-in edit distances are other measures, so this runs in Arrow batches."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def lookup(candidates: DataFrame, names: list[str], order: str, query: str, similar: list[str] | None = None, cutoff: float = CUTOFF, both_ways: bool = False) -> DataFrame:
    """The best candidate as one row with ``tier`` (1 exact, 2 substring, 3 similar) and ``score``, or none.

    ``names`` are name columns, matched in lower case; ties go to the first in ``order``, but among equally similar names to
    the greatest name. With ``both_ways`` a name inside the query is a substring match too. Similarity is computed only
    for rows without a better tier, and only over ``similar`` columns.
    """
    q = F.lit(query.strip().lower())
    low: list[Column] = [F.lower(n) for n in names]
    exact = low[0] == q
    part = F.contains(low[0], q)
    for c in low[1:]:
        exact, part = exact | (c == q), part | F.contains(c, q)
    if both_ways:
        for c in low:
            part = part | F.contains(q, c)
    tiers = candidates.withColumn("tier", F.when(exact, 1).when(part, 2))
    best = tiers.where("tier is not null").withColumn("score", F.lit(1.0)).orderBy("tier", order).limit(1)
    ratios = [F.struct(gestalt_ratio(F.lower(n), q).alias("r"), F.lower(n).alias("n")) for n in (similar or names)]
    scored = tiers.where("tier is null").withColumn("__best", F.greatest(*ratios) if len(ratios) > 1 else ratios[0]).withColumn("score", F.col("__best.r"))
    near = scored.where(F.col("score") >= cutoff).withColumn("tier", F.lit(3)).orderBy(F.desc("score"), F.desc("__best.n"), order).limit(1).drop("__best")
    return best.unionByName(near).orderBy("tier").limit(1)
