"""The wide quarterly series: pivot, forward fill, margin and change features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritape.functions import vocab as V
from veritape.functions.numbers import null_if_nan, pct_change
from veritape.functions.quarters import sort_key


def pivot_metrics(facts: DataFrame, keys: tuple[str, str] = ("company", "quarter"), sources: dict[str, list[str]] | None = None) -> DataFrame:
    """Long to wide: each target column is the greatest value of the first source metric present. One aggregate, combined map-side."""
    sources = sources or V.PIVOT_SOURCES
    names = [m for ms in sources.values() for m in ms]
    wide = facts.groupBy(*keys).agg(*[F.max(F.when(F.col("metric") == m, null_if_nan(F.col("value")))).alias(f"__{m}") for m in names])
    return wide.select(*keys, *[F.coalesce(*[F.col(f"__{m}") for m in ms]).alias(t) for t, ms in sources.items()])


def _timed(df: DataFrame, quarter: str) -> DataFrame:
    """``df`` with the order of its quarters as columns: windows over equal columns share one sort, those over a computed key sort again each."""
    key = sort_key(F.col(quarter))
    return df.withColumns({"__y": key.y, "__q": key.q})


def _time(company: str, quarter: str) -> Window:
    return Window.partitionBy(company).orderBy("__y", "__q", quarter)


def _filled(timed: DataFrame, columns: list[str], company: str, quarter: str) -> DataFrame:
    w = _time(company, quarter).rowsBetween(Window.unboundedPreceding, 0)
    return timed.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def forward_fill(df: DataFrame, columns: list[str], company: str = "company", quarter: str = "quarter") -> DataFrame:
    return _filled(_timed(df, quarter), columns, company, quarter).drop("__y", "__q")


def features(wide: DataFrame, company: str = "company", quarter: str = "quarter", infinite: bool = False) -> DataFrame:
    """Forward-filled series with profit_margin and, per column, change to the row before and to four rows before: rows, not calendar quarters."""
    base = [c for c in V.SERIES_COLUMNS if c != "profit_margin"]
    filled = _filled(_timed(wide, quarter), base, company, quarter).withColumn("profit_margin", F.try_divide("net_profit", "revenue") * 100)
    w = _time(company, quarter)

    def lagged(c: str, n: int) -> Column:
        return F.lag(c, n).over(w)

    new: dict[str, Column] = {}
    for c in V.SERIES_COLUMNS:
        new[f"{c}_qoq_change"] = pct_change(F.col(c), lagged(c, 1), infinite)
        new[f"{c}_qoq_abs_change"] = F.col(c) - lagged(c, 1)
        new[f"{c}_yoy_change"] = pct_change(F.col(c), lagged(c, 4), infinite)
    return filled.withColumns(new).drop("__y", "__q")


def present_columns(series: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """For each scope (or all) which series columns hold any value: what decides whether a claim's metric counts as mapped."""
    flags = [(F.count(c) > 0).alias(f"has_{c}") for c in V.SERIES_COLUMNS]
    return series.groupBy(*scope).agg(*flags) if scope else series.agg(*flags)


def latest(df: DataFrame, scope: list[str], quarter: str = "quarter") -> DataFrame:
    """The row of the greatest quarter text per scope."""
    rest = [c for c in df.columns if c not in scope]
    return df.groupBy(*scope).agg(F.max_by(F.struct(*rest), F.col(quarter)).alias("__r")).select(*scope, "__r.*")
