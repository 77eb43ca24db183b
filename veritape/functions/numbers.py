"""Numeric expressions: change, scaling, rounding families, verdicts and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritape.functions import vocab as V
from veritape.functions.text import _let as let


def null_if_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def number(c: Column) -> Column:
    """A double, or null where the text is no number (or is NaN)."""
    return null_if_nan(c.try_cast("double"))


def pct_change(now: Column, before: Column, infinite: bool = False) -> Column:
    """(now - before) / before * 100; a zero base gives null, or with ``infinite`` a signed infinity (null for 0/0)."""
    change = F.try_divide(now - before, before) * 100
    if not infinite:
        return change
    return F.when((before == 0) & (now > 0), F.lit(float("inf"))).when((before == 0) & (now < 0), F.lit(float("-inf"))).otherwise(change)


def round_scaled(c: Column, digits: int = 4) -> Column:
    """Half-even on the scaled double, as array libraries round."""
    return F.rint(c * 10**digits) / 10**digits


def round_decimal(c: Column, digits: int) -> Column:
    """Half-even on the decimal form; exact binary ties may differ from correctly rounded decimal."""
    return F.bround(c, digits)


def scale_fact(c: Column) -> Column:
    """Values over a million are given in units of ten million, to four digits; others as they are."""
    return F.when(F.abs(c) > 1_000_000, round_decimal(c / 10_000_000, 4)).otherwise(c)


def recency_weight(rank: Column) -> Column:
    """1, 0.75, 0.5, 0.25, then 0.1, for ranks from 0."""
    return F.round(F.greatest(1 - 0.25 * rank, F.lit(0.1)), 2)


def evaluate(direction: Column, change: Column) -> Column:
    """struct(result, reason): whether a change bears out a direction, with a band of two percent."""
    d, band = F.lower(direction), V.VERDICT_BAND
    towards = F.when(d == "increase", change).when(d == "decrease", -change)
    verdict = lambda a, b: F.struct(F.lit(a).alias("result"), F.lit(b).alias("reason"))
    return (
        F.when(towards.isNull(), verdict("PARTIAL", "UNKNOWN_DIRECTION"))
        .when(towards > band, verdict("VERIFIED", "VERIFIED_STRONG"))
        .when(towards < -band, verdict("NOT VERIFIED", "CONTRADICTS_DIRECTION"))
        .otherwise(verdict("PARTIAL", "PARTIAL_NO_CHANGE"))
    )


def trend(c: Column) -> Column:
    return F.when(c > V.TREND_BAND, "up").when(c < -V.TREND_BAND, "down").otherwise("flat")


def formatted(c: Column, suffix: str = "") -> Column:
    return F.coalesce(F.concat(F.format_number(c, 1), F.lit(suffix)), F.lit("N/A"))


def bar_percent(c: Column) -> Column:
    return F.least((F.abs(c) * 2).cast("int"), F.lit(100))


def verdict_label(positive: Column, negative: Column) -> Column:
    """Positive or Negative where one side has over one and a half times the other's signals."""
    return F.when(positive > 1.5 * negative, "Positive").when(negative > 1.5 * positive, "Negative").otherwise("Mixed")


def risk_level(score: Column, warning: Column) -> Column:
    return F.when(score.isNull(), "UNKNOWN").when((warning == 1) | (score < 0.4), "HIGH").when(score < 0.65, "MODERATE").otherwise("LOW")


def warning_flag(failure: Column, mismatch: Column, score: Column) -> Column:
    return F.coalesce((failure > 0.4) | (mismatch > 0.3) | (score < 0.5), F.lit(False)).cast("int")


def signal_class(result: Column, reason: Column) -> Column:
    return F.when((result == "VERIFIED") & reason.contains("STRONG"), "positive").when((result == "NOT VERIFIED") & reason.contains("CONTRADICTS_DIRECTION"), "negative").otherwise("weak")


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda t, v: t + v)


def softmax(logits: Column) -> Column:
    """Shares of the exponents; the logits are computed once a row."""

    def shares(e: Column) -> Column:
        return let(F.aggregate(e, F.lit(0.0), lambda t, v: t + v), lambda total: F.transform(e, lambda x: x / total))

    return let(logits, lambda held: let(let(F.array_max(held), lambda top: F.transform(held, lambda x: F.exp(x - top))), shares))
