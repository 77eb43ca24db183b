"""Risk per (company, quarter): rates, recency weights, consistency score, drift and warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritape.functions.numbers import recency_weight, round_decimal, round_scaled, warning_flag
from veritape.functions.quarters import sort_key

COLUMNS = [
    "company", "quarter", "total_claims", "quarter_weight", "verification_rate", "failure_rate", "partial_rate", "skipped_rate",
    "direction_mismatch_rate", "missing_data_rate", "unknown_direction_rate", "consistency_score", "risk_drift", "warning_flag",
]


def normalise_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def rates(verified: DataFrame) -> DataFrame:
    """Claim counts and unrounded rates; rows without company or quarter don't count. A null result counts as skipped."""
    result, reason = F.upper(F.coalesce("result", F.lit("SKIPPED"))), F.upper(F.coalesce("reason", F.lit("")))
    share = lambda cond, name: (F.count_if(cond) / F.count("*")).alias(name)
    return (
        verified.where("company is not null and quarter is not null")
        .groupBy("company", "quarter")
        .agg(
            F.count("*").alias("total_claims"),
            share(result == "VERIFIED", "ver"),
            share(result == "NOT VERIFIED", "fail"),
            share(result == "PARTIAL", "part"),
            share(result == "SKIPPED", "skip"),
            share(reason.contains("CONTRADICTS_DIRECTION"), "mismatch"),
            share(reason.contains("MISSING"), "missing"),
            share(reason.contains("UNKNOWN_DIRECTION"), "unknown"),
        )
    )


def quarter_weights(quarters: DataFrame, scope: str = "company") -> DataFrame:
    """A weight for each distinct quarter, newest first, of each company or (``global``) of all together: the distinct quarters are few."""
    keys = ["company", "quarter"] if scope == "company" else ["quarter"]
    distinct = quarters.select(*keys).where("quarter is not null").distinct()
    k = sort_key(F.col("quarter"))
    w = (Window.partitionBy("company") if scope == "company" else Window.partitionBy(F.lit(0))).orderBy(k.desc(), F.desc("quarter"))
    return distinct.withColumn("quarter_weight", recency_weight(F.row_number().over(w) - 1))


def drift(df: DataFrame, rate: str = "failure_rate") -> DataFrame:
    """risk_drift: the rounded rate less the mean of up to three rows before; 0 for the first."""
    w = Window.partitionBy("company").orderBy(sort_key(F.col("quarter")), "quarter").rowsBetween(-3, -1)
    return df.withColumn("risk_drift", round_scaled(F.coalesce(F.col(rate) - F.avg(rate).over(w), F.lit(0.0))))


def aggregate_risk(verified: DataFrame, scope: str = "company") -> DataFrame:
    """The risk table."""
    base = rates(normalise_names(verified))
    weighted = base.join(quarter_weights(base, scope), ["company", "quarter"] if scope == "company" else ["quarter"], "left").withColumn("quarter_weight", F.coalesce("quarter_weight", F.lit(0.1)))
    raw = F.expr("(0.5D * ver + 0.2D * (1 - fail) + 0.2D * (1 - mismatch) + 0.1D * (1 - missing)) * quarter_weight")
    score = round_decimal(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 4)
    names = {"verification_rate": "ver", "failure_rate": "fail", "partial_rate": "part", "skipped_rate": "skip", "direction_mismatch_rate": "mismatch", "missing_data_rate": "missing", "unknown_direction_rate": "unknown"}
    rounded = weighted.withColumns({k: round_scaled(F.col(v)) for k, v in names.items()}).withColumn("consistency_score", score)
    return drift(rounded).withColumn("warning_flag", warning_flag(F.col("failure_rate"), F.col("direction_mismatch_rate"), F.col("consistency_score"))).select(*COLUMNS)


def risk_from_claims(attributes: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Level, score and warning where nothing could be verified, from the directions alone; UNKNOWN without a known direction. An empty direction is unknown."""
    known = F.count(F.nullif(F.col("direction"), F.lit("")))
    share = lambda v: F.try_divide(F.count_if(F.col("direction") == v), known)
    score = F.coalesce(share("increase"), F.lit(0.0)) - 0.5 * F.coalesce(share("decrease"), F.lit(0.0)) - 0.2 * F.coalesce(F.try_divide(F.count_if("direction_missing"), F.count("*")), F.lit(0.0))
    out = attributes.groupBy(*(scope or [])).agg(known.alias("n"), round_decimal(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2).alias("s"))
    level = F.when(F.col("n") == 0, "UNKNOWN").when(F.col("s") > 0.6, "LOW").when(F.col("s") > 0.3, "MODERATE").otherwise("HIGH")
    return out.select(*(scope or []), level.alias("level"), F.when(F.col("n") > 0, F.col("s")).alias("consistency_score"), ((F.col("n") > 0) & (F.col("s") < 0.3)).cast("int").alias("warning_flag"))
