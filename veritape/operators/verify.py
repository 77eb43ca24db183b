"""Claims against the series: metric mapping, as-of row, change resolution and verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritape.functions import vocab as V
from veritape.functions.numbers import evaluate, round_decimal
from veritape.functions.quarters import normalise_quarter, reference_type
from veritape.functions.text import company_key
from veritape.operators.asof import asof_with_fallback
from veritape.operators.timeseries import present_columns


def verify(claims: DataFrame, series: DataFrame, scope: str = "company", normalise: bool = True) -> DataFrame:
    """``claims`` (company, quarter, sentence, metric, direction, ...) with actual_change, result, reason.

    Both sides' quarters are normalised once more, as the analysis does (``normalise``). A metric
    without a column, or whose column is empty over the ``scope`` (company or global), is
    MISSING_METRIC_MAPPING before anything else is looked at. Of series rows that repeat a quarter the least counts.
    """
    quarter = normalise_quarter(F.col("quarter")) if normalise else F.col("quarter")
    left = claims.withColumn("__key", company_key(F.col("company"))).withColumn("quarter", quarter)
    right = series.withColumn("__key", company_key(F.col("company"))).withColumn("quarter", quarter).drop("company")
    right = right.groupBy("__key", "quarter").agg(F.min(F.struct(*[c for c in right.columns if c not in ("__key", "quarter")])).alias("__s")).select("__key", "quarter", "__s.*")
    names = F.create_map(*[F.lit(x) for kv in V.METRIC_COLUMN.items() for x in kv])
    left = left.withColumn("__base", names[F.col("metric")])
    matched = asof_with_fallback(left, right, "__key", "quarter")
    if scope == "global":
        flags = matched.crossJoin(F.broadcast(present_columns(series)))
    else:
        own = present_columns(series.withColumn("__pk", company_key(F.col("company"))), ["__pk"])
        flags = matched.join(own, F.col("__key") == F.col("__pk"), "left")
    mapped = F.coalesce(*[F.when(F.col("__base") == c, F.coalesce(F.col(f"has_{c}"), F.lit(True))) for c in V.SERIES_COLUMNS], F.lit(False))

    def pick(kind: str):
        return F.coalesce(*[F.when(F.col("__base") == c, F.col("match")[f"{c}_{kind}_change"]) for c in V.SERIES_COLUMNS])

    primary = F.when(reference_type(F.coalesce("sentence", F.lit(""))) == "yoy", pick("yoy")).otherwise(pick("qoq"))
    out = flags.withColumns({"__mapped": mapped, "__first": primary, "__change": F.coalesce(primary, pick("qoq"))})
    verdict = evaluate(F.col("direction"), F.col("__change"))
    reason = (
        F.when(~F.col("__mapped"), "MISSING_METRIC_MAPPING")
        .when(F.col("match").isNull(), "MISSING_TS_ROW")
        .when(F.col("__change").isNull(), "MISSING_VALUE")
        .otherwise(F.concat(verdict.reason, F.lit(" | "), F.col("match_type"), F.when(F.col("__first").isNull(), "|FALLBACK_CHANGE").otherwise("")))
    )
    done = F.col("__mapped") & F.col("match").isNotNull() & F.col("__change").isNotNull()
    return out.select(*claims.columns, F.when(done, round_decimal(F.col("__change"), 2)).alias("actual_change"), F.when(done, verdict.result).otherwise("SKIPPED").alias("result"), reason.alias("reason"))
