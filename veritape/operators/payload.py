"""What the analysis shows: metric tiles, bars, signals, claims and their JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritape.functions import vocab as V
from veritape.functions.numbers import bar_percent, formatted, risk_level, trend, verdict_label
from veritape.functions.quarters import normalise_quarter
from veritape.functions.text import signal_title
from veritape.operators.risk import risk_from_claims
from veritape.operators.timeseries import latest

# Labels, units and colours of the display.
TILES = [("Revenue", "revenue", "₹ Cr"), ("Net Profit", "net_profit", "₹ Cr"), ("Operating Profit", "operating_profit", "₹ Cr"), ("Profit Margin", "profit_margin", "%")]
COLOURS = {"up": "var(--accent-green)", "down": "var(--accent-red)", "flat": "var(--accent-blue)"}


def metric_tiles(row: DataFrame) -> DataFrame:
    """``row`` with ``metrics``: up to four of struct(label, value, sub, trend), without null metrics."""
    tiles = [
        F.when(
            F.col(c).isNotNull(),
            F.struct(
                F.concat(F.lit(f"{label} · "), F.coalesce("quarter", F.lit(""))).alias("label"),
                formatted(F.col(c), f" {unit}").alias("value"),
                F.concat(F.lit("QoQ "), formatted(F.col(f"{c}_qoq_change"), "%")).alias("sub"),
                trend(F.col(f"{c}_qoq_change")).alias("trend"),
            ),
        )
        for label, c, unit in TILES
    ]
    return row.withColumn("metrics", F.filter(F.array(*tiles), lambda x: x.isNotNull()))


def bar_tiles(row: DataFrame) -> DataFrame:
    """``row`` with ``bar_metrics``: up to four of struct(label, target_pct, color, value)."""
    bars = []
    for label, c, _ in TILES:
        v = F.col(f"{c}_qoq_change")
        t = trend(v)
        colour = F.when(t == "up", COLOURS["up"]).when(t == "down", COLOURS["down"]).otherwise(COLOURS["flat"])
        bars.append(F.when(v.isNotNull(), F.struct(F.lit(f"{label} QoQ %").alias("label"), bar_percent(v).alias("target_pct"), colour.alias("color"), formatted(v, "%").alias("value"))))
    return row.withColumn("bar_metrics", F.filter(F.array(*bars), lambda x: x.isNotNull()))


def signals(items: Column, mark: str) -> Column:
    """array<struct(index, title, body)>, numbered from 1 after ``mark``."""
    return F.transform(items, lambda x, i: F.struct(F.concat(F.lit(mark), (i + 1).cast("string")).alias("index"), signal_title(x).alias("title"), x.alias("body")))


def display_claims(claims: DataFrame, order: list[str], limit: int = 20, scope: str = "company") -> DataFrame:
    """The first ``limit`` claims per scope as shown: 140 characters, defaults, and the change in place of confidence."""
    w = Window.partitionBy(scope).orderBy(*order)
    head = claims.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= limit)
    return head.select(
        scope,
        F.col("__rn").alias("rank"),
        normalise_quarter(F.col("quarter")).alias("quarter"),
        F.substring("sentence", 1, 140).alias("sentence"),
        "metric",
        F.coalesce(F.nullif("direction", F.lit("")), F.lit("neutral")).alias("direction"),
        F.coalesce("result", F.lit("UNVERIFIED")).alias("result"),
        F.coalesce("actual_change", F.lit(0.0)).alias("confidence"),
    )


def source_label(claims: DataFrame, scope: str = "company") -> DataFrame:
    """The scope's distinct quarters in order, joined. Quarters are few."""
    return claims.groupBy(scope).agg(F.array_join(F.array_sort(F.collect_set(normalise_quarter(F.col("quarter")))), ", ").alias("source_label"))


def risk_from_table(risk: DataFrame, scope: str = "company") -> DataFrame:
    """Level of the latest row per scope."""
    row = latest(risk, [scope])
    return row.select(scope, F.struct(risk_level(F.col("consistency_score"), F.col("warning_flag")).alias("level"), "consistency_score", "warning_flag", "verification_rate", "failure_rate").alias("risk"))


def claims_risk(attributes: DataFrame, scope: str = "company") -> DataFrame:
    """Level from the claims' directions alone, per scope, for those without a risk row; in the shape of :func:`risk_from_table`."""
    found = risk_from_claims(attributes, [scope])
    none = F.lit(None).cast("double")
    return found.select(scope, F.struct("level", F.col("consistency_score").cast("double").alias("consistency_score"), "warning_flag", none.alias("verification_rate"), none.alias("failure_rate")).alias("claims_risk"))


def assemble(series: DataFrame, risk: DataFrame, claims: DataFrame, explained: DataFrame, order: list[str], modes: tuple[str, ...] = ("full", "earnings", "financial"), attributes: DataFrame | None = None) -> DataFrame:
    """company, mode, result_json: one document per company and mode. ``explained``: company, explanation, positive, negative.

    ``attributes``: claims from whose directions a company without a risk row is judged; UNKNOWN without them.
    """
    tiles = bar_tiles(metric_tiles(latest(series, ["company"]))).select("company", "metrics", "bar_metrics")
    shown = display_claims(claims, order)
    listed = shown.groupBy("company").agg(F.array_sort(F.collect_list(F.struct("rank", "quarter", "sentence", "metric", "direction", "result", "confidence"))).alias("claims"))
    named = F.transform("claims", lambda x: F.struct(x.quarter.alias("quarter"), x.sentence.alias("sentence"), x.metric.alias("metric"), x.direction.alias("direction"), x.result.alias("result"), x.confidence.alias("confidence")))
    out = explained.join(tiles, "company", "left").join(risk_from_table(risk), "company", "left").join(listed, "company", "left").join(source_label(claims), "company", "left")
    none = F.lit(None).cast("double")
    unknown = F.struct(F.lit("UNKNOWN").alias("level"), none.alias("consistency_score"), F.lit(0).alias("warning_flag"), none.alias("verification_rate"), none.alias("failure_rate"))
    by_claims = claims_risk(claims if attributes is None else attributes)
    shape = "struct<level string, consistency_score double, warning_flag int, verification_rate double, failure_rate double>"
    out = out.join(by_claims, "company", "left").withColumn("risk", F.coalesce(*[x.cast(shape) for x in (F.col("risk"), F.col("claims_risk"), unknown)]))
    body = F.struct(
        "company",
        F.col("metrics").isNotNull().alias("has_xbrl"),
        signals(F.col("positive"), "P").alias("positive_signals"),
        signals(F.col("negative"), "N").alias("negative_signals"),
        "explanation",
        verdict_label(F.size("positive"), F.size("negative")).alias("verdict"),
        F.coalesce("metrics", F.array()).alias("metrics"),
        F.coalesce("bar_metrics", F.array()).alias("bar_metrics"),
        "risk",
        named.alias("claims"),
        F.coalesce("source_label", F.lit("")).alias("source_label"),
    )
    made = out.select("company", F.to_json(body).alias("result_json"))  # a generator in this select would drop the struct's names
    return made.select("company", F.explode(F.array(*[F.lit(m) for m in modes])).alias("mode"), "result_json")


def overlay_json(existing: Column, new: Column) -> Column:
    """JSON object ``existing`` with the keys of ``new`` over it; values stay JSON text."""
    as_map = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))
    base, top = as_map(existing), as_map(new)
    return F.to_json(F.map_concat(F.map_filter(base, lambda k, _: ~F.coalesce(F.map_contains_key(top, k), F.lit(False))), top))


__all__ = ["V", "assemble", "bar_tiles", "display_claims", "metric_tiles", "overlay_json", "risk_from_table", "signals", "source_label"]
