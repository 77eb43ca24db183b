"""Filing facts: admission, tag mapping, priorities and scaling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritape.functions import vocab as V
from veritape.functions.numbers import number, scale_fact
from veritape.functions.quarters import fiscal_quarter, period_admitted
from veritape.functions.text import local_name
from veritape.operators.dedup import first_wins


def map_tag(tag: Column, mapping: list[tuple[str, str, int]] | None = None, blocklist: list[str] | None = None) -> Column:
    """The metric of a tag: null for a blocked one, an exact match, else the first listed tag that it contains in any case."""
    rows = V.TAG_METRIC if mapping is None else mapping
    blocked = V.TAG_BLOCKLIST if blocklist is None else blocklist
    exact = reduce(lambda c, r: c.when(tag == r[0], r[1]), rows, F.when(F.lit(False), F.lit(None).cast("string")))
    low = F.lower(tag)
    fuzzy = reduce(lambda c, r: c.when(low.contains(r[0].lower()), r[1]), rows, F.when(F.lit(False), F.lit(None).cast("string")))
    return F.when(~tag.isin(blocked) if blocked else F.lit(True), F.coalesce(exact, fuzzy))


def tag_priority(tag: Column, mapping: list[tuple[str, str, int]] | None = None) -> Column:
    rows = V.TAG_METRIC if mapping is None else mapping
    listed = [r for r in rows if r[2] != V.DEFAULT_PRIORITY]
    return reduce(lambda c, r: c.when(tag == r[0], r[2]), listed, F.when(F.lit(False), F.lit(0))).otherwise(V.DEFAULT_PRIORITY)


def is_segment(context: Column) -> Column:
    return F.lower(context).contains("segment")


def admit(raw: DataFrame) -> DataFrame:
    """Rows (file, ordinal, tag, context_ref, unit_ref, text, start, end, instant) that are facts: with unit and context, a number of 1 or more, no segment, a usable period and a known metric."""
    value, end = number(F.trim("text")), F.coalesce("end", "instant")
    day = F.try_to_date(F.regexp_extract(end, r"^(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")
    tag = local_name(F.col("tag"))
    out = raw.where("unit_ref <> '' and context_ref <> ''").where(~is_segment(F.col("context_ref"))).where(period_admitted(F.col("start"), F.col("end")))
    out = out.withColumns({"value": value, "quarter": fiscal_quarter(day), "metric": map_tag(tag), "priority": tag_priority(tag)})
    return out.where("abs(value) >= 1 and quarter is not null and metric is not null").withColumn("value", scale_fact(F.col("value")))


def pick_by_priority(df: DataFrame, keys: list[str], priority: str, order: list[str]) -> DataFrame:
    """One row per key: the highest priority, then the first in ``order``."""
    return first_wins(df, keys, [F.desc(priority), *[F.asc(o) for o in order]])


def facts(raw: DataFrame) -> DataFrame:
    """company, quarter, metric, value, weight: priorities within a file, then first-wins over files."""
    chosen = pick_by_priority(admit(raw), ["file", "quarter", "metric"], "priority", ["ordinal"])
    unique = first_wins(chosen, ["company", "quarter", "metric", "value"], [F.asc("folder"), F.asc("file"), F.asc("ordinal")])
    return unique.select("company", "quarter", "metric", "value", "weight").orderBy("company", "quarter", "metric")
