"""From documents to sentences, claims and attributes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritape.functions import text as T
from veritape.operators.dedup import first_wins


def explode_sentences(docs: DataFrame, text_col: str = "raw_text", order: list[str] | None = None, split: Callable[[Column], Column] = T.sentences) -> DataFrame:
    """One row per valid sentence of ``split`` with its position ``pos``, first of equal ones kept by (order, pos). weight and filename go."""
    keep = [c for c in docs.columns if c not in (text_col, "weight", "filename")]
    each = docs.select(*keep, F.posexplode(split(F.col(text_col))).alias("pos", "sentence")).where(T.is_valid_sentence(F.col("sentence")))
    return first_wins(each, ["company", "sentence"] if "company" in keep else ["sentence"], [F.asc(c) for c in order or []] + [F.asc("pos")])


def rule_claims(sentences: DataFrame, features: Column | None = None, order: list[str] | None = None, scope: list[str] | None = None) -> DataFrame:
    """Sentences that the rules call claims, in normal form, first of equal keys kept. ``features``: a struct from a parser; lexical by default."""
    rows = sentences.withColumn("sentence", T.strip_artefacts(F.col("sentence")))
    f = T.nlp_features(F.col("sentence")) if features is None else features
    kept = rows.withColumn("__f", f).where(T.is_claim(F.col("sentence"), F.col("__f"))).drop("__f")
    return first_wins(kept, [*(scope or []), T.dedup_key(F.col("sentence"))], [F.asc(c) for c in order or ["pos"]])


def attributes(claims: DataFrame, order: list[str] | None = None, vocabulary: list | None = None, split: str | None = None, scope: list[str] | None = None) -> DataFrame:
    """One row per (contrast part, metric): company, quarter, sentence, metric, direction, magnitude, direction_missing."""
    from veritape.functions.vocab import CONTRAST

    extra = [c for c in (order or []) if c not in ("company", "quarter")]
    parts = claims.select("company", "quarter", *extra, F.posexplode(T.contrast_parts(F.col("sentence"), split or CONTRAST)).alias("__part", "sentence"))
    clean = T.clean_lower(F.col("sentence"))
    each = parts.withColumn("__clean", clean).withColumn("__metrics", T.metrics(F.col("__clean"), vocabulary)).where(F.size("__metrics") > 0)
    rows = each.select("*", F.posexplode("__metrics").alias("__m", "metric"))
    found = T.direction(F.col("__clean"), F.col("metric"))
    out = rows.withColumns({"direction": found, "magnitude": T.magnitude(F.col("__clean"))}).withColumn("direction_missing", F.col("direction").isNull())
    unique = first_wins(out, [*(scope or []), "sentence", "metric"], [*[F.asc(c) for c in order or []], F.asc("__part")])
    return unique.select("company", "quarter", "sentence", "metric", "direction", "magnitude", "direction_missing")


def match_company(df: DataFrame, folder: str, display: str, company_col: str = "company") -> DataFrame:
    """Rows of the company by name; only if there are none, rows where a name holds the other."""
    c = F.lower(company_col)
    rank = F.when(c.isin(folder.lower(), display.lower()), 0).when(c.contains(display.lower()) | F.contains(F.lit(folder.lower()), c), 1)
    tiers = df.withColumn("__rank", rank).where("__rank is not null")
    best = tiers.agg(F.min("__rank").alias("__best"))
    return tiers.join(F.broadcast(best), F.col("__rank") == F.col("__best")).drop("__rank", "__best")
