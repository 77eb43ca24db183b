"""Model interfaces: injected callables in Arrow batches, with deterministic lexical defaults. The defaults claim no parity with trained models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritape.functions.numbers import round_decimal, softmax
from veritape.functions.text import _let as let
from veritape.functions.text import clean_sentence, nlp_features, strip
from veritape.operators.dedup import first_wins

CLAIM_THRESHOLD = 0.6
BATCH = 64


def batched(load: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = BATCH) -> Callable[[Column], Column]:
    """A column function from text to logits. ``load`` runs once per worker; its model gets at most ``batch`` texts at a time."""

    @F.pandas_udf("array<double>")
    def logits(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in texts:
            out: list = []
            for i in range(0, len(part), batch):
                out += [[float(x) for x in row] for row in model(["" if t is None else t for t in part.iloc[i : i + batch]])]
            yield pd.Series(out)

    return logits


def probability(logits: Column, index: int = 1) -> Column:
    return softmax(logits)[index]


def lexical_logits(c: Column) -> Column:
    """Two logits from word-list counts: the stand-in where no classifier is given."""
    return let(nlp_features(c), lambda f: F.array(F.lit(0.0), (f.nouns + f.verbs + f.adjectives).cast("double") + F.when(f.entity, 1.0).otherwise(0.0) - 1.5))


def model_claims(sentences: DataFrame, logits: Callable[[Column], Column] = lexical_logits, order: list[str] | None = None, threshold: float = CLAIM_THRESHOLD, scope: list[str] | None = None) -> DataFrame:
    """company, quarter, sentence, label, confidence of the sentences whose claim probability reaches the threshold (compared before it is rounded); first of equal ones kept."""
    extra = [c for c in order or [] if c not in ("company", "quarter", "sentence")]
    rows = sentences.withColumn("sentence", clean_sentence(F.col("sentence"))).where("length(sentence) > 0")
    reached = F.filter(F.array(probability(logits(F.col("sentence")))), lambda p: p >= threshold)  # exploded, because a filter would compute it again
    scored = rows.select("*", F.explode(reached).alias("__p"))
    unique = first_wins(scored, [*(scope or []), strip(F.lower("sentence"))], [F.asc(c) for c in order or ["sentence"]])
    return unique.select("company", "quarter", "sentence", F.lit("CLAIM").alias("label"), round_decimal(F.col("__p"), 4).alias("confidence"), *extra)


def sentiment(logits: Column) -> Column:
    """struct(label, confidence): the likeliest class and its probability."""
    p = softmax(logits)
    top = F.array_max(p)
    return F.struct((F.array_position(p, top) - 1).cast("int").alias("label"), top.alias("confidence"))


def hashed_embedding(c: Column, width: int = 64) -> Column:
    """A unit vector of signed word hashes: equal texts are near, nothing more. For tests and runs without an embedder."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1))

    def slots(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.aggregate(h, F.lit(0.0), lambda a, x: a + F.when(F.pmod(x, F.lit(width)) == i, F.when(F.shiftright(x, 33) % 2 == 0, 1.0).otherwise(-1.0)).otherwise(0.0)))

    def unit(v: Column) -> Column:
        return let(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), lambda norm: F.transform(v, lambda x: F.try_divide(x, norm).cast("float")))

    return let(let(F.transform(words, lambda w: F.xxhash64(w)), slots), unit)
