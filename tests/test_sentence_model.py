"""Sentence ends learned from the corpus."""

import random

import pytest
from pyspark.sql import functions as F

from veritape.functions.text import sentences
from veritape.operators import sentence_model

SHORT = ["approx.", "Inc.", "Mr.", "Dr.", "e.g.", "Corp.", "vs.", "J."]
PLAIN = [a + b for a in "margin revenue growth demand price segment capacity customer export order".split() for b in ("", "s", "ing", "ed", "ly", "er")]
FIRST = "The We In Our This It".split()


def made(rng):
    """A text and its sentences."""
    out = []
    for _ in range(rng.randrange(3, 9)):
        words = [rng.choice(FIRST)]
        for _ in range(rng.randrange(4, 14)):
            words.append(rng.choice(SHORT) if rng.random() < 0.15 else rng.choice(PLAIN) if rng.random() < 0.8 else rng.choice(PLAIN).capitalize())
        out.append(" ".join([*words, rng.choice(PLAIN)]) + rng.choice("...!?"))
    return " ".join(out), out


@pytest.fixture(scope="module")
def learned(spark):
    rng = random.Random(4)
    train = spark.createDataFrame([(i, made(rng)[0]) for i in range(800)] + [(900, None), (901, ""), (902, " \n ")], "id long, text string").repartition(3)
    return sentence_model.fit(train), [made(rng) for _ in range(200)]


def ends(found):
    at, out = 0, set()
    for s in found:
        at += len(s.replace(" ", ""))
        out.add(at)
    return out


def f1(spark, split, held):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(held)], "id long, text string").select("id", split(F.col("text")).alias("s")).collect()
    hit = said = real = 0
    for r in rows:
        got, want = ends(r.s), ends(held[r.id][1])
        hit, said, real = hit + len(got & want), said + len(got), real + len(want)
    return 2 * hit / (said + real)


def test_planted_abbreviations(spark, learned):
    model, held = learned
    assert set(model.abbreviations) >= {x[:-1].lower() for x in SHORT if len(x) > 2}
    assert not set(model.abbreviations) & set(PLAIN)
    assert {x.lower() for x in FIRST} <= set(model.starters)
    by_model, by_rule = f1(spark, model.sentences, held), f1(spark, sentences, held)
    print("F1", by_model, by_rule)
    assert by_model > 0.99 and by_rule < 0.85


def test_odd_texts(spark, learned):
    model = learned[0]
    texts = [None, "", "  ", "No end", "Mr. Smith met J. Doe. The end", "It fell approx. 5 % vs. plan.\n We grew.", "Ends in Inc. The rest follows.", "a. b", "... !", "Inc. Inc. Inc.", "x. " * 50000]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id long, text string, word string")
    got = {r.id: r.s for r in df.select("id", model.sentences(F.col("text")).alias("s")).collect()}
    assert got[0] is None and got[1] == [] and got[2] == [] and got[3] == ["No end"]
    assert got[4] == ["Mr. Smith met J. Doe.", "The end"]
    assert got[5] == ["It fell approx. 5 % vs. plan.", "We grew."]
    assert got[6] == ["Ends in Inc.", "The rest follows."]
    assert got[7] == ["a. b"] and got[8] == ["...", "!"] and got[9] == ["Inc. Inc. Inc."] and len(got[10]) == 1


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], "text string")
    assert sentence_model.fit(none) == sentence_model.SentenceModel([], [])
    few = spark.createDataFrame([("No period here", 1), (None, 2), ("No period here", 1)], "text string, n int")
    model = sentence_model.fit(few)
    assert model.abbreviations == []
    assert few.select(model.sentences(F.col("text")).alias("s")).where("s is not null").collect()[0].s == ["No period here"]


def test_analysis_takes_the_model(spark, learned):
    """A claim with an abbreviation stays whole in the analysis, where the plain rule cuts it."""
    from veritape.plans import analysis
    from veritape.schemas import FACTS

    docs = spark.createDataFrame([("acme", "2024-Q1", "Revenue growth of Acme Inc. increased by approx. 12% on strong demand this quarter.")], "company string, quarter string, raw_text string")
    facts = spark.createDataFrame([], FACTS)
    whole = [r.sentence for r in analysis.plan(docs, facts, split=learned[0].sentences).sentences.collect()]
    parts = [r.sentence for r in analysis.plan(docs, facts).sentences.collect()]
    assert whole == ["Revenue growth of Acme Inc. increased by approx. 12% on strong demand this quarter."]
    assert len(parts) > 1


def test_long_tokens_and_counts_of_starts(spark):
    """A long token costs its length, not its square; counts from different tokens are those of a walk over all tokens."""
    import re
    import time

    texts = ["a" * 300_000 + " is. The end", "Mr. A. b! Then? . x\u0001y. The", " \n ", None, "The The. the", "... End. the e.g. The ! "]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    model = sentence_model.SentenceModel(["mr"], ["the"])
    began = time.perf_counter()
    assert [r.n for r in df.select(F.size(model.sentences(F.col("text"))).alias("n")).limit(1).collect()] == [2]
    assert time.perf_counter() - began < 30
    want = {}
    for t in texts:
        tokens = [x for x in re.split(r"[\s\x1c-\x1f]+", t or "") if x]
        words = [re.sub(r"^[^\w]+|[^\w.]+$", "", x).lower() for x in tokens]
        for i in range(1, len(tokens)):
            before = words[i - 1].rstrip(".")
            sure = tokens[i - 1][-1] in ".!?" and not (words[i - 1].endswith(".") and (len(before) < 2 or before == "mr"))
            at = want.setdefault(words[i].rstrip("."), [0, 0])
            at[0], at[1] = at[0] + sure, at[1] + 1
    assert {r.word: [r.n_start, r.n] for r in sentence_model.start_counts(df, ["mr"]).collect()} == want
