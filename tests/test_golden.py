"""Hand-derived cases, one per rule that is easily got wrong."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veritape.functions import numbers as N
from veritape.functions import quarters as Q
from veritape.functions import text as T
from veritape.operators import asof, claims, dataset, dedup, facts, payload, retrieval, risk, timeseries, verify


def column(spark, rows, schema, expr):
    df = spark.createDataFrame([(i, *r) if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r.v for r in df.withColumn("v", expr).orderBy("i").collect()]


def test_quarter_normalisation(spark):
    cases = {"2024-Q3": "2025-Q3", "Q3FY25": "2025-Q3", "3Q25": "2026-Q3", "3Q2025": "2026-Q3", "Q3 2025": "2026-Q3", "2024Q3": "2024Q3", "Q1 FY123": "123-Q1", "2025-Q4": "2025-Q4", "Q2 FY2024-25": "2024-Q2", "Q4 20": "2020-Q4", "2025-Unknown": "2025-UNKNOWN"}
    assert column(spark, list(cases), "q string", Q.normalise_quarter(F.col("q"))) == list(cases.values())


def test_folder_years(spark):
    cases = {"FY 24-25": 2025, "TATA_23-24": 2024, "INFOYSIS_24": 2024, "2023-2024": 2020, "X_2000": 4000, "FY2024": 2024, "misc": None}
    assert column(spark, list(cases), "q string", Q.folder_year(F.col("q"))) == list(cases.values())


def test_dates(spark):
    got = column(spark, [("2024-03-31",), ("2024-04-01",), ("2024-12-31",)], "d string", Q.fiscal_quarter(F.to_date("d")))
    assert got == ["2024-Q4", "2025-Q1", "2025-Q3"]
    got = column(spark, [("2024-01-01", "2024-04-15"), ("2024-01-01", "2024-04-16"), ("bad", "2024-04-16")], "a string, b string", Q.period_admitted(F.col("a"), F.col("b")))
    assert got == [True, False, True]


def test_verdicts(spark):
    rows = [("increase", 2.0), ("increase", 2.01), ("increase", -2.01), ("decrease", -2.01), ("neutral", 50.0), (None, 50.0)]
    got = column(spark, rows, "d string, c double", N.evaluate(F.col("d"), F.col("c")))
    assert [(r.result, r.reason) for r in got] == [("PARTIAL", "PARTIAL_NO_CHANGE"), ("VERIFIED", "VERIFIED_STRONG"), ("NOT VERIFIED", "CONTRADICTS_DIRECTION"), ("VERIFIED", "VERIFIED_STRONG"), ("PARTIAL", "UNKNOWN_DIRECTION"), ("PARTIAL", "UNKNOWN_DIRECTION")]


def test_numbers(spark):
    assert column(spark, [1000000.0, 1000001.0, 25e8], "v0 double", N.scale_fact(F.col("v0"))) == [1000000.0, 0.1, 250.0]
    assert column(spark, [1 / 160], "v0 double", N.round_scaled(F.col("v0"))) == [0.0062]
    assert column(spark, [12.7, 80.0, -3.0], "v0 double", N.bar_percent(F.col("v0"))) == [25, 100, 6]
    assert column(spark, [(2, 1), (3, 2), (0, 0), (1, 2)], "p int, n int", N.verdict_label(F.col("p"), F.col("n"))) == ["Positive", "Mixed", "Mixed", "Negative"]
    assert column(spark, [1234.25, None], "v0 double", N.formatted(F.col("v0"), "%")) == ["1,234.2%", "N/A"]
    assert column(spark, [(1.0, 0.0), (0.0, 0.0), (5.0, 4.0)], "a double, b double", N.pct_change(F.col("a"), F.col("b"))) == [None, None, 25.0]
    assert column(spark, [(1.0, 0.0), (-1.0, 0.0)], "a double, b double", N.pct_change(F.col("a"), F.col("b"), True)) == [float("inf"), float("-inf")]
    assert column(spark, ["1.5", "nan", "x", None], "t string", N.number(F.col("t"))) == [1.5, None, None, None]


def test_direction_and_magnitude(spark):
    rows = [("profit grew despite pressure", "profit"), ("margins improved", "margin"), ("strong revenue", "revenue"), ("flat volume", "volume"), ("better revenue", "revenue"), ("better cash flow", "cash_flow"), ("client support remained", "revenue")]
    got = column(spark, rows, "s string, m string", T.direction(F.col("s"), F.col("m")))
    assert got == ["decrease", "increase", "neutral", "neutral", "increase", None, "increase"]
    assert column(spark, ["grew 12.5 % to 300 crore", "1,234 crore", "rose 5"], "s string", T.magnitude(F.col("s"))) == ["12.5 %", "234 crore", None]


def test_contrast_and_titles(spark):
    parts = column(spark, ["revenue increased by a lot but margins were under pressure", "However the margins held up well this year"], "s string", T.contrast_parts(F.col("s")))
    assert parts == [["revenue increased by a lot", "margins were under pressure"], ["However the margins held up well this year"]]
    assert column(spark, ["one two three four five six seven eight.", "a b c d e f g h i"], "s string", T.signal_title(F.col("s"))) == ["one two three four five six seven eight", "a b c d e f g h…"]


def test_cleaning(spark):
    assert column(spark, ["keep this\r\n12.5 % | 3\nabc\n  kept  as is \rend line"], "s string", T.clean_lines(F.col("s"))) == ["keep this\n  kept  as is \nend line"]
    assert column(spark, ["a, b", "a b"], "s string", T.dedup_key(F.col("s"))) == ["a  b", "a b"]
    assert column(spark, ["the republic rests", "x Page 3 of 9 tail"], "s string", T.strip_artefacts(F.col("s"))) == ["the re", "x"]
    assert column(spark, ["SUMMARY: a\nPOS: b\n NEG: c\nPOS: d", "plain"], "s string", T.parse_answer(F.col("s"))) == [("a", ["b", "d"], ["c"]), ("plain", [], [])]


def test_time_series(spark):
    rows = [("2024-Q1", "revenue", 100.0), ("2024-Q1", "net_profit", 10.0), ("2024-Q2", "net_profit", 12.0), ("2024-Q3", "revenue", 110.0), ("2024-Q3", "net_profit", 11.0), ("2025-Q1", "revenue", 121.0), ("2025-Q1", "net_profit", -11.0), ("2025-Q2", "revenue", 150.0), ("2025-Q2", "net_profit", 15.0)]
    df = spark.createDataFrame([("c", *r) for r in rows], "company string, quarter string, metric string, value double")
    got = timeseries.features(timeseries.pivot_metrics(df)).orderBy("quarter").collect()
    assert [r.revenue for r in got] == [100.0, 100.0, 110.0, 121.0, 150.0]
    assert [r.profit_margin for r in got][:3] == [10.0, 12.0, 10.0]
    assert [r.revenue_qoq_change for r in got][:3] == [None, 0.0, 10.0]
    assert got[4].revenue_yoy_change == 50.0 and got[3].revenue_yoy_change is None
    flags = timeseries.present_columns(timeseries.features(timeseries.pivot_metrics(df))).first()
    assert flags.has_revenue and not flags.has_operating_profit


def test_asof_tiers(spark):
    right = spark.createDataFrame([("k", "2024-Q4", 1.0), ("k", "2025-Q2", None)], "company string, quarter string, x double")
    left = spark.createDataFrame([("k", "2025-Q2"), ("k", "2025-Q3"), ("k", "2025-UNKNOWN"), ("k", "2020-Q1"), ("z", "2025-Q2")], "company string, quarter string")
    got = {(r.company, r.quarter): (r.match.quarter if r.match else None, r.match_type) for r in asof.asof_with_fallback(left, right, "company", "quarter").collect()}
    assert got == {("k", "2025-Q2"): ("2025-Q2", "EXACT_MATCH"), ("k", "2025-Q3"): ("2025-Q2", "FALLBACK_PREV_QUARTER"), ("k", "2025-UNKNOWN"): ("2025-Q2", "FALLBACK_PREV_QUARTER"), ("k", "2020-Q1"): ("2025-Q2", "FALLBACK_LATEST"), ("z", "2025-Q2"): (None, "NO_COMPANY_DATA")}


def test_risk_score_and_drift(spark):
    rows = [("VERIFIED", "VERIFIED_STRONG"), ("VERIFIED", "x"), ("NOT VERIFIED", "CONTRADICTS_DIRECTION"), (None, "MISSING_VALUE")]
    df = spark.createDataFrame([("c", "2025-Q2", *r) for r in rows] + [("c", "2025-Q1", *r) for r in rows] + [("c", None, "VERIFIED", "x")], "company string, quarter string, result string, reason string")
    got = {r.quarter: r for r in risk.aggregate_risk(df).collect()}
    assert set(got) == {"2025-Q1", "2025-Q2"}
    assert (got["2025-Q2"].consistency_score, got["2025-Q2"].warning_flag) == (0.625, 0)
    assert (got["2025-Q1"].consistency_score, got["2025-Q1"].warning_flag) == (0.4688, 1)
    rates = spark.createDataFrame([("c", f"2024-Q{i}", i / 10) for i in range(1, 5)] + [("c", "2025-Q1", 0.5)], "company string, quarter string, failure_rate double")
    assert [r.risk_drift for r in risk.drift(rates).orderBy("quarter").collect()] == [0.0, 0.1, 0.15, 0.2, 0.2]


def test_fact_mapping(spark):
    tags = ["Income", "OtherIncome", "ComprehensiveIncomeForThePeriod", "IncomeTaxExpense", "Nothing"]
    assert column(spark, tags, "t string", facts.map_tag(F.col("t"))) == ["revenue", None, "revenue", "revenue", None]
    assert column(spark, ["Revenue", "Income", "ComprehensiveIncome"], "t string", facts.tag_priority(F.col("t"))) == [90, 100, 50]
    assert column(spark, ["{http://x}Income", "ns:Income", "Income"], "t string", T.local_name(F.col("t"))) == ["Income"] * 3


def test_verify_reasons(spark):
    series = timeseries.features(timeseries.pivot_metrics(spark.createDataFrame([("A ", q, "revenue", v) for q, v in (("2024-Q1", 100.0), ("2024-Q2", 110.0))], "company string, quarter string, metric string, value double")))
    rows = [("a", "2024-Q2", "rose", "revenue", "increase"), ("a", "2024-Q2", "rose", "profit", "increase"), ("a", "2024-Q2", "rose", "npa", None), ("b", "2024-Q2", "rose", "revenue", "increase"), ("a", "2024-Q1", "rose", "revenue", "increase"), ("a", "2024-Q2", "up yoy", "revenue", "decrease")]
    df = spark.createDataFrame(rows, "company string, quarter string, sentence string, metric string, direction string")
    got = [(r.company, r.metric, r.sentence, r.quarter, r.result, r.reason, r.actual_change) for r in verify.verify(df, series).collect()]
    assert sorted(got, key=str) == sorted(
        [
            ("a", "revenue", "rose", "2025-Q2", "VERIFIED", "VERIFIED_STRONG | EXACT_MATCH", 10.0),
            ("a", "profit", "rose", "2025-Q2", "SKIPPED", "MISSING_METRIC_MAPPING", None),
            ("a", "npa", "rose", "2025-Q2", "SKIPPED", "MISSING_METRIC_MAPPING", None),
            ("b", "revenue", "rose", "2025-Q2", "SKIPPED", "MISSING_TS_ROW", None),
            ("a", "revenue", "rose", "2025-Q1", "SKIPPED", "MISSING_VALUE", None),
            ("a", "revenue", "up yoy", "2025-Q2", "NOT VERIFIED", "CONTRADICTS_DIRECTION | EXACT_MATCH|FALLBACK_CHANGE", 10.0),
        ],
        key=str,
    )


def test_claim_rules_and_attributes(spark):
    s = ["EBITDA is ₹18,000 crores for the full year", "The margins are stable across segments", "Thank you all for joining revenue growth", "Is revenue growing by ten percent here?", "Revenue did not grow in the last quarter", "We say that things went fine on the whole"]
    got = column(spark, s, "s string", T.is_claim(F.col("s"), T.nlp_features(F.col("s"))))
    assert got == [True, True, False, False, False, False]
    df = spark.createDataFrame([("c", "2024-Q1", "Our revenue and profit grew 12 % in the quarter", 0)], "company string, quarter string, sentence string, pos int")
    rows = {(r.metric, r.direction, r.magnitude) for r in claims.attributes(df, ["pos"]).collect()}
    assert rows == {("revenue", "increase", "12 %"), ("profit", "increase", "12 %")}


def test_sets(spark):
    df = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (None, "c", 1), (None, "d", 0)], "k int, v string, o int")
    assert {r.v for r in dedup.first_wins(df, ["k"], [F.asc("o")]).collect()} == {"b", "d"}
    assert {r.v for r in dedup.last_wins(df, ["k"], ["o"]).collect()} == {"a", "c"}
    empty = df.where("false")
    assert dedup.first_nonempty([empty, df]).count() == 4
    assert dataset.balanced(df.where("k = 1"), df.where("k is null"), "v").count() == 4
    assert payload_overlay(spark) == {"a": "1", "b": "3", "c": "4"}


def payload_overlay(spark):
    import json

    row = spark.range(1).select(payload.overlay_json(F.lit('{"a": 1, "b": 2}'), F.lit('{"b": 3, "c": 4}')).alias("j")).first()
    return json.loads(row.j)


def test_top_k_plan(spark):
    v = spark.createDataFrame([(i, [float(i), 0.0], i % 2) for i in range(50)], "id long, embedding array<float>, label int")
    top = retrieval.top_k(v, [3.0, 0.0], 3, F.col("label") == 1)
    assert [r.id for r in top.collect()] == [3, 1, 5]
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 9)), min_size=1, max_size=20))
def test_asof_never_multiplies(spark, rows):
    left = spark.createDataFrame([(f"k{k}", f"2024-Q{q}") for k, q in rows], "company string, quarter string")
    right = spark.createDataFrame([(f"k{k}", f"2024-Q{q}", 1.0) for k, q in {(k % 2, q) for k, q in rows}], "company string, quarter string, x double")
    out = asof.asof_with_fallback(left, right, "company", "quarter").collect()
    assert len(out) == len(rows)
    assert all(r.match.quarter <= r.quarter for r in out if r.match_type in ("EXACT_MATCH", "FALLBACK_PREV_QUARTER"))


def test_risk_from_claims_alone(spark):
    """Worked by hand: no known direction is UNKNOWN, an empty one is not known, and a score under 0.3 warns."""
    rows = [("none", None, True), ("none", "", True), ("low", "increase", False), ("low", "increase", False), ("high", "decrease", False), ("high", "increase", False), ("mid", "increase", False), ("mid", "neutral", False), ("mid", None, True)]
    got = {r.company: (r.level, r.consistency_score, r.warning_flag) for r in risk.risk_from_claims(spark.createDataFrame(rows, "company string, direction string, direction_missing boolean"), ["company"]).collect()}
    assert got["none"] == ("UNKNOWN", None, 0)
    assert got["low"] == ("LOW", 1.0, 0)
    assert got["high"] == ("HIGH", 0.25, 1)
    assert got["mid"] == ("MODERATE", 0.43, 0)
    assert risk.risk_from_claims(spark.createDataFrame([], "direction string, direction_missing boolean")).first().level == "UNKNOWN"


def test_mismatch_reason(spark):
    """Only the full reason counts as a mismatch."""
    rows = [("A", "2024-Q1", "NOT VERIFIED", "Contradicts_Direction | EXACT_MATCH"), ("A", "2024-Q1", "VERIFIED", "CONTRADICTS nothing"), ("A", "2024-Q1", None, None), ("A", "2024-Q1", "SKIPPED", "MISSING_VALUE")]
    r = risk.rates(spark.createDataFrame(rows, "company string, quarter string, result string, reason string")).first()
    assert (r.total_claims, r.mismatch, r.missing, r.skip, r.fail) == (4, 0.25, 0.25, 0.5, 0.25)


def test_repeated_series_rows(spark):
    claim = spark.createDataFrame([("A", "2024-Q1", "Revenue grew", "revenue", "increase")], "company string, quarter string, sentence string, metric string, direction string")
    fields = [f"{m}{k}" for m in ("revenue", "net_profit", "operating_profit", "profit_margin") for k in ("", "_qoq_change", "_yoy_change")]
    series = spark.createDataFrame([("A", "2024-Q1", *[v] * len(fields)) for v in (7.0, 3.0, 5.0)], "company string, quarter string, " + ", ".join(f"{f} double" for f in fields))
    for parts in (1, 3):
        assert verify.verify(claim, series.repartition(parts)).first().actual_change == 3.0


def test_keyword_score_words(spark):
    import re

    from veritape.functions import vocab as V

    texts = ["Revenue grew; net profits improved strongly.", "regrew 9grew risers rose", "", "GROWTH of margins, INCREASED costs-lower", "betterment overall"]
    want = [sum(w in t.lower() for w in V.PERFORMANCE_KEYWORDS) + sum(any(x.startswith(w) for x in re.findall("[a-z]+", t.lower())) for w in V.DIRECTION_KEYWORDS) for t in texts]
    assert column(spark, texts, "s string", T.keyword_score(F.col("s"))) == want and max(want) > 3


def test_better_near_metric(spark):
    """The last resort looks eight words back and seven ahead of a word that holds the metric."""
    filler = lambda n: " ".join(["word"] * n)
    texts = [f"better {filler(7)} revenue", f"better {filler(8)} revenue", f"revenue {filler(6)} better", f"revenue {filler(7)} better", "revenue alone", "better alone"]
    assert column(spark, texts, "s string", T.direction(F.col("s"), F.lit("revenue"))) == ["increase", None, "increase", None, None, None]


def test_model_claims_by_brute_force(spark):
    import math
    import re

    from veritape.functions import vocab as V
    from veritape.models import model_claims

    rows = [(r.doc_id, s.strip()) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(80).collect() for s in re.split(r"(?<=[.!?])\s+", r.text or "")[:30]]
    rows += [(5000, "Revenue increased 12 % on strong demand"), (5001, "revenue increased 12 % on strong demand "), (5002, ""), (5003, "   "), (5004, "Margins improved"), (5005, "the margin of our sales grew"), (5006, "Profit declined 3 crore"), (5007, "strong revenue growth"), (5008, "deposits and loans increased, margins expanded"), (5009, "costs fell by \u20b9 2"), (5010, "nothing here"), (5011, "revenue")]
    seen, want = set(), set()
    for i, (doc, s) in enumerate(rows):
        clean = re.sub(r"\s{2,}", " ", re.sub(r"[\r\n\t]+", " ", s)).strip(" ")
        words = re.findall("[a-z]+", clean.lower())
        score = sum(w in v for v in (V.NOUNS, V.VERBS, V.ADJECTIVES) for w in words) + (1.0 if re.search(r"[0-9]|%|\u20b9|\$", clean) else 0.0) - 1.5
        p = 1 / (1 + math.exp(-score))
        if clean and p >= 0.6 and clean.lower() not in seen:
            seen.add(clean.lower())
            want.add((clean, round(p, 4)))
    df = spark.createDataFrame([(i, "C", "2024-Q1", s) for i, (_, s) in enumerate(rows)], "i int, company string, quarter string, sentence string")
    got = {(r.sentence, r.confidence) for r in model_claims(df, order=["i"]).collect()}
    assert {s for s, _ in got} == {s for s, _ in want} and len(got) == len(want) > 5
    assert all(abs(dict(want)[s] - c) < 1.1e-4 for s, c in got)


def test_shared_folder_on_a_cluster():
    import pytest

    from veritape.session import shared_dir

    class Option:
        isDefined = staticmethod(lambda: False)

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: {})
        _jsc = type("J", (), {"sc": staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(Option)}))})

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(RuntimeError):
        shared_dir(Session)
