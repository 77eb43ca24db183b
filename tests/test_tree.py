"""A generated company tree through the sources, the whole analysis, its store and the service calls."""

import json

import pytest
from pyspark.sql import functions as F

from veritape.models import hashed_embedding
from veritape.plans import analysis, service
from veritape.sinks import Store
from veritape.sources.tree import has_files, transcripts
from veritape.sources.xbrl import filings, raw_facts_of
from veritape.streaming.incremental import append_claims

XML = """<xbrli:xbrl xmlns:xbrli="http://www.xbrl.org/2003/instance" xmlns:in="http://example.org/in">
<xbrli:context id="D"><xbrli:period><xbrli:startDate>{start}</xbrli:startDate><xbrli:endDate>{end}</xbrli:endDate></xbrli:period></xbrli:context>
<xbrli:context id="D_SegmentA"><xbrli:period><xbrli:startDate>{start}</xbrli:startDate><xbrli:endDate>{end}</xbrli:endDate></xbrli:period></xbrli:context>
<in:Revenue contextRef="D" unitRef="INR">7770000000</in:Revenue><in:Income contextRef="D" unitRef="INR">{income}</in:Income><in:TotalIncome contextRef="D" unitRef="INR">5</in:TotalIncome>
<in:OtherIncome contextRef="D" unitRef="INR">99999999999</in:OtherIncome><in:ProfitLossForPeriod contextRef="D" unitRef="INR">{profit}</in:ProfitLossForPeriod>
<in:Expenses contextRef="D_SegmentA" unitRef="INR">100</in:Expenses><in:OperatingProfit contextRef="D">100</in:OperatingProfit><in:OperatingProfit contextRef="X" unitRef="INR">100</in:OperatingProfit>
<in:Expenses contextRef="D" unitRef="INR">0.5</in:Expenses><in:TaxExpense contextRef="D" unitRef="INR">abc</in:TaxExpense></xbrli:xbrl>"""
CALL = "Good morning all. Our revenue increased 12 % in this quarter on strong demand. Our net profit increased again in the quarter by 9 %. What about volumes?\n12.5 % | 3\nabc\n"


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("companies")

    def put(path, data):
        p = top / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data if isinstance(data, bytes) else data.encode())

    put("ALPHA/FY 24-25/Q1_call.txt", CALL)
    put("ALPHA/FY 24-25/notes.TXT", "Caf\xe9 sales were up".encode("latin-1"))
    put("ALPHA/FY 24-25/empty.txt", "")
    put("ALPHA/ALPHA_24/q3.txt", "Revenue improved strongly over the quarter again.")
    put("ALPHA/FY 24-25/r1.xml", XML.format(start="2024-04-01", end="2024-06-30", income=2500000000, profit=200000000))
    put("ALPHA/FY 24-25/r2.xml", XML.format(start="2024-01-01", end="2024-03-31", income=2000000000, profit=190000000))
    put("ALPHA/FY 24-25/long.xml", XML.format(start="2024-01-01", end="2024-04-30", income=1, profit=1))
    put("ALPHA/ALPHA_24/bad.xml", "<broken")
    put("ALPHA/ALPHA_24/r2.XML", XML.format(start="2024-01-01", end="2024-03-31", income=1, profit=1))
    put("BETA 2024 Quarterly Data/Q2.txt", "Order backlog declined by 5 crore in the period.")
    put("GAMMA/2023-2024/Q4.txt", "Deposits and loan growth was steady in the year.")
    put("GAMMA/misc/ignored.txt", "This must not be read by anyone at all.")
    put("stray.txt", "This is outside any company folder here.")
    return str(top)


def test_transcripts(spark, root):
    got = {(r.company, r.quarter, r.filename, r.weight) for r in transcripts(spark, root).collect()}
    assert got == {("ALPHA", "2025-Q1", "Q1_call.txt", 1.0), ("ALPHA", "2025-Unknown", "notes.TXT", 1.0), ("ALPHA", "2024-Q3", "q3.txt", 0.75), ("BETA 2024 Quarterly Data", "2024-Q2", "Q2.txt", 1.0), ("GAMMA", "2020-Q4", "Q4.txt", 1.0)}
    text = {r.filename: r.raw_text for r in transcripts(spark, root, company="ALPHA").collect()}
    assert text["notes.TXT"] == "Café sales were up" and "12.5" not in text["Q1_call.txt"]
    assert {r.company for r in has_files(spark, root).collect()} == {"ALPHA"}
    with pytest.raises(FileNotFoundError):
        transcripts(spark, root + "/none")


def test_filings(spark, root):
    got = [(r.company, r.quarter, r.metric, r.value) for r in filings(spark, root).collect()]
    assert got == [("ALPHA", "2024-Q4", "net_profit", 19.0), ("ALPHA", "2024-Q4", "revenue", 200.0), ("ALPHA", "2025-Q1", "net_profit", 20.0), ("ALPHA", "2025-Q1", "revenue", 250.0)]
    assert list(raw_facts_of(b"<broken")) == []


def test_whole_analysis(spark, root, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    a = analysis.run(spark, root, store, answer=lambda c: F.concat(F.lit("SUMMARY: ok\nPOS: first good thing\nNEG: bad\nPOS: other\n"), F.lit("")))
    assert {(r.id, r.folder_name, r.display_name, r.status) for r in store.read("companies").collect()} == {(1, "ALPHA", "ALPHA", "ready"), (2, "BETA 2024 Quarterly Data", "BETA", "ready"), (3, "GAMMA", "GAMMA", "ready")}
    rows = store.claims(1).collect()
    assert any(r.metric == "revenue" and r.result == "VERIFIED" and r.actual_change == 25.0 for r in rows)
    assert store.read("risk").where("company_id = 1").count() >= 1 and store.read("timeseries").count() == 2
    code, body = service.analyse(store, "alpha")
    payload = json.loads(body["result_json"])
    assert code == 200 and payload["verdict"] == "Positive" and payload["positive_signals"][0] == {"index": "P1", "title": "first good thing", "body": "first good thing"}
    assert service.analyse(store, "nobody-like-this")[0] == 404 and service.analyse(store, "beta", "earnings")[0] == 200
    n = store.read("vectors").count()
    assert store.append_vectors(a.sentences, hashed_embedding(F.col("sentence")), ["folder", "quarter", "pos"]) == n  # no company's vectors twice
    query = list(spark.range(1).select(hashed_embedding(F.lit("revenue demand")).alias("v")).first().v)
    code, answer = service.chat(store, "ALPHA", query, lambda context: context)
    assert code == 200 and "revenue" in answer["answer"].lower()
    assert analysis.rebuild(store) >= n
    assert service.known_companies(store).count() == 3
    assert service.validate({"company": " "})[1] and service.validate({"company": "a", "mode": "x"})[1] and service.validate({"company": "a"})[0]["mode"] == "full"


def test_explanations_from_retrieval(spark, root, tmp_path):
    """The context is what is nearest to the query, not the first sentences; a repair run asks again and keeps what it has no answer for."""
    store = Store(spark, str(tmp_path / "store"))
    near = "Alpha financial performance earnings guidance growth decline margins."
    texts = [f"Sentence number {i} speaks of quite other things today." for i in range(20)] + [near, near]
    vectors = spark.createDataFrame([(f"v{i:02}", t, {"company": "Alpha"}) for i, t in enumerate(texts)], "id string, document string, metadata map<string,string>").withColumns({"embedding": hashed_embedding(F.col("document")), "company": F.lit("Alpha")})
    names = spark.createDataFrame([("Alpha", "Alpha"), ("None", "None")], "company string, name string")
    made = {r.company: r for r in analysis.explain(vectors, names, hashed_embedding, lambda c: c).collect()}
    assert made["Alpha"].explanation.split("\n")[0] == f"- {near}" and made["Alpha"].explanation.count(near) == 1 and made["Alpha"].answered
    assert made["None"].explanation == analysis.EMPTY_ANSWER and not made["None"].answered
    analysis.run(spark, root, store, answer=lambda c: F.concat(F.lit("SUMMARY: first\nPOS: a\n"), F.lit("")))
    before = {(r.company_id, r.mode): json.loads(r.result_json) for r in store.read("analysis_cache").collect()}
    analysis.rebuild(store)
    assert {(r.company_id, r.mode): json.loads(r.result_json) for r in store.read("analysis_cache").collect()} == before
    analysis.rebuild(store, answer=lambda c: F.when(F.contains(c, F.lit("revenue")), F.lit("SUMMARY: second\nPOS: b\nNEG: c\nNEG: d")))
    after = {(r.company_id, r.mode): json.loads(r.result_json) for r in store.read("analysis_cache").collect()}
    for (company, mode), old in before.items():
        new = after[company, mode]
        if company == 1:
            assert (new["explanation"], new["verdict"], [x["body"] for x in new["negative_signals"]], new["mode"]) == ("second", "Negative", ["c", "d"], mode)
            assert new["metrics"] == old["metrics"] and new["claims"] == old["claims"]
        else:
            assert new == old


def test_one_company_fails(spark, root, tmp_path):
    """A company that fails gets the status error; the others' results stand. Stale rows of a company go, and one without filings is judged by its claims."""
    from veritape.models import lexical_logits

    store = Store(spark, str(tmp_path / "store"))
    breaks = lambda c: F.when(F.contains(c, F.lit("Deposits")), F.array(F.lit(0.0), F.raise_error(F.lit("no model for this")).cast("double"))).otherwise(lexical_logits(c))
    names = ["ALPHA", "BETA 2024 Quarterly Data", "GAMMA"]
    failed = analysis.run_each(spark, root, store, names, logits=breaks)
    assert list(failed) == ["GAMMA"] and "no model" in failed["GAMMA"]
    status = {r.folder_name: (r.status, bool(r.error_msg)) for r in store.read("companies").collect()}
    assert status == {"ALPHA": ("ready", False), "BETA 2024 Quarterly Data": ("ready", False), "GAMMA": ("error", True)}
    beta = json.loads(service.analyse(store, "beta")[1]["result_json"])
    assert beta["risk"]["level"] in ("HIGH", "MODERATE", "LOW", "UNKNOWN") and beta["risk"]["warning_flag"] in (0, 1)
    code, answer = service.chat(store, "ALPHA", "revenue demand", lambda context: context)
    assert code == 200 and "revenue" in answer["answer"].lower()
    ids = store.read("companies").select(F.col("id").alias("company_id"))
    one = ids.where("company_id = 1")
    assert store.claims(1).count() > 0
    store.replace_company_rows("claims", store.read("claims").where("false"), companies=one)
    assert store.claims(1).count() == 0 and store.read("claims").count() > 0


def test_financial_errors(spark, root, tmp_path):
    """An error in the filings leaves the company ready, with plain claims and risk from these alone."""
    store = Store(spark, str(tmp_path / "store"))
    bad = lambda spark, root, company: filings(spark, root, company).withColumn("value", F.when(F.col("company") == "ALPHA", F.raise_error(F.lit("no such number")).cast("double")).otherwise(F.col("value")))
    assert analysis.run_each(spark, root, store, ["ALPHA", "GAMMA"], facts=bad) == {}
    assert {(r.folder_name, r.status, r.error_msg) for r in store.read("companies").collect()} == {("ALPHA", "ready", None), ("GAMMA", "ready", None)}
    assert {r.result for r in store.claims(1).collect()} == {None} and store.read("timeseries").count() == 0
    payload = json.loads(service.analyse(store, "alpha")[1]["result_json"])
    assert payload["claims"] and not payload["metrics"] and payload["risk"]["level"] in ("HIGH", "MODERATE", "LOW", "UNKNOWN")


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"company": "C", "quarter": "2024-Q1", "raw_text": CALL.replace("\n", " ")}))
    append_claims(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    first = spark.read.parquet(str(tmp_path / "out")).count()
    append_claims(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert first > 0 and spark.read.parquet(str(tmp_path / "out")).count() == first
