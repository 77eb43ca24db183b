"""A tree that arrives in parts leaves the tables of one batch run, whatever is repeated or cut off."""

import json

import pytest
from pyspark.sql import functions as F

from test_tree import CALL, XML
from veritape.models import hashed_embedding
from veritape.plans import analysis
from veritape.sinks import MAX_PARTS, Store, Transaction
from veritape.streaming.incremental import apply_batch, follow, touched

PARTS = [
    {"GAMMA/2023-2024/Q4.txt": "Deposits and loan growth was steady in the year.", "ALPHA/ALPHA_24/q3.txt": "Revenue improved strongly over the quarter again."},
    {
        "ALPHA/FY 24-25/Q1_call.txt": CALL,
        "ALPHA/FY 24-25/r1.xml": XML.format(start="2024-04-01", end="2024-06-30", income=2500000000, profit=200000000),
        "BETA 2024 Quarterly Data/Q2.txt": "Order backlog declined by 5 crore in the period.",
        "stray.txt": "This is outside any company folder here.",
    },
    {"ALPHA/FY 24-25/r2.xml": XML.format(start="2024-01-01", end="2024-03-31", income=2000000000, profit=190000000)},
]


def put(root, files):
    for path, data in files.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(data)


def tables(store):
    """All rows of a store, with companies by name instead of number."""
    names = {r.id: r.folder_name for r in store.read("companies").collect()}
    rows = lambda t, *c: sorted([(names[r.company_id], *(str(r[x]) for x in c)) for r in store.read(t).collect()])
    return {
        "companies": sorted((r.folder_name, r.display_name, r.status) for r in store.read("companies").collect()),
        "claims": rows("claims", "quarter", "sentence", "metric", "direction", "magnitude", "result", "actual_change"),
        "timeseries": rows("timeseries", "quarter", "revenue", "net_profit", "revenue_qoq_change"),
        "risk": rows("risk", "quarter", "total_claims", "verification_rate", "consistency_score"),
        "vectors": sorted((r.id, r.document, sorted(r.metadata.items())) for r in store.read("vectors").collect()),
        "payloads": sorted((n, m, json.loads(j)) for n, m, j in rows("analysis_cache", "mode", "result_json")),
    }


@pytest.fixture(scope="module")
def batch(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("batch")
    for part in PARTS:
        put(top / "tree", part)
    store = Store(spark, str(top / "store"))
    analysis.run(spark, str(top / "tree"), store)
    return tables(store)


def test_parts_equal_a_batch(spark, batch, tmp_path, monkeypatch):
    root, store = tmp_path / "tree", Store(spark, str(tmp_path / "store"))
    note = Transaction.note_batch
    for i, part in enumerate(PARTS):
        put(root, part)
        if i == 1:  # this batch is cut off after its data and before its note

            def lost(tx, stream, number):
                raise RuntimeError("lost")

            monkeypatch.setattr(Transaction, "note_batch", lost)
            with pytest.raises(Exception, match="lost"):
                follow(spark, str(root), store).awaitTermination()
            monkeypatch.setattr(Transaction, "note_batch", note)
            assert list(store.latest().streams.values()) == [0]
        follow(spark, str(root), store).awaitTermination()
    assert tables(store) == batch
    (stream, last), = store.latest().streams.items()
    assert last == 2
    version = store.latest().version
    assert apply_batch(spark, str(root), store, ["ALPHA"], stream, last) is None and store.latest().version == version
    follow(spark, str(root), store).awaitTermination()  # nothing new
    assert store.latest().version == version


def test_touched(spark, tmp_path):
    files = spark.createDataFrame([(f"file:{tmp_path}/{p}",) for p in ("A b/x.txt", "A b/1/y.xml", "top.txt", "C/1/2/deep.txt")], "path string")
    assert [r.company for r in touched(files, str(tmp_path)).collect()] == ["A b"]


def test_renewed_vectors(spark, tmp_path):
    """Renewed companies lose their old vectors in reads, searches with an older index, folds, and when parts are appended meanwhile."""
    store = Store(spark, str(tmp_path / "store"))
    frame = lambda *rows: spark.createDataFrame(list(rows), "company string, quarter string, pos int, sentence string")
    order, v = ["quarter", "pos"], hashed_embedding(F.col("sentence"))
    seen = lambda: sorted((r.metadata["company"], r.document) for r in store.read("vectors").collect())
    store.append_vectors(frame(("A", "q", 0, "old words"), ("A", "q", 1, "older words"), ("B", "q", 0, "other words")), v, order)
    store.index_vectors()
    query = [float(x) for x in spark.range(1).select(hashed_embedding(F.lit("old words")).alias("v")).first().v]
    near = lambda: [r.document for r in store.nearest(query, 1).collect()]
    assert near() == ["old words"]
    names = spark.createDataFrame([("A",)], "company string")
    store.transact(lambda tx: tx.renew_vectors(frame(("A", "q", 0, "new words")), v, order, names))
    assert seen() == [("A", "new words"), ("B", "other words")] and near() != ["old words"]
    assert store.append_vectors(frame(("A", "q", 0, "not again"), ("C", "q", 0, "third words")), v, order) == 3
    for i in range(MAX_PARTS):
        store.transact(lambda tx, i=i: tx.renew_vectors(frame(("A", "q", 0, f"words {i}")), v, order, names))
    assert len(store.latest().parts("vectors")) <= MAX_PARTS
    assert seen() == [("A", f"words {MAX_PARTS - 1}"), ("B", "other words"), ("C", "third words")]
    store.transact(lambda tx: tx.renew_vectors(frame(), v, order, names))
    assert seen() == [("B", "other words"), ("C", "third words")]
