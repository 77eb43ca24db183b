"""The store's versions: atomic over tables, never losing a row between writers, written by change."""

import threading

import pytest
from pyspark.sql import functions as F

from veritape import sinks
from veritape.models import hashed_embedding
from veritape.operators import retrieval
from veritape.operators.numbering import dense_numbers
from veritape.sinks import Store, Transaction

SEQ = "folder_name string, status string, error_msg string, seq long"


def companies(spark, rows):
    return spark.createDataFrame([(n, s, None, q) for n, s, q in rows], SEQ)


def claims(spark, rows):
    return spark.createDataFrame([], sinks.TABLES["claims"][0]).unionByName(spark.createDataFrame(rows, "company_id long, sentence string"), allowMissingColumns=True)


def names(snapshot):
    return sorted((r.folder_name, r.id, r.status) for r in snapshot.read("companies").collect())


def said(snapshot):
    return sorted((r.company_id, r.sentence) for r in snapshot.read("claims").collect())


def test_versions_and_replacement(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.versions() == [] and names(store.latest()) == [] and not store.exists("claims") and store.read("vectors").count() == 0
    store.upsert_companies(companies(spark, [("b", "pending", 2), ("a", "pending", 1), ("a", "ready", 3)]))
    store.upsert_companies(companies(spark, [("c", "error", 9), ("b", "ready", 8), ("a", "error", 1)]))  # the last is older than what is there
    assert names(store.at(1)) == [("a", 1, "ready"), ("b", 2, "pending")]
    assert names(store.latest()) == [("a", 1, "ready"), ("b", 2, "ready"), ("c", 3, "error")]
    store.replace_company_rows("claims", claims(spark, [(1, "x"), (1, "y"), (2, "z")]))
    store.replace_company_rows("claims", claims(spark, [(1, "new")]), companies=spark.createDataFrame([(1,), (2,), (7,)], "company_id long"))
    assert said(store.latest()) == [(1, "new")] and said(store.at(3)) == [(1, "x"), (1, "y"), (2, "z")]
    for i, seq in enumerate([5, 6, 4]):
        store.save_analysis(spark.createDataFrame([(1, "full", f"v{i}", seq)], "company_id long, mode string, result_json string, seq long"))
    assert [r.result_json for r in store.analysis(1, "full").collect()] == ["v1"]
    store.roll_back(3)
    assert said(store.latest()) == [(1, "x"), (1, "y"), (2, "z")] and not store.exists("analysis_cache") and names(store.latest())[2][0] == "c"
    pinned = store.latest()
    store.replace_company_rows("claims", claims(spark, []), companies=spark.createDataFrame([(1,)], "company_id long"))
    assert said(pinned) == [(1, "x"), (1, "y"), (2, "z")] and said(store.latest()) == [(2, "z")]
    assert store.vacuum(keep=2, older_s=-5) > 0 and said(store.latest()) == [(2, "z")] and len(store.versions()) == 2
    assert [n for n, _ in store._names("log") if n.endswith(".tmp")] == []


def test_death_between_any_writes(spark, tmp_path, monkeypatch):
    """Whichever write a run dies at, all tables stay at the version before it."""
    store = Store(spark, str(tmp_path / "s"))

    def work(tx, n=0):
        tx.upsert_companies(companies(spark, [("a", f"s{n}", n)]))
        tx.replace_company_rows("claims", claims(spark, [(1, f"claim {n}")]))
        tx.save_analysis(spark.createDataFrame([(1, "full", str(n), n)], "company_id long, mode string, result_json string, seq long"))
        assert said(tx) == [(1, f"claim {n}")]  # a transaction sees its own changes

    store.transact(work)
    real, put = Transaction._write, Store._put
    for dies in range(4):
        calls = []

        def write(self, *args, dies=dies, calls=calls):
            calls.append(1)
            if len(calls) > dies:
                raise OSError("lost")
            return real(self, *args)

        with monkeypatch.context() as m:
            m.setattr(Transaction, "_write", write)
            if dies == 3:
                m.setattr(Store, "_put", lambda self, path, text: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                store.transact(lambda tx: work(tx, 1))
        assert names(store.latest()) == [("a", 1, "s0")] and said(store.latest()) == [(1, "claim 0")] and store.versions() == [1]
    assert Store._put is put
    store.transact(lambda tx: work(tx, 2))
    assert names(store.latest()) == [("a", 1, "s2")] and said(store.latest()) == [(1, "claim 2")]


def test_writers_race(spark, tmp_path):
    """Each of several writers' rows is there in the end; numbers of new companies are dense and differ."""
    store, failed = Store(spark, str(tmp_path / "s")), []

    def write(w):
        try:
            for i in range(2):
                store.upsert_companies(companies(spark, [(f"w{w}-{i}", "ready", i)]))
                store.replace_company_rows("claims", claims(spark, [(10 * w + i, f"{w} {i}")]))
        except BaseException as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    got = names(store.latest())
    assert [g[0] for g in got] == sorted(f"w{w}-{i}" for w in range(3) for i in range(2)) and sorted(g[1] for g in got) == list(range(1, 7))
    assert said(store.latest()) == sorted((10 * w + i, f"{w} {i}") for w in range(3) for i in range(2))
    assert store.versions() == list(range(1, 13))


def test_lost_race(spark, tmp_path):
    """Parts that depend on nothing read are added to the version that came first; work that read what changed is done again."""
    store, runs = Store(spark, str(tmp_path / "s")), []

    def additive(tx):
        tx.replace_company_rows("claims", claims(spark, [(1, "mine")]))
        if not runs:
            store.replace_company_rows("claims", claims(spark, [(2, "theirs")]))
        runs.append(1)

    store.transact(additive)
    assert len(runs) == 1 and said(store.latest()) == [(1, "mine"), (2, "theirs")]
    runs.clear()

    def reading(tx):
        n = len(said(tx))
        if not runs:
            store.replace_company_rows("claims", claims(spark, [(3, "more")]))
        runs.append(1)
        tx.replace_company_rows("claims", claims(spark, [(9, f"saw {n}")]))

    store.transact(reading)
    assert len(runs) == 2 and (9, "saw 3") in said(store.latest())
    assert not store._put("log/00000000000000000001.json", "{}")  # a number is taken once


def test_put_by_rename(spark, tmp_path):
    """The way that file systems other than the local one go."""
    store = Store(spark, str(tmp_path / "s"))
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext()
    rename = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    assert store._put("log/1.json", "one")
    (tmp_path / "s" / "log" / "2.tmp").write_text("two")
    path = spark._jvm.org.apache.hadoop.fs.Path
    with pytest.raises(Exception, match="FileAlreadyExists"):
        context.rename(path(str(tmp_path / "s" / "log" / "2.tmp")), path(str(tmp_path / "s" / "log" / "1.json")), rename)
    context.rename(path(str(tmp_path / "s" / "log" / "2.tmp")), path(str(tmp_path / "s" / "log" / "2.json")), rename)
    assert (tmp_path / "s" / "log" / "2.json").read_text() == "two" and (tmp_path / "s" / "log" / "1.json").read_text() == "one"


def test_folding(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "MAX_PARTS", 3)
    store, want = Store(spark, str(tmp_path / "s")), {}
    for i in range(7):
        store.replace_company_rows("claims", claims(spark, [(i % 3, f"r{i}")]), companies=spark.createDataFrame([(i % 4,)], "company_id long"))
        want.pop(i % 4, None)
        want[i % 3] = f"r{i}"
        assert said(store.latest()) == sorted(want.items())
        store.upsert_companies(companies(spark, [(f"c{i % 2}", f"s{i}", i)]))
        assert len(store.latest().parts("claims")) <= 4
    assert names(store.latest()) == [("c0", 1, "s6"), ("c1", 2, "s5")] and len(store.latest().parts("companies")) <= 4


def test_vectors_and_index(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    text = spark.createDataFrame([(f"c{i % 3}", f"revenue number {i} in quarter {i % 7}", i) for i in range(90)], "company string, sentence string, pos int")
    embed = hashed_embedding(F.col("sentence"))
    assert store.append_vectors(text, embed, ["pos"]) == 90 and store.append_vectors(text, embed, ["pos"]) == 90
    store.index_vectors(cells=6)
    more = text.select(F.lit("c9").alias("company"), "sentence", "pos")
    assert store.append_vectors(more, embed, ["pos"]) == 180
    query = list(store.latest().vectors().where("id = 'c1_4'").first().embedding)
    for where in (None, F.col("company") == "c9", F.col("company") == "c1", F.col("company") == "none"):
        got = [(r.id, r.distance) for r in store.nearest(query, 8, where).collect()]
        assert got == [(r.id, r.distance) for r in retrieval.top_k(store.latest().vectors(), query, 8, where).collect()]


def test_dense_numbers(spark):
    rows = [(i * 7919 % 1000, f"k{i % 13}") for i in range(1000)]
    df = spark.createDataFrame(rows, "a int, b string").repartition(5)
    got = {(r.a, r.b): r.n for r in dense_numbers(df, ["b", "a"], "n", start=10).collect()}
    assert got == {k: 11 + i for i, k in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert dense_numbers(df.limit(0), ["a", "b"], "n").count() == 0
