"""The pipeline's stages, each on its own input, and the queries' contract columns."""

import hashlib
import re

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veritape.llm import bpe, langid, pfair, pii, queries

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "src0", 0), (9002, "12 34", None, "src0", 5), (9003, docs.first().text, None, None, 3), (None, "an id that is null with a text of words and the of", "en", "src1", 4)], docs.schema)
    docs = docs.unionByName(odd)
    before = docs.count()
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(P.STAGES) - 1:
            assert out.columns == docs.columns
        if k == 0:
            ids = {r.doc_id for r in out.collect()}
            assert not ids & {9001, 9002} and before - out.count() == docs.count() - before + 2
            assert out.where("lang is null").count() == 0
        if k == 1:
            assert out.where("doc_id = 9003").count() == 0 and out.where("doc_id is null").count() == 1
        if k == 2:
            assert not any(pii.base_spans(r.text) for r in out.collect() if "<" not in r.text) and out.where(F.col("n_chars") != F.length("text")).count() == 0
        if k == 3:
            assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
        docs = out
    assert docs.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]


def test_mixture_reaches_the_tokens(spark):
    """Prefixes of the last stage's rows follow the target weights, whatever order the stage is given; one source holds most rows."""
    sources = ["src0"] * 1200 + ["src1"] * 240 + ["src2"] * 160 + ["src3"] * 160
    docs = spark.createDataFrame([(i, f"text number {i}", "en", s, 5) for i, s in enumerate(sources)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = P.tokens(spark, P.mixture(spark, docs, SF).orderBy("doc_id"), SF).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(sources)))
    weights = {"src0": 6 / 12, "src1": 3 / 12, "src2": 2 / 12, "src3": 1 / 12}
    for n in range(16, 961, 16):  # no source has run out yet
        for s, w in weights.items():
            assert abs(sum(sources[r.doc_id] == s for r in rows[:n]) - w * n) < 16
    full = P.mixed_tokens(spark, docs, SF).collect()
    assert [r.doc_id for r in full] == [r.doc_id for r in rows] and [r.mix_order for r in full] == sorted(r.mix_order for r in full)
    assert all(r.n_tokens == len(r.ids) > 0 for r in full)
    assert P.tokens(spark, docs.where("false"), SF).count() == 0


def test_run_by_brute_force(spark):
    """All rows of run(), in order, against the five stages done plainly on the driver."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    profiles = langid.load_profiles(langid.train_profiles(spark.createDataFrame(rows)).collect())
    kept = []
    for r in rows:
        lang, score = langid.score_text(r.text, *profiles)
        if lang != "und" and score >= P.LEAST_SCORE:
            kept.append(r.asDict() | {"lang": r.lang or lang})
    sets = []
    for r in kept:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), r["text"]))
        sets.append(frozenset(zip(*[w[i:] for i in range(P.WIDTH)])) if len(w) >= P.WIDTH else frozenset([tuple(w)]))
    parent = list(range(len(kept)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if P.DEN * len(x & sets[j]) >= P.NUM * len(x | sets[j]):
                a, b = root(i), root(j)
                parent[a if kept[a]["doc_id"] > kept[b]["doc_id"] else b] = b if kept[a]["doc_id"] > kept[b]["doc_id"] else a
    alone = [r for i, r in enumerate(kept) if root(i) == i]
    assert 0 < len(alone) < len(kept) <= len(rows)
    model = pii.fit(spark.createDataFrame([(r["doc_id"], r["text"]) for r in alone], "doc_id long, text string"))
    tokenizer = Tokenizer.from_file(bpe.vocabulary_path())
    by, want = {}, []
    for r in alone:
        base = pii.base_spans(r["text"])
        text = pii.redact_text(r["text"], base + pii.added_spans(r["text"], base, model))
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        decoded = hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        by.setdefault(r["source"], []).append((hashlib.md5(str(r["doc_id"]).encode()).hexdigest(), r["doc_id"], len(ids), ids, decoded))
    shares = {s: pfair.SHARES.get(s, 1) for s in by}
    slots = {(s, turn): slot for s, turn, slot in pfair.edf_slots(list(shares.items()))}
    for s, own in by.items():
        for k, x in enumerate(sorted(own)):
            b, a = k // pfair.BLOCK_ROWS, shares[s]
            want.append(((b // a * sum(shares.values()) + slots[s, b % a + 1]) * pfair.BLOCK_ROWS + k % pfair.BLOCK_ROWS, *x[1:]))
    got = [(r.doc_id, r.n_tokens, list(r.ids), r.decoded_sha256) for r in P.run(spark, SF).collect()]
    assert got == [x[1:] for x in sorted(want)]


@pytest.mark.parametrize("k", range(4))
def test_odd_tables(spark, k):
    """Clashing columns, nulls in any column, repeated rows, a long text; then no rows."""
    long = " ".join(f"the word {i} and its mate" for i in range(30000))
    rows = [(1, long, "en", "src0", 7), (2, None, None, None, None), (None, "the text of a row without an id and of some words", "en", None, 3), (3, "", "xx", "src1", 0), (4, "the same words of a row that is there twice", "en", "src1", 3), (4, "the same words of a row that is there twice", "en", "src1", 3)]
    clash = ["score", "lang_pred", "slot", "turn", "share", "period", "mix_order", "th", "uid", "__id", "__th", "c0", "rank", "text2"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.lit("x").alias(c) for c in clash])
    out = P.STAGES[k][1](spark, docs, SF)
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) == {0: 4, 1: 5}.get(k, 6) and all(r.score == r.mix_order == r.c0 == "x" for r in got)
    if k != 1:
        assert P.STAGES[k][1](spark, docs.where("false"), SF).count() == 0


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("op1_cover_tree", ["vec_id", "n_links", "component_id", "kept"]),
        ("op4_suffix_dedup", ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]),
        ("op6_bpe_word_table", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]),
        ("op9_ngram_jaccard", ["doc_id", "n_shingles", "component_id"]),
    ],
)
def test_contract(spark, name, columns):
    df = queries.QUERIES[name](spark, SF)
    assert df.columns[: len(columns)] == columns
    assert df.count() == spark.read.parquet(f"{SF}/{'embeddings' if name == 'op1_cover_tree' else 'documents'}.parquet").count()


def test_steps_count_as_they_write(spark):
    """Aggregates come with the write, those of plans that turn out to be empty too."""
    from veritape.llm import common

    rows = spark.range(1000).where("id % 3 = 0")
    for df, n, top in ((rows, 334, 999), (rows.where("id < 0"), 0, None), (rows.join(rows.where("id > 2000").repartition(3, "id"), "id"), 0, None), (rows.groupBy("id").count(), 334, 999)):
        out, found = common.measured_cut(df, "test", n=F.count(F.lit(1)), top=F.max("id"))
        assert found == {"n": n, "top": top} and out.count() == n
        assert common.rows_of(common.counted_cut(df, "test")) == n


def test_near_duplicates_take_few_jobs(spark):
    """The driver keeps a plan, code and history of every job, however small the table."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[i * 7 : i * 7 + 60]) for i in range(40)] + [" ".join(words[i * 7 : i * 7 + 59]) for i in range(40)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    sc = spark.sparkContext
    sc.setJobGroup("near-duplicates", "counted")
    try:
        kept = P.near_duplicates(spark, docs, "").count()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(sc.statusTracker().getJobIdsForGroup("near-duplicates"))
    assert kept == 40 and jobs < 190  # 216 before rows were counted as they are written, then 160


def test_near_duplicates_write_their_sets_once(spark):
    """Without the copies' sets, not joined with the copies anew by each step that reads them: every such join is a broadcast on the driver."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[i * 7 : i * 7 + 60]) for i in range(40)] * 2 + [" ".join(words[i * 7 : i * 7 + 59]) for i in range(40)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    sc = spark.sparkContext
    sc.setJobGroup("sets-once", "counted")
    try:
        kept = sorted(r.doc_id for r in P.near_duplicates(spark, docs, "").collect())
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(sc.statusTracker().getJobIdsForGroup("sets-once"))
    assert kept == list(range(40)) and jobs < 150, jobs


def test_spent_broadcasts_leave_the_driver(spark):
    """Tables that were broadcast for finished steps don't stay until the JVM happens to collect its garbage; the last step's may."""
    import time

    from veritape.llm import common

    held = lambda: spark._jvm.org.apache.spark.SparkEnv.get().memoryManager().storageMemoryUsed()
    rows, most = spark.range(20000), 0
    for i in range(6):
        rows.join(F.broadcast(rows.select((F.col("id") + i).alias("b"))), F.col("id") == F.col("b")).count()
        most = max(most, held())
    common.spent(rows)
    for _ in range(40):
        if held() < most / 2:
            break
        time.sleep(0.25)
    assert most > 1_000_000 and held() < most / 2, (most, held())
