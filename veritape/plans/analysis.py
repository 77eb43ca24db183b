"""The whole analysis as one lazy plan over all companies, and its storage."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritape.functions.numbers import verdict_label
from veritape.functions.text import display_name, parse_answer
from veritape.functions.text import sentences as text_sentences
from veritape.models import hashed_embedding, lexical_logits, model_claims
from veritape.operators.claims import attributes, explode_sentences, rule_claims
from veritape.operators.dedup import first_nonempty
from veritape.operators.payload import assemble, signals
from veritape.operators.retrieval import SUFFIX_EXPLAIN, company_contexts
from veritape.operators.risk import aggregate_risk
from veritape.operators.timeseries import features, pivot_metrics
from veritape.operators.verify import verify
from veritape.schemas import FACTS, TABLES
from veritape.session import cut
from veritape.sinks import Store, Transaction
from veritape.sources.tree import transcripts
from veritape.sources.xbrl import filings

# What follows the company's name in the query of a batch run and of a repair run, before the suffix.
QUERY = "financial performance earnings financial performance"
REBUILD_QUERY = "financial performance earnings guidance financial performance"
EMPTY_ANSWER = "Insufficient transcript data available to synthesize an analysis."  # fixed value


@dataclass
class Analysis:
    """Frames of one run. ``claims`` holds verified attributes, or plain ones where a company has no series."""

    sentences: DataFrame
    attributes: DataFrame
    series: DataFrame
    verified: DataFrame
    risk: DataFrame
    claims: DataFrame


def plan(docs: DataFrame, facts: DataFrame, logits: Callable[[Column], Column] = lexical_logits, keep: Callable[[DataFrame], DataFrame] = lambda df: df, split: Callable[[Column], Column] = text_sentences) -> Analysis:
    """``docs`` and ``facts`` of any number of companies. The model's claims are used for a company if it has any, else the rules'.

    ``split`` turns a text into its sentences: the plain rule, or the ``sentences`` of a learned model.
    ``keep`` is applied to each frame that several later ones read; a run that writes them all passes :func:`cut`.
    """
    order = ["company", "folder", "quarter", "pos"] if "folder" in docs.columns else ["company", "quarter", "pos"]
    sentences = keep(explode_sentences(docs, order=[c for c in order if c != "pos"], split=split))
    found = model_claims(sentences, logits, order, scope=["company"]).select("company", "quarter", "sentence", *[c for c in order if c not in ("company", "quarter")])
    ruled = rule_claims(sentences, order=order, scope=["company"]).select(*found.columns)
    claims = first_nonempty([found, ruled], ["company"])
    attrs = keep(attributes(claims, order, scope=["company"]))
    series = keep(features(pivot_metrics(facts)))
    verified = keep(verify(attrs, series))
    has_series = series.select("company").distinct()
    checked = verified.join(has_series, "company", "left_semi")
    plain = attrs.join(has_series, "company", "left_anti")
    return Analysis(sentences, attrs, series, checked, aggregate_risk(checked), checked.unionByName(plain, allowMissingColumns=True))


def run(spark: SparkSession, root: str, store: Store, company: str | list[str] | None = None, logits: Callable[[Column], Column] = lexical_logits, embed: Callable[[Column], Column] = hashed_embedding, answer: Callable[[Column], Column] | None = None, extract_pdf: Callable[[bytes], list[str]] | None = None, facts: Callable[..., DataFrame] | None = filings, split: Callable[[Column], Column] = text_sentences, renew: bool = False) -> Analysis:
    """Read the tree, analyse, and write every table in one transaction. Vectors that a company has stay, unless ``renew``. ``answer`` turns a context text into a model's answer text; without ``facts`` claims stay unverified."""
    docs = transcripts(spark, root, extract_pdf, company)
    a = plan(docs, facts(spark, root, company) if facts else spark.createDataFrame([], FACTS), logits, cut, split)
    folders = docs.select(F.col("company").alias("folder_name")).distinct()
    store.upsert_companies(folders.select("folder_name", F.lit("processing").alias("status"), F.lit(None).cast("string").alias("error_msg"), F.expr("unix_micros(current_timestamp())").alias("seq")))
    store.transact(lambda tx: _save(tx, a, folders, embed, answer, renew))
    return a


def _save(tx: Transaction, a: Analysis, folders: DataFrame, embed: Callable[[Column], Column], answer: Callable[[Column], Column] | None, renew: bool = False) -> None:
    """All tables of one run, as changes of ``tx``: they are seen together with the status ready, or not at all."""
    ids = cut(tx.read("companies").select(F.col("id").alias("company_id"), F.col("folder_name").alias("company")).join(folders.withColumnRenamed("folder_name", "company"), "company", "left_semi"), "ids")
    keyed = lambda df: df.join(ids, "company")
    for name, df in (("timeseries", a.series), ("risk", a.risk), ("claims", a.claims)):
        rows = keyed(df)
        for c in [x.split()[0] for x in TABLES[name][0].split(", ")]:
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None))
        typed = [F.col(x.split()[0]).cast(x.split()[1]) for x in TABLES[name][0].split(", ")]
        tx.replace_company_rows(name, rows.select(*typed), companies=ids)
    order = [c for c in ("folder", "quarter", "pos") if c in a.sentences.columns]
    if renew:
        tx.renew_vectors(a.sentences, embed(F.col("sentence")), order, folders.withColumnRenamed("folder_name", "company"))
    else:
        tx.append_vectors(a.sentences, embed(F.col("sentence")), order)
    names = a.sentences.select("company").distinct().withColumn("name", display_name(F.col("company"), strict=False))
    explained = explain(tx.vectors(), names, embed, answer).drop("answered")
    payload = assemble(a.series, a.risk, _typed_claims(a.claims), explained, ["quarter", "sentence", "metric"], attributes=a.attributes)
    tx.save_analysis(keyed(payload).select("company_id", "mode", "result_json", F.expr("unix_micros(current_timestamp())").alias("seq")))
    tx.upsert_companies(folders.select("folder_name", F.lit("ready").alias("status"), F.lit(None).cast("string").alias("error_msg"), F.expr("unix_micros(current_timestamp())").alias("seq")))


def run_each(spark: SparkSession, root: str, store: Store, companies: list[str], **settings) -> dict[str, str]:
    """All ``companies`` in one plan; where that fails, in halves, down to the companies that fail alone. Such a company is run
    without its filings: if only they were at fault, its claims stay unverified and it is ready. Else it gets the status error
    with the message, which is also returned by company; the others' results stand."""
    if not companies:
        return {}
    try:
        run(spark, root, store, companies, **settings)
        return {}
    except Exception as e:  # noqa: BLE001  kept with the company
        if len(companies) > 1:
            half = len(companies) // 2
            return run_each(spark, root, store, companies[:half], **settings) | run_each(spark, root, store, companies[half:], **settings)
        if settings.get("facts", filings) is not None:
            return run_each(spark, root, store, companies, **settings | {"facts": None})
        seq = F.expr("unix_micros(current_timestamp())").alias("seq")
        store.upsert_companies(spark.createDataFrame([(companies[0], "error", str(e))], "folder_name string, status string, error_msg string").select("*", seq))
        return {companies[0]: str(e)}


def _typed_claims(claims: DataFrame) -> DataFrame:
    for c, kind in (("result", "string"), ("actual_change", "double")):
        if c not in claims.columns:
            claims = claims.withColumn(c, F.lit(None).cast(kind))
    return claims


def explain(vectors: DataFrame, companies: DataFrame, embed: Callable[[Column], Column], answer: Callable[[Column], Column] | None, k: int = 6, about: str = QUERY) -> DataFrame:
    """company, explanation, positive, negative, answered.

    ``companies``: company and the name that its query holds. Its context are the rows of ``vectors`` (with the company as
    a column) nearest to the query. Without a model, a context or an answer the fixed answer stands and ``answered`` is false.
    """
    none = F.array().cast("array<string>")
    if answer is None:
        return companies.select("company", F.lit(EMPTY_ANSWER).alias("explanation"), none.alias("positive"), none.alias("negative"), F.lit(False).alias("answered"))
    queries = companies.select("company", embed(F.concat(F.col("name"), F.lit(f" {about} {SUFFIX_EXPLAIN}"))).alias("query"))
    asked = companies.select("company").join(company_contexts(vectors, queries, k), "company", "left")
    parsed = asked.withColumn("__a", F.when(F.col("context").isNotNull(), parse_answer(answer(F.col("context")))))
    made = F.coalesce(F.col("__a.explanation") != "", F.lit(False))
    return parsed.select("company", F.coalesce("__a.explanation", F.lit(EMPTY_ANSWER)).alias("explanation"), F.coalesce("__a.positive", none).alias("positive"), F.coalesce("__a.negative", none).alias("negative"), made.alias("answered"))


def rebuild(store: Store, embed: Callable[[Column], Column] = hashed_embedding, answer: Callable[[Column], Column] | None = None) -> int:
    """Vectors from the stored claims of ready companies that have none, and explanation, signals and verdict of all modes
    asked anew over the stored vectors; returns the number of vectors. A company without claims or an answer keeps its payloads.
    """
    return store.transact(lambda tx: _rebuild(tx, embed, answer))


def _rebuild(tx: Transaction, embed: Callable[[Column], Column], answer: Callable[[Column], Column] | None) -> int:
    ready = tx.read("companies").where("status = 'ready'").select(F.col("id").alias("company_id"), F.col("display_name").alias("company"), "folder_name")
    claims = tx.read("claims").where("length(sentence) > 0").join(ready, "company_id")
    n = tx.append_vectors(claims.withColumn("result", F.coalesce("result", F.lit("None"))).withColumn("reason", F.lit("CLAIM")), embed(F.col("sentence")), ["quarter", "sentence", "metric"])
    if answer is None:
        return n
    asked = ready.join(claims.select("company_id").distinct(), "company_id", "left_semi")
    names = asked.select("company_id", F.explode(F.array_distinct(F.array("company", "folder_name"))).alias("__stored"))  # vectors bear the one or the other
    vectors = tx.read("vectors").withColumn("__stored", F.col("metadata")["company"]).join(names, "__stored").withColumn("company", F.col("company_id"))
    explained = cut(explain(vectors, asked.select(F.col("company_id").alias("company"), F.col("company").alias("name")), embed, answer, about=REBUILD_QUERY).where("answered").withColumnRenamed("company", "company_id"), "explained")
    old = tx.read("analysis_cache").where("mode = 'full'").select("company_id", "result_json")
    modes = explained.join(old, "company_id", "left").withColumn("mode", F.explode(F.array(*[F.lit(m) for m in ("full", "earnings", "financial")])))
    patch = F.to_json(F.struct("mode", signals(F.col("positive"), "P").alias("positive_signals"), signals(F.col("negative"), "N").alias("negative_signals"), "explanation", verdict_label(F.size("positive"), F.size("negative")).alias("verdict")))
    as_map = lambda c: F.from_json(F.coalesce(c, F.lit("{}")), "map<string,variant>")
    rows = modes.withColumns({"__old": as_map(F.col("result_json")), "__new": as_map(patch)})
    kept = F.map_filter("__old", lambda key, _: ~F.array_contains(F.map_keys("__new"), key))
    tx.save_analysis(rows.select("company_id", "mode", F.to_json(F.map_concat(kept, "__new")).alias("result_json"), F.expr("unix_micros(current_timestamp())").alias("seq")))
    return n
