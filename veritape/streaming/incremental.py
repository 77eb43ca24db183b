"""Incremental runs: new files are noticed by a file stream, and the batch operators run on what each micro-batch touches."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veritape.functions.text import is_claim, is_valid_sentence, nlp_features, sentences
from veritape.plans import analysis
from veritape.session import shared_dir
from veritape.sinks import Store

FILES = "*.{txt,TXT,pdf,PDF,xml}"
MAX_FILES = 1000  # files of a micro-batch, and so the most companies that one touches
QUERY_ID = "sql.streaming.queryId"  # fixed value: the local property that names a stream in all its runs


def sentence_stream(spark: SparkSession, path: str) -> DataFrame:
    """Valid sentences of JSON files (company, quarter, raw_text) as they appear; stateless."""
    docs = spark.readStream.schema("company string, quarter string, raw_text string").json(path)
    each = docs.select("company", "quarter", F.posexplode(sentences(F.col("raw_text"))).alias("pos", "sentence"))
    return each.where(is_valid_sentence(F.col("sentence")))


def claim_stream(spark: SparkSession, path: str) -> DataFrame:
    rows = sentence_stream(spark, path).withColumn("__f", nlp_features(F.col("sentence")))
    return rows.where(is_claim(F.col("sentence"), F.col("__f"))).drop("__f")


def append_claims(spark: SparkSession, source: str, target: str, checkpoint: str | None = None) -> StreamingQuery:
    """Process what is there and stop: claims land in ``target`` by company, each micro-batch once."""
    query = claim_stream(spark, source).writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint or f"{shared_dir(spark)}/veritape/claims-stream")
    return query.format("parquet").partitionBy("company").option("path", target).start()


def touched(files: DataFrame, root: str) -> DataFrame:
    """``company`` of the files (path) under ``root`` that stand in a company's folder or in a folder of it."""
    jroot = files.sparkSession._jvm.org.apache.hadoop.fs.Path(root)
    base = jroot.getFileSystem(files.sparkSession.sparkContext._jsc.hadoopConfiguration()).makeQualified(jroot).toString().rstrip("/")
    parts = F.split(F.substring("path", len(base) + 2, 1 << 20), "/")
    return files.select(parts.alias("p")).where(F.size("p").between(2, 3)).select(F.col("p")[0].alias("company")).distinct()


def apply_batch(spark: SparkSession, root: str, store: Store, companies: list[str], stream: str, batch: int, **settings: Any) -> dict[str, str] | None:
    """Analyse ``companies`` anew and note ``batch`` of ``stream`` in the store's log; nothing, and None, if it is noted already.

    The note is a commit of its own, after those of the companies, which may fail one by one. A company's rows, vectors too, are replaced as a whole, so a batch that was cut off before its note may be run again.
    """
    if store.latest().streams.get(stream, -1) >= batch:
        return None
    failed = analysis.run_each(spark, root, store, companies, renew=True, **settings)
    store.transact(lambda tx: tx.note_batch(stream, batch))
    return failed


def follow(spark: SparkSession, root: str, store: Store, checkpoint: str | None = None, max_files: int = MAX_FILES, forever: bool = False, on_failed: Callable[[dict[str, str]], None] | None = None, **settings: Any) -> StreamingQuery:
    """Keep the tables of ``store`` as a batch run over the tree would leave them, from the files that arrive.

    Each micro-batch takes up to ``max_files`` new files and analyses the companies that they belong to, with all of these
    companies' files: ranks of year folders, series and claims depend on the others. So a batch costs what its companies
    hold, not what the tree holds, and after the last batch claims, series, risk, vectors and payloads are those of one
    batch run; only the numbers of companies follow their arrival. A company that fails has the status error and is passed
    to ``on_failed``; its next file brings it back. ``settings`` are those of :func:`analysis.run`.

    Without ``forever`` it processes what is there and stops. A file that is changed under its old name, or deleted, isn't
    noticed until another file of its company arrives.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    new = files.option("recursiveFileLookup", True).option("pathGlobFilter", FILES).option("maxFilesPerTrigger", max_files).load(root).select("path")

    def each(batch: DataFrame, number: int) -> None:
        names = sorted(r.company for r in touched(batch, root).collect())  # max_files at most
        stream = batch.sparkSession.sparkContext.getLocalProperty(QUERY_ID)
        failed = apply_batch(spark, root, store, names, stream, number, **settings)
        if failed and on_failed:
            on_failed(failed)

    out = new.writeStream.option("checkpointLocation", checkpoint or f"{store.root}/stream").foreachBatch(each)
    return (out if forever else out.trigger(availableNow=True)).start()
