"""Company trees: <root>/<company>/<year folder>/<file>, or files right in a company folder that has no year folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritape.functions.numbers import recency_weight
from veritape.functions.quarters import file_quarter, folder_year
from veritape.functions.text import clean_lines

FALLBACK_YEAR = 2024


def listing(spark: SparkSession, root: str, pattern: str, content: bool = True, company: str | list[str] | None = None) -> DataFrame:
    """company, folder, file, year, weight, content of the files whose name matches ``pattern`` (a regular expression).

    A company's folder counts if a year can be read from its name; without any, its own files count
    with the year 2024. Weights fall with the rank of the year folder, ties by name. ``company`` (or
    several) narrows the listing before anything is read. A missing root raises.
    """
    jroot = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = jroot.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(jroot):
        raise FileNotFoundError(root)
    base = fs.makeQualified(jroot).toString().rstrip("/")
    top = [f"{base}/{c}" for c in ([company] if isinstance(company, str) else company)] if company else base
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(top)
    parts = F.split(F.expr("substring(path, length(:b) + 2)".replace(":b", "'" + base.replace("'", "\\'") + "'")), "/")
    rows = files.select(parts.alias("p"), *([F.col("content")] if content else [])).where(F.size("p").between(2, 3))
    rows = rows.select(F.col("p")[0].alias("company"), F.when(F.size("p") == 3, F.col("p")[1]).alias("folder"), F.element_at("p", -1).alias("file"), *(["content"] if content else [])).withColumn("year", folder_year(F.col("folder")))
    # folder facts need no file content
    folders = files.select(parts.alias("p")).where(F.size("p") == 3).select(F.col("p")[0].alias("company"), F.col("p")[1].alias("folder")).distinct().withColumn("year", folder_year(F.col("folder"))).where("year is not null")
    w = Window.partitionBy("company").orderBy(F.desc("year"), "folder")
    ranked = folders.withColumn("weight", recency_weight(F.row_number().over(w) - 1)).select("company", "folder", "weight")
    dated = folders.select("company").distinct().withColumn("__dated", F.lit(True))
    rows = rows.where(F.col("file").rlike(pattern)).join(ranked, ["company", "folder"], "left").join(dated, "company", "left")
    used = (F.col("folder").isNotNull() & F.col("year").isNotNull()) | (F.col("folder").isNull() & F.col("__dated").isNull())
    return rows.where(used).withColumn("year", F.coalesce("year", F.lit(FALLBACK_YEAR))).withColumn("weight", F.coalesce("weight", F.lit(1.0))).drop("__dated")


def decode_text(content: Column) -> Column:
    """UTF-8, or Latin-1 where it is not."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def pdf_pages(extract: Callable[[bytes], list[str]]) -> Callable[[Column], Column]:
    """A column function from PDF bytes to page texts with ``extract``, in Arrow batches; a file that fails gives null."""

    @F.pandas_udf("array<string>")
    def pages(content: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in content:
            out = []
            for data in batch:
                try:
                    out.append(extract(bytes(data)))
                except Exception:  # noqa: BLE001  any broken file is left out
                    out.append(None)
            yield pd.Series(out)

    return pages


def transcripts(spark: SparkSession, root: str, extract_pdf: Callable[[bytes], list[str]] | None = None, company: str | list[str] | None = None) -> DataFrame:
    """company, quarter, weight, source, raw_text, filename of all readable .txt and (with ``extract_pdf``) .pdf files; blank ones go."""
    files = listing(spark, root, r"(?i)\.(txt|pdf)$" if extract_pdf else r"(?i)\.txt$", company=company)
    plain = files.where(F.col("file").rlike(r"(?i)\.txt$")).withColumn("raw_text", clean_lines(decode_text(F.col("content"))))
    if extract_pdf:
        pages = F.filter(F.transform(pdf_pages(extract_pdf)(F.col("content")), clean_lines), lambda x: F.trim(x) != "")
        plain = plain.unionByName(files.where(F.col("file").rlike(r"(?i)\.pdf$")).withColumn("raw_text", F.array_join(pages, "\n")))
    kept = plain.where(F.trim("raw_text") != "")
    return kept.select("company", file_quarter(F.col("file"), F.col("year")).alias("quarter"), "weight", F.lit("call_transcript").alias("source"), "raw_text", F.col("file").alias("filename"), "folder")


def has_files(spark: SparkSession, root: str, pattern: str = r"\.xml$") -> DataFrame:
    """Companies that have a matching file at any depth."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    q = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(q).select("path").where(F.col("path").rlike(pattern))
    return files.select(F.split(F.substring("path", len(q) + 2, 1 << 20), "/")[0].alias("company")).distinct()
