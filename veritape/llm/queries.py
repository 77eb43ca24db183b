"""One query per corpus operator: production parameters, whole tables, full results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritape.llm import bpe, cover_tree, funnels, html_blocks, infill, jaccard, langid, licenses, pfair, pii, quality, secrets, suffix_dedup
from veritape.session import table


def op1_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


def op3_secret_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op6_bpe_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = pfair.mix(docs, pfair.shares_of(docs, shares=pfair.SHARES))
    return mixed.select("doc_id", "source", "mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_order")


def op8_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"), width=3, num=9, den=10)


def op10_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_documents(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    restored = infill.restore(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op12_funnel_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnels.count_funnels(table(spark, sf_dir, "clicks"))


def op13_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("licenses")


QUERIES = {
    "op1_cover_tree": op1_cover_tree,
    "op2_pii_boosting": op2_pii_boosting,
    "op3_secret_novelty": op3_secret_novelty,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_html_blocks": op5_html_blocks,
    "op6_bpe_word_table": op6_bpe_word_table,
    "op7_pfair_mix": op7_pfair_mix,
    "op8_divergence_rules": op8_divergence_rules,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_rank_order_language": op10_rank_order_language,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_funnel_sweep": op12_funnel_sweep,
    "op13_license_rules": op13_license_rules,
}

ORACLES: dict[str, str] = {
    "op7_pfair_mix": pfair.oracle(pfair.SHARES),
    "op11_fill_in_middle": infill.oracle(),
    "op12_funnel_sweep": funnels.oracle(),
    "op13_license_rules": licenses.oracle(),
}
