"""Queries of this subpackage: opN_<name>(spark, sf_dir), each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, jaccard, mixing, packing, pii, quality_classifier, quality_rules, sql, token_counts, token_orc, url_filter
from .common import table_path
from .tokens import vocabulary

LIMIT = 2048


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op2_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = table_path(spark, "tokens-orc")
    token_orc.write_tokens(_docs(spark, sf_dir), path, vocabulary("byte_bpe_50k.json"), end_id=2)
    return token_orc.with_crc(token_orc.read_tokens(spark, path))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.prefix_counts(_docs(spark, sf_dir), vocabulary("word_bpe_49k.json"), LIMIT)


def op4_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix(_docs(spark, sf_dir))
    return m.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


def op5_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(_docs(spark, sf_dir), n=4, percent=85)


#: The rules of the contract: host, path, whether they block.
URL_RULES = [url_filter.Rule("com", "/", False), url_filter.Rule("example.com", "/en/", True), url_filter.Rule("www.example.com", "/en/", False), url_filter.Rule("net", "/es/", True), url_filter.Rule("net", "/fr/", True)]


def op6_boosted_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), URL_RULES)


def op7_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality_rules.cascade(_docs(spark, sf_dir))
    failed = F.expr(" or ".join(f"({r.fails})" for r in quality_rules.RULES if r.base))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.col("failed_rule").isNull().alias("kept"))


def op8_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    left_out = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 3 == 1
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~left_out).select("doc_id", F.col("quality").alias("y"))
    scored, _ = quality_classifier.classify(_docs(spark, sf_dir), labels)
    return scored.select("doc_id", left_out.alias("held_out"), "score", "predicted")


def op9_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packing.pack(_docs(spark, sf_dir), vocabulary("word_bpe_49k.json"), end_id=1)
    return p.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


def op10_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pii.detect(_docs(spark, sf_dir).select("doc_id", "text"), keep_text=False).select(F.col("doc_id").cast("long").alias("doc_id"), "pii_base", "pii_spans")

    def n(kind: str):
        k = pii.KINDS.index(kind)
        return F.size(F.filter("pii_base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{kind}")

    return d.select("doc_id", *[n(k) for k in pii.BASE], F.sha2(pii.written("pii_base").cast("binary"), 256).alias("base_sha256"), pii.written("pii_spans").alias("spans"))


QUERIES = {f.__name__: f for f in (op1_projection_forest, op2_token_orc, op3_token_counts, op4_pareto_mix, op5_parity_join, op6_boosted_urls, op7_rule_cascade, op8_fourier_quality, op9_power_of_two_packing, op10_weak_pii)}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {"op4_pareto_mix": sql.MIX, "op5_parity_join": sql.JACCARD, "op7_rule_cascade": sql.RULES}
