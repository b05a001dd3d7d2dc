"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tankline.llm.co_training import quality_scores
from tankline.llm.common import documents, table
from tankline.llm.exact_dedup import exact_duplicates
from tankline.llm.fingerprints import compare_with_edits
from tankline.llm.html_text import extract_text
from tankline.llm.jaccard_join import jaccard_classes
from tankline.llm.language_id import language_id
from tankline.llm.language_model import score_documents
from tankline.llm.merkle import verify_tampered
from tankline.llm.mixing import mix
from tankline.llm.packing import pack_documents
from tankline.llm.quality_rules import quality_rules
from tankline.llm.toxicity import toxicity
from tankline.llm.whitening import whiten


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(documents(spark, sf_dir))


def op2_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality_rules(documents(spark, sf_dir)).select("doc_id", *columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    return pack_documents(documents(spark, sf_dir)).select(*columns)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify_tampered(documents(spark, sf_dir))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_fingerprints,
        op2_katz_backoff,
        op3_html_extraction,
        op4_quality_rules,
        op5_jaccard_join,
        op6_mixing,
        op7_packing,
        op8_language_id,
        op9_quality_classifier,
        op10_toxicity,
        op11_merkle_manifest,
        op12_exact_dedup,
        op13_whitening,
    )
}
