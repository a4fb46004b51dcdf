"""Registered queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexmill.llm import bpe, decontam, exactdups, fm, html, licenses, resampling, rules, simhash, sql, substrings, tokenfiles, toxicity, whitening
from codexmill.llm.common import table


def vocabulary() -> str:
    """Path of the byte-level vocabulary file: CODEXMILL_VOCABULARY, or the installed public file."""
    found = os.environ.get("CODEXMILL_VOCABULARY")
    if found:
        return found
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = licenses.document_files(table(spark, sf_dir, "documents"))
    found = licenses.license_scan(files)
    return found.withColumn("doc_id", F.element_at(F.split("path", "/"), -1).cast("long")).select("doc_id", *found.columns)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_files(table(spark, sf_dir, "documents"), vocabulary())


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary())


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_duplicates(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdups.exact_duplicates(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_quality_rules, op2_license_scan, op3_quality_classifier, op4_token_files, op5_html_text, op6_decontamination, op7_bpe, op8_substring_dedup, op9_simhash, op10_toxicity, op11_exact_dedup, op12_whitening, op13_resampling)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op6_decontamination": sql.OP6, "op2_license_scan": sql.OP2, "op11_exact_dedup": sql.OP11, "op13_resampling": sql.OP13}
