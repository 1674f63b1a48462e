"""Queries of the text-corpus operators over the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import licenses, url_filter
from .chat import format_chats
from .decontaminate import leaks
from .html_text import extract
from .near_dedup import near_duplicates
from .packing import pack
from .quality import quality
from .token_counts import edited_counts
from .toxicity import toxicity
from .url_filter import filter_urls, labels_by_document


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, shingle=3, percent=85)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages, labels_by_document(pages, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("blocks")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_url_filters": op3_url_filters,
    "op4_decontamination": op4_decontamination,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_toxicity": op6_toxicity,
    "op7_html_extraction": op7_html_extraction,
    "op8_token_counts": op8_token_counts,
    "op9_license_scans": op9_license_scans,
    "op10_chat_formatting": op10_chat_formatting,
}
ORACLES: dict[str, str] = {"op3_url_filters": url_filter.oracle(), "op9_license_scans": licenses.oracle()}
