"""Queries of this subpackage, with production parameters, and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from arborlake.llm import warc
from arborlake.llm.ann import nearest
from arborlake.llm.decontaminate import benchmark_matches, contamination_digest
from arborlake.llm.langid import document_languages, page_languages
from arborlake.llm.license import license_report
from arborlake.llm.linededup import drop_boilerplate
from arborlake.llm.mixing import mix_documents
from arborlake.llm.oracle import ORACLE  # noqa: F401
from arborlake.llm.simhash import simhash_components
from arborlake.llm.tokenfile import encode_corpus
from arborlake.llm.urlfilter import judge_urls
from arborlake.runtime import read_table

# The rules (action, host, path prefix).
URL_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(read_table(spark, sf_dir, "documents"))


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_archive(read_table(spark, sf_dir, "pages"))
    return warc.record_columns(warc.read_archive(spark, archive)).drop("url")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All evidence: visible text, the markup's language, the address suffix and the host's prior of raw pages."""
    return page_languages(read_table(spark, sf_dir, "pages"), keep=["page_id"])


def language_id_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fusion over the corpus table as the pipeline has it: declared language and source, no suffix."""
    return document_languages(read_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digest(benchmark_matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), ["doc_id"]))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), every=50, k=5)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(read_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(read_table(spark, sf_dir, "pages"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read_table(spark, sf_dir, "documents"), shingle=3, radius=2)


_ALL = (
    op1_license_scan, op2_warc_archive, op3_language_id, op4_decontaminate, op5_nearest_neighbours, op6_mix_sources, op7_url_filter,
    op8_line_dedup, op9_token_files, op10_simhash_near_dedup, language_id_documents,
)
QUERIES = {f.__name__: f for f in _ALL}
