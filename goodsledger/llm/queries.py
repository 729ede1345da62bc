"""Queries over the operators of this package, with production settings, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from goodsledger.llm import bpe, exact_dedup, languages, licenses, packing, quality_model, quality_rules, secrets, simhash
from goodsledger.llm import toxicity, url_filter, vector_codes, whitening
from goodsledger.llm.common import read


def op1_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op2_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(read(spark, sf_dir, "pages"))


def op3_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read(spark, sf_dir, "documents"))


def op7_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(read(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"))


def op9_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_license_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_labels(read(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(read(spark, sf_dir, "embeddings"))


def op12_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_vectors(read(spark, sf_dir, "embeddings"))


def op13_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.language_predictions(read(spark, sf_dir, "documents"))


EXACT_SQL = """
with hashed as (select doc_id, sha256(coalesce(text, '')) as text_sha256, coalesce(text, '') as body from documents),
     kept as (select body, max(doc_id) as keep_id, count(*) as group_size from hashed group by body)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from hashed join kept using (body)
"""


QUERIES = (
    op1_pack_documents, op2_url_verdicts, op3_exact_duplicates, op4_quality_rules, op5_toxicity,
    op6_simhash_components, op7_secret_spans, op8_byte_bpe, op9_quality_scores, op10_license_labels,
    op11_vector_codes, op12_whitened_embeddings, op13_languages,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: query for query in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_verdicts": url_filter.verdict_sql(),
        "op3_exact_duplicates": EXACT_SQL,
        "op7_secret_spans": secrets.spans_sql(),
        "op10_license_labels": licenses.labels_sql(),
        "op11_vector_codes": vector_codes.codes_sql(),
    }
