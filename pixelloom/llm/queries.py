"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pixelloom.llm import hard_negatives, language, licenses, main_text, merkle, mixing, near_documents, near_vectors, nearest, packing, pii, token_files, urls
from pixelloom.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(check: str | None = None):
    """Register a function under its own name, with its checking SQL if SQL can express it."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if check is not None:
            CHECKS[fn.__name__] = check
        return fn

    return add


@query(licenses.check_sql())
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


@query()
def op2_near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents.near_documents(read(spark, sf_dir, "documents"))


@query()
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digest(read(spark, sf_dir, "documents"))


@query(mixing.CHECK)
def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(read(spark, sf_dir, "documents"))


@query()
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(read(spark, sf_dir, "documents"))


@query()
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


@query()
def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(read(spark, sf_dir, "embeddings"))


@query()
def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(read(spark, sf_dir, "embeddings"))


@query(urls.check_sql())
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(read(spark, sf_dir, "pages"))


@query()
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


@query(merkle.CHECK)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(read(spark, sf_dir, "documents"))


@query(hard_negatives.CHECK)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine_embeddings(read(spark, sf_dir, "embeddings"))


@query(main_text.CHECK)
def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(read(spark, sf_dir, "pages"))
