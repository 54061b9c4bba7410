"""The registered queries of the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch.llm import (bestfit, credentials, decontaminate, exact, filters, language, licenses, minhash, packing, pii, quality,
                            triples, whitening)
from driftwatch.llm.common import documents

VOCABULARY = "word_bpe_49k.json"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contamination(documents(spark, sf_dir), items).drop("items")


@query
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir))


@query
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(documents(spark, sf_dir))


@query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir)).drop("base_spans")


def vocabulary(name: str = VOCABULARY) -> str:
    """Place of the tokenizer's file on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), vocabulary(), with_ids=False)


@query
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.secrets(documents(spark, sf_dir)).drop("base_spans")


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(documents(spark, sf_dir))


@query
def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(documents(spark, sf_dir)).drop("text_key")


@query
def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triples.scores(documents(spark, sf_dir))


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return rows.withColumn("deviation", F.col("deviation").cast("long"))


@query
def op11_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.packed(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), with_ids=False)
