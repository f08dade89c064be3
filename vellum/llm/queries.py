"""The queries of this subpackage: name to (spark, sf_dir) -> DataFrame, and their SQL where SQL can express it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import chat, dedup, embeddings, fingerprint, mixing, pieces, quality, secrets, sharding, urlfilter
from vellum.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(documents(spark, sf_dir))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(documents(spark, sf_dir))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(documents(spark, sf_dir))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.report(documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.report(documents(spark, sf_dir))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.report(documents(spark, sf_dir))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.report(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(chat.with_tricky(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_mixing, op2_sharding, op3_secrets, op4_embeddings, op5_minhash, op6_quality, op7_url_filter, op8_sentencepiece, op9_fingerprint, op10_chat)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.ORACLE, "op2_sharding": sharding.oracle(), "op7_url_filter": urlfilter.ORACLE, "op10_chat": chat.ORACLE}
