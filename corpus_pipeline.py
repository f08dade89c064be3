"""From raw documents to token ids: each stage takes what its predecessor wrote.

Defined results: a null or empty text is scored, has no shingles and so no duplicates, holds no secret, has 0 words and no ids; a null source is a source of
its own; rows with a null doc_id have no duplicates, and of rows with one doc_id the one whose text comes first stays. Rows that repeat a doc_id and
text are one document after near-dedup. Empty tables give empty tables; other columns pass through, whatever their names.
"""

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import dedup, mixing, pieces, quality, secrets
from vellum.llm.common import documents, forget, keep_out, scope


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return dedup.keep(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by their kind; every document stays."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for: floor(rate) times, and once more with the fraction for its probability."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, held against the reference encoder and decoded again: columns ids, parity and round_trip are added."""
    return pieces.encoded(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

#: A learned score, similarity and a tokenizer are beyond SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents after all stages. What a stage stored, and what it read, is removed as soon as its result is written."""
    docs = before = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        with scope(spark):
            docs = keep_out(stage(spark, before, sf_dir), "stage")
        if i:
            forget(before)
        before = docs
    return docs
