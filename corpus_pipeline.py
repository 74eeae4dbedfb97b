"""Training-corpus pipeline: five stages over `documents`, each written as Parquet and read again.

1. language_id: documents in none of the learned languages go: those without letters or text, and
   those whose best cosine with a language's prototype is below what their number of trigrams asks for.
2. quality: documents that the byte-level network scores below 0.5 go.
3. near_duplicates: of each group of near copies (five-word shingles, similarity 0.75 or more) one
   document stays, the one with the smallest id.
4. secrets: the secret spans of each text, base and linked, are replaced by a mark; every document stays.
5. packing: the documents become token windows; this stage returns the pieces.

Stages 1 to 4 return the columns of documents. Defined results: of rows that repeat doc_id and text,
stage 3 keeps one; a row without doc_id counts there as having the largest id, equal texts the same
one; rows that share a doc_id with different texts stay if one of them does. SQL can't express the stages (they learn models and tokenize), so
ORACLE_SQL is None; tests hold each stage's decisions against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm import jaccard, langid, packing, quality, secretscan
from varloom.llm.common import scratch_path

TOKENIZER = "word_bpe_49k.json"
ORACLE_SQL = None


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name in docs.columns:
        name += "_"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.in_known_language(docs, langid.train(docs))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality.score(F.col("text"), model) >= 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key, name = _free(docs, "key"), _free(docs, "name")
    # Rows without an id get one from their text, above all real ones.
    own = F.lit(1 << 62) + F.xxhash64("text").bitwiseAND((1 << 61) - 1)
    rows = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), own))
    groups = jaccard.join(rows, id_col=key)
    stay = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(key)).distinct()
    kept = rows.join(stay, key, "left_semi").withColumn(name, F.xxhash64("text"))
    return kept.dropDuplicates([key, name]).select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secretscan.redact(docs).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id), ("quality", quality_filter), ("near_duplicates", near_duplicates),
    ("secrets", secrets), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
