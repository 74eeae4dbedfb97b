"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, jaccard, langid, licenses, mixing, oracle, packing, quality, runs, secretscan, topk, vecdedup, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out_languages(_table(spark, sf_dir, "documents"))


def op5_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdedup.near_duplicates(_table(spark, sf_dir, "embeddings"), 0.98)


def op6_jaccard_tsearch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"), 75)


def op7_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.held_out_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(_table(spark, sf_dir, "documents"),
                          public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op9_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.digest(_table(spark, sf_dir, "documents"))


def op10_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op11_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(_table(spark, sf_dir, "documents"))


def op12_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(_table(spark, sf_dir, "documents"))


def op13_hat_trie_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"), least=30, longest=4, top=2000)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_language_id, op2_bm25_packing, op3_bit_sliced_topk, op4_byte_bpe, op5_pca_tiles, op6_jaccard_tsearch,
        op7_quality_cnn, op8_license_rules, op9_linked_secrets, op10_warc_zstd, op11_lyndon_runs,
        op12_pivotal_mixing, op13_hat_trie_collocations, pipeline)}


def oracle_sql() -> dict[str, str]:
    return oracle.sql()
