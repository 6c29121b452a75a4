"""One query for each operator, over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontaminate, divergence, licenses, line_dedup, lm_score, packing, quality, simhash, toxicity, trie, zstd_ids


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(_read(spark, sf_dir, "documents"), pieces=400_000)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled as of high quality."""
    docs = _read(spark, sf_dir, "documents")
    return lm_score.score(docs, _read(spark, sf_dir, "labels").where(F.col("quality") == 1))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(_read(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(_read(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.parse(_read(spark, sf_dir, "conversations"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op10_zstd_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zstd_ids.digest(_read(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the trie of rebuilt conversations."""
    return trie.trie(_read(spark, sf_dir, "conversations"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of sources of each language, and each source's 200 most telling terms."""
    return divergence.audit(_read(spark, sf_dir, "documents"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on the labelled quality of documents, then applied to all of them."""
    docs = _read(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, _read(spark, sf_dir, "labels"))).drop("content_share")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_multi_index": op1_multi_index,
    "op2_toxicity": op2_toxicity,
    "op3_packing": op3_packing,
    "op4_decontaminate": op4_decontaminate,
    "op5_cross_entropy": op5_cross_entropy,
    "op6_line_dedup": op6_line_dedup,
    "op7_simhash": op7_simhash,
    "op8_chat": op8_chat,
    "op9_licenses": op9_licenses,
    "op10_zstd_ids": op10_zstd_ids,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_divergence": op12_divergence,
    "op13_quality": op13_quality,
}

ORACLE_SQL: dict[str, str] = {"op6_line_dedup": line_dedup.SQL, "op11_prefix_trie": trie.SQL, "op12_divergence": divergence.SQL}
