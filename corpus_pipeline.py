"""The training-corpus pipeline: toxicity, line dedup, SimHash near-dedup, decontamination, packing.

Every stage takes rows as they come: null and empty texts, null or repeated doc_ids, nulls in other
columns and further columns (which are left out) don't stop it, and an empty table gives an empty one.
What a stage does with such rows is said at each.

A stage's result is lazy and reads tables of its own. It has to be written before the next stage is called, which
deletes these tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from cloudloom.llm import decontaminate, line_dedup, packing, simhash, toxicity
from cloudloom.llm.shared import drop_path, made, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_TABLES: list[str] = []


def _after_others(stage: Stage) -> Stage:
    """The stage, once the tables of the stages before it are deleted."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _TABLES:
            drop_path(spark, _TABLES.pop())
        before = set(made())
        out = stage(spark, docs, sf_dir)
        _TABLES.extend(p for p in made() if p not in before)
        return out

    return run


def _counted(docs: DataFrame) -> DataFrame:
    return docs.selectExpr(*COLUMNS[:-1], "length(text) AS n_chars")


@_after_others
def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on this run's labels, doesn't reject; each row by its text alone, a null text as an empty one."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs.select(*COLUMNS), toxicity.train(docs, labels))


@_after_others
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without their repeated lines. Rows of one doc_id count as one document, null doc_ids as the smallest; a null text stays null."""
    return _counted(line_dedup.dedup_lines(docs.select(*COLUMNS)))


@_after_others
def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group; empty texts are alike, rows with a null doc_id all stay, and so do all rows of the document that stays."""
    return simhash.dedup(docs.select(*COLUMNS))


@_after_others
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of `benchmark`; each row by its text alone, null texts hold nothing."""
    return decontaminate.drop_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


@_after_others
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in training sequences; a null text is the end id alone, a null source a queue of its own."""
    return packing.digest(docs)


STAGES = [
    ("toxicity", clean),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", decontaminated),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is written and read again by the next."""
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if read:
            drop_path(spark, read)
        read = made()[-1]
    return STAGES[-1][1](spark, docs, sf_dir)
