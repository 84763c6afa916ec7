"""A corpus pipeline of five stages, each calling one training-data operator.

Stages are functions of (spark, docs, sf_dir). Each stage's rows are written as Parquet to the
folder that driver and executors share, and read again as the next stage's documents. All stages
but the last return the columns of documents. Every stage takes nulls in any column, empty and very
long texts, repeated rows, extra columns of clashing names and empty tables; each operator's
docstring says what it does with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from packetloom.llm._common import drop_tables, materialize, table, tables_made
from packetloom.llm.decontam import remove_contaminated
from packetloom.llm.mixing import mix
from packetloom.llm.pii import redact
from packetloom.llm.simhash import near_dedup
from packetloom.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic; null and empty texts score as texts without words."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class: that with the least doc_id. Texts without words are one class."""
    return near_dedup(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item (an item of fewer words than a window is one window). Null and empty texts stay."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars follows the new text. Null texts stay null."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix of sources wants; _copy numbers the copies from 1. Texts without words take the whole part of their source's rate."""
    return mix(docs)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii", pii),
    ("mixing", mixing),
]

#: The first stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to the documents of sf_dir; a stage's own tables go once its rows are written."""
    docs = table(spark, sf_dir, "documents")
    since = tables_made()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
            drop_tables(since, docs)
    return docs
