"""A training corpus from ``documents``: five stages, each written and read again.

``STAGES`` names them in order; each takes the session, what the stage before kept and the folder of the tables.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookwright.llm import dart_minhash, line_join, outliers, packing, secret_ledger
from bookwright.llm.common import same_row, text_key
from bookwright.session import materialise, scratch_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SEQUENCE = 1024
END_ID = 2
#: The tests hold this stage to one edit; op9 lets the edits grow with the line.
LINE_EDITS = 1


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule, or are outliers of their language and source, go."""
    rejected = outliers.quality(docs).filter(~F.col("kept")).select("doc_id", "text_key").distinct()
    keyed = docs.withColumn("_key", text_key())
    return keyed.join(rejected, same_row(keyed, rejected, "doc_id"), "left_anti").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, but for ``LINE_EDITS``, go, and documents that lose all their words thereby."""
    return _counted(line_join.drop_lines(docs, materialise(line_join.dropped_lines(docs, max_edits=LINE_EDITS), "dropped")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates, the document with the least id stays."""
    return dart_minhash.first_of_class(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; all documents stay."""
    return _counted(secret_ledger.redact(docs, scratch_path(spark, "ledger")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids (little-endian, 32 bits each) and their places in the sequences."""
    return packing.pack_documents(docs, TOKENIZER, SEQUENCE, END_ID)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: Estimates, signatures and packing are no SQL; the tests hold run() against a version in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
