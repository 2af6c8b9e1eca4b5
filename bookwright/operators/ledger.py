"""Processed-once bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookwright.functions.text import py_strip


def unprocessed(inputs: DataFrame, ledger: DataFrame, key: str = "report_id") -> DataFrame:
    """Inputs the ledger does not name."""
    return inputs.join(ledger.select(key), key, "left_anti")


def _label_key(df: DataFrame) -> DataFrame:
    return df.withColumn("_key", F.lower(py_strip(F.coalesce(F.col("name"), F.lit("")))))


def upsert_labels(labels: DataFrame, wanted: DataFrame) -> DataFrame:
    """The labels with a row appended for every wanted name that none matches.

    Names match after stripping and in any case; a blank name is an error. Of several wanted
    spellings the first in text order is created. New rows have a NULL ``label_id``.
    """
    blank = F.raise_error(F.lit("label name must not be empty"))
    asked = _label_key(wanted.select("name"))
    asked = asked.withColumn("_key", F.when(F.col("_key") == "", blank.cast("string")).otherwise(F.col("_key")))
    known = _label_key(labels).select("_key").distinct()
    missing = asked.join(known, "_key", "left_anti").groupBy("_key").agg(F.min(py_strip(F.col("name"))).alias("name"))
    id_type = labels.schema["label_id"].dataType
    created = missing.select(F.lit(None).cast(id_type).alias("label_id"), "name")
    return labels.select("label_id", "name").unionByName(created)


def resolve_labels(labels: DataFrame, wanted: DataFrame) -> DataFrame:
    """Id of the first label, by id, that matches each wanted name."""
    first = Window.partitionBy("_key").orderBy("label_id")
    known = _label_key(labels).withColumn("_n", F.row_number().over(first)).filter(F.col("_n") == 1)
    return _label_key(wanted.select("name")).join(known.select("_key", "label_id"), "_key", "left").drop("_key")
