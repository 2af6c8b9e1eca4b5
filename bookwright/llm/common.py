"""Helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_CHARS = 1_000_000


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def text_key(name: str = "text") -> Column:
    """Tells rows apart that share an id but not the text."""
    return F.xxhash64(text_or_empty(name)).alias("text_key")


def same_row(left: DataFrame, right: DataFrame, id_col: str, key: str = "_key") -> Column:
    """Rows of one id (null too) and text; ``right`` has ``doc_id`` and ``text_key``."""
    return left[id_col].eqNullSafe(right["doc_id"]) & (left[key] == right["text_key"])


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` bytes of text; a longer text is a run of its own."""
    if batch.num_rows == 0:
        return
    ends = np.cumsum(np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64))
    start, taken = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, taken + most, side="right")))
        yield batch.slice(start, stop - start)
        start, taken = stop, int(ends[stop - 1])


def map_texts(df: DataFrame, column: str, schema: str, make: Callable[[], Callable], most: int = SLICE_CHARS) -> DataFrame:
    """``make()`` runs once per task and returns a function of a run of rows that gives output columns.

    The function gets a ``RecordBatch`` and returns a dict of lists or arrays in the order of ``schema``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = None
        for batch in batches:
            for part in slices(batch, column, most):
                fn = fn or make()
                yield pa.RecordBatch.from_pydict(fn(part))

    return df.mapInArrow(run, schema)
