"""Exact top-k by inner product over an impact-ordered index, score at a time.

Vectors hold whole numbers. A component is a sum of signed digits of falling worth (``STEPS``), and a block of
vectors is indexed as posting segments: one for each worth and digit, with the vectors and dimensions that
have it. Segments are processed by descending impact, for a batch of queries at once, adding to one
accumulator per query and vector. What a vector's unprocessed digits can still change is at most the product
of the norms of the query and of these digits. Once few vectors could still reach a query's k-th best lower
bound, processing stops and those are scored exactly; if that proof never comes, every segment is processed,
and the sums are exact themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS = (8, 2, 1)
BLOCK_ROWS = 8192
BATCH_ROWS = 2048
QUERIES_AT_ONCE = 256
#: Stop once so many vectors per wanted result are left on average.
ENOUGH = 16


class ImpactIndex:
    """Posting segments of a block of vectors, by descending impact."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest_query: int):
        self.ids, self.vectors = ids, vectors
        bound = int(np.abs(vectors).max(initial=0)) * largest_query * max(1, vectors.shape[1])
        # Accumulators are floating point, but hold whole numbers that they represent exactly.
        self.kind = np.float32 if bound < 2**23 else np.float64
        self.exact = bound < 2**52
        # Impact, signed postings, norms of what is left, and whether all digits of this worth are done.
        self.segments: list[tuple[int, np.ndarray, np.ndarray, bool]] = []
        rest = vectors.copy()
        for step in STEPS if self.exact else ():
            digits = rest // step if step == 1 else (rest + step // 2) // step
            for size in range(int(np.abs(digits).max(initial=0)), 0, -1):
                posted = np.sign(digits) * (np.abs(digits) == size)
                rest = rest - posted * (size * step)
                left = np.sqrt((rest.astype(np.float64) ** 2).sum(axis=1))
                self.segments.append((size * step, posted.astype(self.kind), left, size == 1))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query positions, vector positions and scores of each query's ``k`` best, ties to the smaller id."""
        own = query_ids[:, None] == self.ids[None, :]
        total = np.zeros(own.shape, self.kind)
        norms = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))[:, None]
        weights = queries.astype(self.kind)
        possible = ~own
        for impact, posted, left, judge in self.segments:
            total += (weights * self.kind(impact)) @ posted.T
            if not judge:
                continue  # the next segment still tells much
            slack = norms * left[None, :] + 1.0
            low = np.where(own, -np.inf, total - slack)
            if k < low.shape[1]:
                threshold = np.partition(low, low.shape[1] - k, axis=1)[:, -k][:, None]
                possible = ~own & (total + slack >= threshold)
                if possible.sum() <= ENOUGH * k * len(queries):
                    break
        rows, cols = np.nonzero(possible)
        scores = np.concatenate(
            [np.einsum("ij,ij->i", queries[r], self.vectors[c]) for r, c in zip(_runs(rows), _runs(cols), strict=True)]
        )
        order = np.lexsort((self.ids[cols], -scores, rows))
        rows, cols, scores = rows[order], cols[order], scores[order]
        first = np.searchsorted(rows, rows)
        best = np.arange(len(rows)) - first < k
        return rows[best], cols[best], scores[best]


def _runs(a: np.ndarray, size: int = 200_000) -> list[np.ndarray]:
    return [a[i : i + size] for i in range(0, max(1, len(a)), size)]


def whole_numbers(vector: Column, scale: int = 64) -> Column:
    """``floor(scale * x)`` of each component; null if the vector or one of them is null or not finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x))
    return F.when(good, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("vec_id").to_numpy()
    values = table.column("vector").combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return ids, flat.reshape(len(ids), -1) if len(ids) else flat.reshape(0, 0)


def top_k(df: DataFrame, queries: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of all other rows for every row where ``queries`` holds.

    Every block of rows is an index of its own, searched for every batch of queries; both have a bounded
    size, and each pair of them is a task's unit, so nothing is collected or broadcast. A query's best of all
    blocks are then ranked. Vectors that are null, or hold null or non-finite components, take no part, nor do
    rows without an id; only vectors of equal length meet. A row that is repeated counts once. Fewer than
    ``k`` others give as many rows; an empty table gives none. Other columns are not read.
    """
    rows = df.select(
        df[id_col].cast("long").alias("vec_id"),
        whole_numbers(df[vector_col], scale).alias("vector"),
        queries.alias("asks"),
    ).filter("vec_id IS NOT NULL AND vector IS NOT NULL").distinct()
    n, m = rows.agg(F.count("*"), F.count(F.when(F.col("asks"), 1))).first()
    blocks, batches = -(-max(n, 1) // BLOCK_ROWS), -(-max(m, 1) // BATCH_ROWS)
    dim = F.size("vector").alias("dim")
    every_batch = F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch")
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")
    batch = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(batches)).cast("int").alias("batch")
    candidates = rows.select("vec_id", "vector", dim, block, every_batch)
    asking = rows.filter("asks").select("vec_id", "vector", dim, batch, every_block)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        (ids, vectors), (query_ids, asked) = _matrix(left), _matrix(right)
        found: list[tuple] = []
        if len(ids) and len(query_ids):
            index = ImpactIndex(ids, vectors, int(np.abs(asked).max(initial=0)))
            for at in range(0, len(query_ids), QUERIES_AT_ONCE):
                own = query_ids[at : at + QUERIES_AT_ONCE]
                r, c, s = index.search(own, asked[at : at + QUERIES_AT_ONCE], k)
                found.append((own[r], ids[c], s))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    key = ("dim", "block", "batch")
    pairs = candidates.groupBy(*key).cogroup(asking.groupBy(*key))
    best = pairs.applyInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
