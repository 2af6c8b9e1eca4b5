"""Exact search against all scores, and against its SQL."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookwright.llm import impact_topk as I
from bookwright.llm.oracle import oracles
from bookwright.llm.queries import all_queries
from tests.oracle_check import connect, rows_of


@pytest.mark.parametrize("spread", [3, 30, 3000, 10**8])
def test_index_equals_all_scores(spread):
    rng = np.random.default_rng(spread)
    vectors = rng.integers(-spread, spread + 1, (500, 16))
    vectors[100:140] = vectors[7]  # ties
    ids = rng.permutation(500)
    index = I.ImpactIndex(ids, vectors, int(np.abs(vectors).max()))
    for k in (1, 20, 600):
        rows, cols, scores = index.search(ids[:30], vectors[:30], k)
        for q in range(30):
            all_scores = vectors @ vectors[q]
            order = [i for i in np.lexsort((ids, -all_scores)) if i != q][:k]
            assert cols[rows == q].tolist() == order and scores[rows == q].tolist() == all_scores[order].tolist()


def test_processing_stops_on_proof_and_only_then(monkeypatch):
    rng = np.random.default_rng(1)
    centers = rng.normal(0, 16, (20, 64))
    vectors = np.rint(centers[rng.integers(0, 20, 4000)] + rng.normal(0, 2, (4000, 64))).astype(np.int64)
    index = I.ImpactIndex(np.arange(4000), vectors, int(np.abs(vectors).max()))
    done = []
    segments = index.segments

    class Counted(list):
        def __iter__(self):
            for s in segments:
                done.append(s[0])
                yield s

    index.segments = Counted(segments)
    index.search(np.arange(10), vectors[:10], 20)
    assert 0 < len(done) < len(segments) and done == sorted(done, reverse=True)


def test_blocks_batches_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(I, "BLOCK_ROWS", 30)
    monkeypatch.setattr(I, "BATCH_ROWS", 4)
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(150)]
    rows += [(1000 + i, rows[20][1]) for i in range(60)]  # one very common vector
    odd = [(200, None), (220, [1.0, None, 0.0, 0.0, 0.0]), (240, [math.nan] * 5), (260, [math.inf] * 5), (None, rows[0][1])]
    shorter = [(300, [1.0, 2.0]), (301, [1.0, 1.0]), (340, [])]
    table = rows + odd + shorter + [rows[3], rows[20]]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>").selectExpr("*", "1 vector", "2 block", "3 dim").repartition(5)
    got = sorted(tuple(r) for r in I.top_k(df, F.col("vec_id") % 20 == 0, 7).collect())
    f32 = lambda v: [math.floor(64 * float(np.float32(x))) for x in v]
    good = {i: f32(v) for i, v in rows + shorter}
    want = []
    for q, v in good.items():
        if q % 20 == 0:
            others = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good.items() if i != q and len(w) == len(v))
            want += [(q, rank, i, -s) for rank, (s, i) in enumerate(others[:7], 1)]
    assert got == sorted(want)
    assert I.top_k(df.limit(0), F.col("vec_id") % 20 == 0, 7).count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    df = all_queries()["op8_impact_topk"](spark, sf)
    cursor = connect(sf).execute(oracles()["op8_impact_topk"])
    names = [d[0] for d in cursor.description]
    assert rows_of(df.columns, df.collect()) == rows_of(names, cursor.fetchall())
