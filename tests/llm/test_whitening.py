from __future__ import annotations

import math

import numpy as np
import pytest

from bookwright.llm import whitening as W
from bookwright.llm.queries import op12_spectrum_whitening


def symmetric(rng, size, values=None):
    q, _ = np.linalg.qr(rng.normal(size=(size, size)))
    return q @ np.diag(values if values is not None else rng.normal(size=size)) @ q.T


@pytest.mark.parametrize("size", [1, 2, 5, 20, 64])
def test_inertia_counts_eigenvalues(size):
    rng = np.random.default_rng(size)
    m = symmetric(rng, size)
    m = (m + m.T) / 2
    exact = np.linalg.eigvalsh(m)
    for shift in rng.normal(size=20):
        assert W.eigenvalues_below(m, shift) == (exact < shift).sum()
    assert W.eigenvalues_below(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1  # no pivot on the diagonal
    assert W.eigenvalues_below(np.zeros((3, 3)), 0.0) == 0


@pytest.mark.parametrize(
    "values",
    [
        [5, 4, 3, 2, 1],
        [1, 1 + 1e-9, 1 - 1e-9, 0.5, 0.2],
        [2, 2, 2, 2, 2],
        [7, 0, 0, 0, 0],
        [1e-12, 1e-13, 0, 0, 0],
        [1e12, 1, 1e-6, 0, 0],
        [3],
        [4, 1],
    ],
)
def test_leading_values_and_vectors(values):
    m = symmetric(np.random.default_rng(1), len(values), np.array(values, dtype=float))
    m = (m + m.T) / 2
    found, vectors = W.leading(m, 4)
    norm = max(values)
    assert np.allclose(found, sorted(values, reverse=True)[:4], rtol=0, atol=1e-14 * norm)
    assert np.allclose(vectors.T @ vectors, np.eye(len(found)), atol=1e-13)
    assert np.abs(m @ vectors - vectors * found).max() <= 1e-13 * norm


def brute(vectors, components=4):
    """numpy's own eigenvectors; signs may differ."""
    x = np.array([[math.floor(256 * float(c)) for c in v] for v in vectors], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(values)[::-1][:components]
    whitened = (x - sums / n) @ basis[:, order] / np.sqrt(values[order])
    return n, ((n * x - sums) ** 2).sum(axis=1), whitened, values[order] / values.sum()


def test_query_against_numpy(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    n, deviation, whitened, explained = brute([r["embedding"] for r in rows])
    got = op12_spectrum_whitening(spark, folder).orderBy("vec_id", "component").toPandas()
    assert len(got) == 4 * len(rows) and (got["n"] == n).all() and (got["identity_error"] < 1e-10).all()
    assert (got["deviation"].to_numpy().reshape(-1, 4)[:, 0] == deviation).all()
    assert np.allclose(got["explained"].to_numpy().reshape(-1, 4)[0], explained, rtol=1e-10)
    mine = got["whitened"].to_numpy().reshape(-1, 4)
    signs = np.sign((mine * whitened).sum(axis=0))
    assert np.allclose(mine, whitened * signs, atol=1e-8)


def frame(spark, vectors):
    return spark.createDataFrame(
        [(i, v, 1, "x", 2.0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, n int, x string, whitened double"
    )


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    good = [list(map(float, rng.normal(size=6).astype(np.float32))) for _ in range(40)]
    odd = [None, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [float("inf")] + [0.0] * 5]
    got = W.whiten(frame(spark, good + odd + [good[0]] * 60)).toPandas()
    assert set(got["vec_id"]) == set(range(40)) | set(range(44, 104))
    n, deviation, _, explained = brute(good)
    assert (got["n"] == n).all() and (got["identity_error"] < 1e-10).all()
    assert {int(d) for d in got["deviation"]} == set(map(int, deviation))
    copies = got[got["vec_id"].isin([0, 44, 103])].groupby("component")["whitened"].nunique()
    assert (copies == 1).all()
    assert np.allclose(sorted(got["explained"].unique(), reverse=True), explained)


def test_few_directions_and_no_rows(spark):
    one = W.whiten(frame(spark, [[1.0, 2.0]] * 5)).toPandas()
    assert len(one) == 10 and one["whitened"].isna().all() and one["explained"].isna().all() and one["identity_error"].isna().all()
    line = W.whiten(frame(spark, [[float(i), 2.0 * i, 0.0] for i in range(9)])).orderBy("vec_id", "component").toPandas()
    assert list(line["component"][:3]) == [1, 2, 3] and line["whitened"].notna().sum() == 9
    assert math.isclose(line["explained"][0], 1.0) and (line["identity_error"] < 1e-12).all()
    assert W.whiten(frame(spark, [None])).collect() == [] and W.whiten(frame(spark, [[]])).collect() == []
    mixed = W.whiten(frame(spark, [[1.0], [0.0, 2.0], [3.0, 1.0, 1.0]])).toPandas()
    padded = W.whiten(frame(spark, [[1.0, 0.0, 0.0], [0.0, 2.0, 0.0], [3.0, 1.0, 1.0]])).toPandas()
    assert (mixed["deviation"] == padded["deviation"]).all() and np.allclose(mixed["explained"], padded["explained"])


def test_huge_entries_stay_exact(spark):
    big = W.whiten(frame(spark, [[3.0e9, 1.0], [-3.0e9, 2.0], [0.0, 4.0]])).toPandas()
    x = [[math.floor(256 * c) for c in v] for v in ([3.0e9, 1.0], [-3.0e9, 2.0], [0.0, 4.0])]
    sums = [sum(c) for c in zip(*x)]
    assert [int(d) for d in big.drop_duplicates("vec_id").sort_values("vec_id")["deviation"]] == [
        sum((3 * c - s) ** 2 for c, s in zip(v, sums)) for v in x
    ]
