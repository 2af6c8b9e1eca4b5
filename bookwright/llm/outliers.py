"""Robust multivariate outliers among texts.

Each text gives a vector of transformed statistics. Per language and source, a minimum covariance
determinant estimate (the half of the texts whose covariance has the smallest determinant) says what is
usual there, and texts at a large Mahalanobis distance from it are rejected.

The estimate takes concentration steps over all rows: distances to the present centre, the nearest half,
its mean and covariance. A step is one aggregate. Distances are counted in narrow logarithmic bins with
the sums of the vectors in them, so the nearest half is a running total over bins, and no group meets in
one task. Vectors are whole numbers, so sums are exact and results don't depend on the partitioning.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookwright.llm.common import map_texts, text_key, text_or_empty
from bookwright.session import materialise

MIN_WORDS = 50
MIN_GROUP = 50
STEPS = 6
BINS_PER_DOUBLING = 12
SCALE = 1024
#: Of normal vectors, so many are beyond the cutoff. On sf0.1, labelled clean and bad texts lie on either side of it.
TAIL = 1e-4
#: The vector, and the least standard deviation of each part: rates of clean texts vary by this much even
#: where half of a group has none at all, which would leave no variance. Each is small enough for its part alone to
#: reach the cutoff: from about 0.53 duplicate lines, or 0.43 repeats (the base rule ends them at 0.5).
FLOORS = {"word_length": 0.12, "symbols": 0.03, "dup_lines": 0.1, "repeats": 0.08, "upper": 0.04, "marks": 0.12}
_SPACES = " \t\n\r\x0b\x0c"
_SYMBOLS = "#*$%&|<>"
_MARKS = ".,!?;:"
_DIM = len(FLOORS)
_PAIRS = [(i, j) for i in range(_DIM) for j in range(i, _DIM)]

_KEYS = ("doc_id", "text_key", "lang", "source")
STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks")


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of three words which the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    inside, last = 0, -1  # the last word counted
    for i, window in enumerate(windows):
        if often[window] > 1:
            inside += i + 2 - max(last, i - 1)
            last = i + 2
    return inside


def _upper(text: str) -> int:
    lower = text.lower()
    if len(lower) != len(text):
        return sum(c != c.lower() for c in text)
    a, b = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (text, lower))
    return int(np.count_nonzero(a != b))


def text_stats(text: str) -> tuple[int, ...]:
    words = text.encode().split()  # bytes split at exactly the contract's white space
    lines = [line for line in text.split("\n") if line.strip(_SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACES)),
        sum(map(text.count, _SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
        _upper(text),
        sum(map(text.count, _MARKS)),
    )


def with_stats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_key, lang, source`` and the statistics of each whole text, one row per input row."""

    def make():
        def fn(batch: pa.RecordBatch) -> dict:
            rows = np.array([text_stats(t) for t in batch.column(4).to_pylist()], np.int64).reshape(-1, len(STATS))
            return dict(zip(_KEYS, batch.columns[:4], strict=True)) | dict(zip(STATS, rows.T.copy(), strict=True))

        return fn

    group = [F.coalesce(df[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    texts = df.select(df[id_col].alias("doc_id"), text_key(text_col), *group, text_or_empty(text_col).alias("text"))
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, text_key bigint, lang string, source string, " + ", ".join(f"{c} bigint" for c in STATS)
    return map_texts(texts, "text", schema, make)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vector() -> list[Column]:
    """Logarithms of what has no upper end, rates of what has; in units of each part's floor, as whole numbers."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    parts = {
        "word_length": F.log(chars / words),
        "symbols": F.log1p(F.col("n_symbols") / words),
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeats": F.col("n_repeat_words") / words,
        "upper": F.col("n_upper") / chars,
        "marks": F.log1p(F.col("n_marks") / words),
    }
    return [F.round(parts[name] / floor * SCALE).cast("long") for name, floor in FLOORS.items()]


def _with_groups(rows: DataFrame) -> DataFrame:
    """Adds ``grp``: language and source; small ones together by language, small languages together."""
    sizes = rows.groupBy("lang", "source").agg(F.count(F.when(~base_failed(), 1)).alias("n"))
    small = F.col("n") < MIN_GROUP
    by_lang = sizes.filter(small).groupBy("lang").agg((F.sum("n") < MIN_GROUP).alias("few"))
    name = F.when(~small, F.to_json(F.array("lang", "source"))).when(~F.col("few"), F.to_json(F.array("lang"))).otherwise("[]")
    groups = sizes.join(by_lang, "lang", "left").select("lang", "source", name.alias("grp"))
    return rows.join(groups, ["lang", "source"])


_SUMS = [f"s{i}" for i in range(_DIM)] + [f"s{i}_{j}" for i, j in _PAIRS]
_SHAPE = "grp string, start int, total bigint, det double, center array<double>, inverse array<double>"


def chi2_cdf(x: float, degrees: int) -> float:
    """For an even number of degrees."""
    term, total = 1.0, 1.0
    for i in range(1, degrees // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(share: float, degrees: int) -> float:
    low, high = 0.0, 200.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, degrees) < share else (low, mid)
    return high


CUTOFF = chi2_quantile(1 - TAIL, _DIM)


def _consistency(share: float) -> float:
    """What the covariance of a normal's nearest share is to be multiplied by."""
    return share / chi2_cdf(chi2_quantile(share, _DIM), _DIM + 2)


def _estimate(rows: pd.DataFrame) -> pd.DataFrame:
    """Bins of one group and start, to the centre and shape of its nearest half."""
    rows = rows.sort_values("bin")
    total = int(rows["n"].sum())
    half = (total + _DIM + 1) // 2
    last = int(np.searchsorted(np.cumsum(rows["n"].to_numpy()), min(half, total)))
    inside = [sum(map(int, rows[c].iloc[: last + 1])) for c in ("n", *_SUMS)]  # whole numbers of any size
    n, first, second = inside[0], inside[1 : 1 + _DIM], inside[1 + _DIM :]
    center = np.array([s / n for s in first])
    cov = np.zeros((_DIM, _DIM))
    for (i, j), s in zip(_PAIRS, second, strict=True):
        cov[i, j] = cov[j, i] = (n * s - first[i] * first[j]) / n / n
    cov = cov / SCALE**2 * (_consistency(n / total) if n < total else 1.0) + np.eye(_DIM)
    row = (rows["grp"].iloc[0], int(rows["start"].iloc[0]), total, float(np.linalg.slogdet(cov)[1]), center / SCALE, np.linalg.inv(cov).ravel())
    return pd.DataFrame([row], columns=["grp", "start", "total", "det", "center", "inverse"])


def _distance() -> Column:
    away = [F.col(f"v{i}") / SCALE - F.col("center")[i] for i in range(_DIM)]
    terms = [(1 if i == j else 2) * away[i] * away[j] * F.col("inverse")[i * _DIM + j] for i, j in _PAIRS]
    return sum(terms[1:], terms[0])


def _concentrate(rows: DataFrame, distance: Column) -> DataFrame:
    """One step for every group and start: a row for each, few and small."""
    place = F.floor(F.log2(F.greatest(distance, F.lit(0.0)) + 1e-6) * BINS_PER_DOUBLING)
    sums = [F.sum(f"v{i}").alias(f"s{i}") for i in range(_DIM)]
    sums += [F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"s{i}_{j}") for i, j in _PAIRS]
    bins = rows.withColumn("bin", place).groupBy("grp", "start", "bin").agg(F.count("*").alias("n"), *sums)
    return materialise(bins.groupBy("grp", "start").applyInPandas(_estimate, _SHAPE), "shape")


def estimates(rows: DataFrame) -> DataFrame:
    """``grp, total, center, inverse``: of two starts, the one that ends with the smaller determinant.

    The starts are the halves nearest to the median in the sum of squares and in the largest part, each part
    in units of its spread about the median.
    """
    vector = [f"v{i}" for i in range(_DIM)]
    medians = rows.groupBy("grp").agg(*(F.median(v).alias(f"m{i}") for i, v in enumerate(vector)))
    medians = materialise(medians, "medians")
    near = rows.join(medians, "grp")
    spread = near.groupBy("grp").agg(
        *(F.greatest(F.median(F.abs(F.col(v) - F.col(f"m{i}"))) * 1.4826, F.lit(float(SCALE))).alias(f"d{i}") for i, v in enumerate(vector))
    )
    scaled = near.join(materialise(spread, "spread"), "grp").withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    parts = [F.pow((F.col(v) - F.col(f"m{i}")) / F.col(f"d{i}"), 2) for i, v in enumerate(vector)]
    first = F.when(F.col("start") == 0, sum(parts[1:], parts[0])).otherwise(F.greatest(*parts))
    shape = _concentrate(scaled, first)
    for _ in range(STEPS):
        shape = _concentrate(rows.join(shape, "grp"), _distance())
    best = F.min_by(F.struct("total", "center", "inverse"), F.struct("det", "start")).alias("best")
    return shape.groupBy("grp").agg(best).select("grp", "best.*")


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_key``, the statistics, ``base_failed``, ``distance`` and ``kept``, one row per input row.

    Texts that fail a base rule are not kept and shape no estimate. The rest are kept unless their squared
    distance is beyond ``CUTOFF``. A language and source with fewer than ``MIN_GROUP`` such texts is judged
    with the other small ones of its language, then with those of all languages; if even these are fewer,
    there is no estimate, ``distance`` is null and the text is kept. A null text is the empty text (which
    fails), a null language or source counts as an empty name; a null or repeated id is carried as it is.
    Columns besides id, text, ``lang`` and ``source`` are not read.
    """
    rows = materialise(with_stats(df, id_col, text_col), "stats")
    grouped = _with_groups(rows).select("*", *(c.alias(f"v{i}") for i, c in enumerate(_vector())))
    rows = materialise(grouped, "vectors")
    shape = estimates(rows.filter(~base_failed())).filter(F.col("total") >= MIN_GROUP)
    judged = rows.join(materialise(shape, "best"), "grp", "left").withColumn("distance", _distance())
    kept = ~base_failed() & (F.col("distance").isNull() | (F.col("distance") <= CUTOFF))
    return judged.select("doc_id", "text_key", *STATS, base_failed().alias("base_failed"), "distance", kept.alias("kept"))
