"""Toxicity of texts from subword embeddings: their mean goes into a linear softmax, both trained together in numpy.

A text's bag holds its words (runs of ASCII letters and digits and of all characters beyond ASCII, in lower case) and their
n-grams of 3 to 6 characters, a word's two borders included, each hashed to a row of the embedding table. A misspelt word
that training never saw thus shares most of its rows with the word it stands for. Training takes a bounded sample of the
labelled rows in one task; scoring takes every whole text in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookwright.llm.common import map_texts, text_or_empty

GRAMS = (3, 4, 5, 6)
BUCKET_BITS = 18
DIMENSIONS = 8
#: Batches of training, at any size of the sample.
STEPS = 1_800
BATCH = 16
#: A bag's shares are small, so the embeddings take far longer steps than the softmax.
TABLE_RATE = 200.0
SOFTMAX_RATE = 0.1
#: Buckets of fewer training texts have no say.
LEAST_TEXTS = 5
#: Repeats of a subword count by this power.
DAMPING = 0.85
#: A bag counts as having so many empty subwords too, lest a text of few words be sure of itself.
PRIOR = 1_000.0
SEED = 13
#: Bounds of the training sample, per label: rows, and characters of the rows taken before the last.
SAMPLE_ROWS = 3_000
SAMPLE_CHARS = 6_000_000
#: A text's bag is made in runs of so many characters, whole words each.
RUN_CHARS = 1_000_000

#: Shorter bags are sorted to be counted.
_SORTED = 20_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_BORDER = np.array([not (chr(c).isalnum() or c > 127) for c in range(256)])


def _buckets(hashes: np.ndarray) -> np.ndarray:
    """Multiplicative hash: the upper bits of the product, folded once."""
    hashes = (hashes ^ (hashes >> np.uint64(29))) * _MIX
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def _runs(text: str) -> Iterator[str]:
    """The text in runs that end at a border where one is near; a longer word is cut at the run's end."""
    start = 0
    while start < len(text):
        stop = min(len(text), start + RUN_CHARS)
        if stop < len(text):
            tail = np.frombuffer(text[start:stop].encode("utf-32-le"), dtype=np.uint32)
            borders = np.flatnonzero((tail < 256) & _BORDER[np.minimum(tail, 255)])
            stop = start + int(borders[-1]) + 1 if len(borders) else stop
        yield text[start:stop]
        start = stop


def subwords(text: str) -> np.ndarray:
    """The buckets of all words and n-grams of a text, with repetition."""
    found = []
    for run in _runs(text.lower()):
        codes = np.frombuffer(f" {run} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        border = (codes < 256) & _BORDER[np.minimum(codes, 255)]
        codes = np.where(border, np.uint64(32), codes.astype(np.uint64))
        inside = np.concatenate([[0], np.cumsum(border)])
        n = len(codes)
        rolling = codes * _BASE
        length = 1
        for size in GRAMS:
            while length < size:
                rolling = (rolling[:-1] + codes[length:]) * _BASE
                length += 1
            if n < size:
                break
            starts = np.arange(n - size + 1)
            whole = inside[starts + size - 1] == inside[starts + 1]  # no border but at the ends
            found.append(_buckets(rolling[: len(starts)][whole] + np.uint64(size)))
        edges = np.flatnonzero(border)
        begin, end = edges[:-1] + 1, edges[1:]
        words = end > begin
        begin, end = begin[words], end[words]
        if len(begin):  # one hash per word: a sum of its characters times powers, taken back to the word's start
            powers = np.cumprod(np.full(n, _BASE), dtype=np.uint64)
            back = np.cumprod(np.full(n, np.uint64(pow(int(_BASE), -1, 2**64))), dtype=np.uint64)
            sums = np.concatenate([[np.uint64(0)], np.cumsum(codes * powers, dtype=np.uint64)])
            found.append(_buckets((sums[end] - sums[begin]) * back[begin]))
    return np.concatenate(found) if found else np.zeros(0, dtype=np.int32)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The different subwords of a text and their shares."""
    found = subwords(text)
    if len(found) < _SORTED:
        rows, counts = np.unique(found, return_counts=True)
    else:
        counts = np.bincount(found, minlength=1 << BUCKET_BITS)
        rows = np.flatnonzero(counts)
        counts = counts[rows]
    damped = (counts**DAMPING).astype(np.float32)
    return rows, damped / np.float32(damped.sum() + PRIOR)


class Model:
    """What scoring needs of the trained embeddings and softmax: their product per bucket, and the bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: str) -> float:
        rows, shares = bag(text)
        logit = self.bias + float(self.weights[rows].astype(np.float64) @ shares)
        return float(1.0 / (1.0 + np.exp(-np.clip(logit, -500, 500))))


def train(texts: list[str], labels: np.ndarray, seed: int = SEED) -> Model:
    """Mean embeddings and softmax by stochastic gradients at a falling rate.

    The mean counts each subword by how rare it is among the texts, so that what all texts share cannot drown the rest. Without both labels there is nothing to tell apart: every text scores their common value, 0 without any.
    """
    size = 1 << BUCKET_BITS
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(size, dtype=np.float32), 30.0 if len(labels) and labels[0] else -30.0)
    rng = np.random.default_rng(seed)
    counted = [bag(text) for text in texts]
    seen = np.bincount(np.concatenate([rows for rows, _ in counted]), minlength=size)
    rarity = np.where(seen >= LEAST_TEXTS, np.log((len(texts) + 1) / (seen + 1.0)), 0.0).astype(np.float32)
    bags = []
    for rows, shares in counted:
        share = shares * rarity[rows]
        bags.append((rows[share > 0], share[share > 0]))
    table = rng.uniform(-1, 1, (size, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    softmax = rng.uniform(-1, 1, (DIMENSIONS, 1)).astype(np.float32) * np.array([[-1, 1]], dtype=np.float32)
    bias = np.zeros(2, dtype=np.float32)
    step = 0
    while step < STEPS:
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            picked = order[at : at + BATCH]
            fall, step = max(0.0, 1 - step / STEPS), step + 1
            sizes = np.array([len(bags[i][0]) for i in picked])
            rows = np.concatenate([bags[i][0] for i in picked])
            share = np.concatenate([bags[i][1] for i in picked])
            owner = np.repeat(np.arange(len(picked)), sizes)
            hidden = np.zeros((len(picked), DIMENSIONS), dtype=np.float32)
            full = sizes > 0
            if full.any():
                hidden[full] = np.add.reduceat(table[rows] * share[:, None], (np.cumsum(sizes) - sizes)[full])
            logits = hidden @ softmax + bias
            error = np.exp(logits - logits.max(axis=1, keepdims=True))
            error /= error.sum(axis=1, keepdims=True)
            error[np.arange(len(picked)), labels[picked]] -= 1
            used = np.unique(rows)
            pull = np.stack([np.bincount(rows, share * error[owner, c], size)[used] for c in (0, 1)], axis=1).astype(np.float32)
            table[used] -= TABLE_RATE * fall * (pull @ softmax.T)
            softmax -= SOFTMAX_RATE * fall * hidden.T @ error / len(picked)
            bias -= SOFTMAX_RATE * fall * error.mean(axis=0)
    return Model(rarity * (table @ (softmax[:, 1] - softmax[:, 0])), float(bias[1] - bias[0]))


def held_out(id_col: str, folds: int = 5) -> Column:
    """By a checksum of the id as text; null: of the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == 0


def _sample(documents: DataFrame, labels: DataFrame, id_col: str, label: str) -> DataFrame:
    """Whole texts and labels of at most ``SAMPLE_ROWS`` ids per label, in the order of a hash of the id.

    Ids are chosen among those with a document before any text moves; an id with several texts gives its least.
    """
    ids = documents.filter(~held_out(id_col)).select(F.col(id_col).alias("id")).distinct()
    marked = labels.filter(F.col(label).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"))
    marked = marked.groupBy("id").agg(F.max("label").alias("label")).join(ids, "id", "left_semi")
    chosen = [
        marked.filter(F.col("label") == value).orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(SAMPLE_ROWS) for value in (0, 1)
    ]
    few = chosen[0].unionByName(chosen[1])  # at most 2 x SAMPLE_ROWS ids
    texts = documents.select(F.col(id_col).alias("id"), text_or_empty().alias("text"))
    return texts.join(F.broadcast(few), "id").groupBy("id", "label").agg(F.min("text").alias("text"))


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "toxic") -> Model:
    """The model of the sample, trained in one task; only its weights come to the driver."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["label", "rank", "id"])
        taken = frame.groupby("label")["chars"].cumsum() - frame["chars"] < SAMPLE_CHARS
        frame = frame[taken]
        model = train(list(frame["text"]), frame["label"].to_numpy())
        return pd.DataFrame({"weights": [model.weights.astype("<f4").tobytes()], "bias": [model.bias]})

    sample = _sample(documents, labels, id_col, label).select(
        "id", "label", "text", F.xxhash64("id", F.lit(SEED)).alias("rank"), F.char_length("text").alias("chars")
    )
    found = sample.groupBy(F.lit(0).alias("one")).applyInPandas(run, "weights binary, bias double").collect()
    if not found:
        return train([], np.zeros(0, dtype=np.int64))
    return Model(np.frombuffer(found[0]["weights"], dtype="<f4"), found[0]["bias"])


def score(documents: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """``id_col`` and ``score`` of every whole text; map-only."""
    weights = documents.sparkSession.sparkContext.broadcast(model.weights)  # as many as there are buckets
    bias = model.bias

    def make() -> Callable:
        scorer = Model(weights.value, bias)
        return lambda part: {id_col: part.column(0), "score": pa.array([scorer.score(t) for t in part.column(1).to_pylist()], pa.float64())}

    rows = documents.select(id_col, text_or_empty().alias("text"))
    return map_texts(rows, "text", f"{id_col} {documents.schema[id_col].dataType.simpleString()}, score double", make)


def toxicity(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "toxic") -> DataFrame:
    """``id_col``, ``held_out``, ``score`` and ``predicted`` for every document; the text alone decides the score.

    Labels other than 0 and 1 are left out, an id with both counts as 1, and held-out ids teach nothing. A null or empty text
    scores as a bag without subwords: by the bias alone. Texts of one id are rows of their own. Without labels of both
    kinds all texts score alike (see ``train``). An empty table gives no rows. Other columns are ignored.
    """
    model = fit(documents, labels, id_col, label)
    return score(documents, model, id_col).select(
        id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
