"""Near-duplicate texts by DartMinHash signatures.

A text is a weighted set: its shingles of five words, weighted by how often each stands in it. Every
shingle's weight is a column of unit regions. In each region, and in each range of ranks between powers of
two, a hash says how many darts lie there, at which rank and height, and which coordinate of the signature
each of them aims at. A text sees the darts below its weights; per coordinate it keeps the one of least
rank. Two texts agree in a coordinate with the probability of their weighted Jaccard similarity, and a text
needs about ``k ln k + 2k`` darts, whatever its length. Bands of the signature find candidates, and the
similarity of each is then counted from the texts.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookwright.llm.byte_bpe import list_array
from bookwright.llm.common import map_texts, same_row, text_key, text_or_empty
from bookwright.llm.components import BOTH, linked_classes
from bookwright.session import materialise

WORDS = 5
#: A pair at similarity 0.8 has no equal band of 5 with probability (1 - 0.8 ** 5) ** 28, about 1.5e-5.
BAND_ROWS = 5
BANDS = 28
#: Similarity as a fraction of whole numbers, so that the comparison is exact.
LEAST = (4, 5)
#: Sizes in a class differ by this factor at most.
SIZE_CLASS = 1.06
FIRST_RANGE = -10  # ranks below 2 ** FIRST_RANGE are one range

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_SALTS = [np.uint64(i * int(_GOLD) % 2**64) for i in range(4)]
_UNIT = 2.0**-64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray, salt: int) -> np.ndarray:
    return mix(x + _SALTS[salt]) * _UNIT


@cache
def _poisson(width: float) -> np.ndarray:
    """Distribution function of the number of darts in a region of this area, up to where it is 1."""
    most = int(width + 12 * math.sqrt(width) + 24)
    logs = [i * math.log(width) - width - math.lgamma(i + 1) for i in range(most)]
    return np.cumsum(np.exp(logs))


def sketch(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, k: int) -> np.ndarray:
    """Signatures (``n`` by ``k``) of weighted sets; ``owner`` gives each element's set, from 0.

    A set without weight has the signature 0.
    """
    units = np.ceil(weights).astype(np.int64)
    index = np.arange(units.sum()) - np.repeat(np.cumsum(units) - units, units)
    cells = mix(np.repeat(elements, units) + (index + 1).astype(np.uint64) * _GOLD)
    height = np.minimum(np.repeat(weights, units) - index, 1.0)
    who = np.repeat(owner, units)
    total = np.bincount(owner, weights, n)

    best = np.full(n * k, np.inf)
    signature = np.zeros(n * k, np.uint64)
    enough = (k * math.log(k) + 2 * k) / np.maximum(total, 1e-300)  # the rank up to which enough darts lie
    active = total > 0
    step = FIRST_RANGE
    while active.any():
        low, high = (0.0, 2.0**step) if step == FIRST_RANGE else (2.0 ** (step - 1), 2.0**step)
        chosen = np.flatnonzero(active[who])
        own = mix(cells[chosen] ^ mix(np.full(1, step + 1000, np.uint64)))
        darts = np.searchsorted(_poisson(high - low), own * _UNIT, side="right")
        hit = np.flatnonzero(darts)
        repeats = darts[hit]
        at = np.repeat(chosen[hit], repeats)
        number = np.arange(len(at)) - np.repeat(np.cumsum(repeats) - repeats, repeats)
        dart = mix(np.repeat(own[hit], repeats) + (number + 1).astype(np.uint64) * _GOLD)
        below = _uniform(dart, 1) < height[at]
        dart, at = dart[below], at[below]
        rank = low + (high - low) * _uniform(dart, 2)
        place = who[at] * k + (mix(dart + _SALTS[3]) % np.uint64(k)).astype(np.int64)
        np.minimum.at(best, place, rank)
        first = best[place] == rank
        signature[place[first]] = dart[first]
        missing = np.isinf(best.reshape(n, k)).any(axis=1)
        active &= (enough > high) | missing
        step += 1
    return signature.reshape(n, k)


def word_hashes(words: list[list[bytes]]) -> np.ndarray:
    known = {w: xxhash.xxh64_intdigest(w) for w in set().union(*words)}
    return np.fromiter((known[w] for own in words for w in own), np.uint64)


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles, how often each stands in its text, and its text.

    A shorter text is one shingle of all its words; a text without words has none. Words end at ASCII white space.
    """
    words = [t.encode().split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    hashed = np.concatenate([word_hashes(words), np.zeros(WORDS, np.uint64)])
    sizes = np.where(counts >= WORDS, counts - WORDS + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(texts)), sizes)
    starts = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(np.cumsum(counts) - counts, sizes)
    width = np.minimum(counts, WORDS)[owner]
    shingle = width.astype(np.uint64)
    for i in range(WORDS):
        shingle = np.where(i < width, mix(shingle * _GOLD + hashed[starts + i]), shingle)
    order = np.lexsort((shingle, owner))
    shingle, owner = shingle[order], owner[order]
    new = np.ones(len(owner), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return shingle[at], np.diff(np.append(at, len(owner))).astype(np.float64), owner[at]


def text_keys(texts: list[str]) -> np.ndarray:
    """64 bits of the words of each text."""
    return np.array([xxhash.xxh3_64_intdigest(b" ".join(t.encode().split())) for t in texts], np.uint64).view(np.int64)


def weights(texts: list[str]) -> np.ndarray:
    """The total weight of each text's shingles."""
    counts = np.array([len(t.encode().split()) for t in texts], np.int64)
    return np.where(counts >= WORDS, counts - WORDS + 1, np.minimum(counts, 1))


def bands(texts: list[str]) -> np.ndarray:
    """One bucket for each band of each text; none for texts without words."""
    hashes, weights, owner = shingles(texts)
    signature = sketch(hashes, weights, owner, len(texts), BANDS * BAND_ROWS).reshape(len(texts), BANDS, BAND_ROWS)
    bucket = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), signature.shape[:2])
    for i in range(BAND_ROWS):
        bucket = mix(bucket * _GOLD + signature[:, :, i])
    return bucket.view(np.int64)


def cells(texts: list[str]) -> list[np.ndarray]:
    """32 bits of each shingle and occurrence, so that shared cells count shared weight."""
    hashes, weights, owner = shingles(texts)
    units = weights.astype(np.int64)
    index = np.arange(units.sum()) - np.repeat(np.cumsum(units) - units, units)
    own = (mix(np.repeat(hashes, units) + index.astype(np.uint64) * _GOLD) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    ends = np.cumsum(np.bincount(owner, units, len(texts)).astype(np.int64))
    return [np.unique(part) for part in np.split(own, ends[:-1])]


def _signed(df: DataFrame) -> DataFrame:
    def make():
        def fn(batch: pa.RecordBatch) -> dict:
            texts = batch.column(2).to_pylist()
            found = bands(texts)
            empty = [not t.strip(" \t\n\r\x0b\x0c") for t in texts]
            buckets = [b[:0] if e else b for b, e in zip(found, empty, strict=True)]
            lists = pa.ListArray.from_arrays(
                np.concatenate([[0], np.cumsum([len(b) for b in buckets])]).astype(np.int32), np.concatenate(buckets)
            )
            return {"doc_id": batch.column(0), "text_key": batch.column(1), "key": text_keys(texts), "size": weights(texts), "buckets": lists}

        return fn

    id_type = df.schema["doc_id"].dataType.simpleString()
    return map_texts(df, "text", f"doc_id {id_type}, text_key bigint, key bigint, size bigint, buckets array<bigint>", make)


def _cells_of(df: DataFrame) -> DataFrame:
    """``id, cells`` of rows ``key, text``; rows whose text has another key are others of the same document id."""

    def make():
        def fn(batch: pa.RecordBatch) -> dict:
            keys, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            same = np.flatnonzero(text_keys(texts) == keys)
            own = cells([texts[i] for i in same])
            return {"id": pa.array(keys[same]), "cells": list_array(own)}

        return fn

    return map_texts(df.select("key", "text"), "text", "id bigint, cells array<int>", make)


def _rare_buckets(own: DataFrame, ids: DataFrame) -> DataFrame:
    """``bucket, id, side`` of texts, by their rarest cells: two that are near duplicates meet, two that share a frequent passage don't.

    Cells are put in one order for all, those in few of these texts first. Sizes ``n`` and ``m`` at similarity t or more
    share t / (1 + t) of ``n + m`` cells, so at least one among the first of each text but for that many, less one. How many
    these are depends on the other's size; so a text is filed once for each class of sizes that its partners may have, with the
    least size of that class, and meets only those partners. Cells of one text alone take up places in that count, but file nothing.
    """
    up, down = LEAST
    n = F.col("n")
    each = own.join(ids, "id", "left_semi").select("id", F.size("cells").alias("n"), F.explode("cells").alias("cell"))
    counts = materialise(each.groupBy("cell").agg(F.count("*").alias("texts")).filter(F.col("texts") > 1), "counts")
    shared = each.join(counts, "cell").groupBy("id", "n")
    order = F.sort_array(F.collect_list(F.struct("texts", F.xxhash64("cell").alias("hash"), "cell")))
    ordered = shared.agg(order.alias("cells"))

    def size_class(size: Column) -> Column:
        return F.floor(F.log(size.cast("double")) / F.lit(math.log(SIZE_CLASS))).cast("int")

    smallest, largest = F.ceil(n * up / down), F.floor(n * down / up)
    classes = F.sequence(size_class(smallest) - 1, size_class(largest) + 1)
    filed = ordered.withColumn("other", F.explode(classes))
    floor = F.floor(F.pow(F.lit(SIZE_CLASS), F.col("other")) * (1 - 1e-9)).cast("int")
    common = F.ceil(F.lit(up) * (n + F.greatest(floor, smallest.cast("int"))) / (up + down)).cast("int")
    first = n - common + 1 - (n - F.size("cells"))
    filed = filed.withColumn("first", F.least(first, F.size("cells"))).filter(F.col("first") > 0)
    cell = filed.select("id", size_class(n).alias("own"), "other", F.explode(F.slice("cells", F.lit(1), F.col("first"))).alias("c"))
    pair = F.xxhash64("c.cell", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") < F.col("other"), 0).when(F.col("own") > F.col("other"), 1).otherwise(BOTH)
    return cell.select(pair.alias("bucket"), "id", side.alias("side")).distinct()


def first_of_class(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows with the least id of each class of near duplicates; of equal rows, one."""
    found = near_classes(df, id_col, text_col).filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).select("doc_id", "text_key").distinct()
    keyed = df.withColumn("_key", text_key(text_col))
    kept = keyed.join(found, same_row(keyed, found, id_col), "left_semi")
    return kept.dropDuplicates([id_col, "_key"]).select(*df.columns)


def near_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_key, class_id, n_docs``, one row per input row; ``class_id`` is the least id of the class.

    Texts of the same words are of one class, and so are those linked, over others too, by a weighted Jaccard
    similarity of at least ``LEAST``. Texts without words are alike among each other only. A null text is the
    empty text; null ids count as the greatest; rows may repeat. Other columns are not read.
    Texts are named by 64 bits and similarities counted on 32 bits of each shingle and occurrence.
    """
    docs = df.select(df[id_col].alias("doc_id"), text_key(text_col), text_or_empty(text_col).alias("text"))
    signed = materialise(_signed(docs), "signed")
    # One row per text, however many copies it has.
    texts = signed.groupBy("key").agg(F.first(F.struct("size", "buckets")).alias("s"))
    filed = texts.select(F.explode("s.buckets").alias("bucket"), F.col("key").alias("id"), F.col("s.size").alias("size"))
    ends = filed.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    shared = ends.filter(F.col("low") < F.col("high")).select("bucket")
    members = materialise(filed.join(shared, "bucket", "left_semi"), "members")

    wanted = members.select(F.col("id").alias("key")).distinct()
    holders = signed.groupBy("key").agg(F.min("doc_id").alias("doc_id")).join(wanted, "key")
    holders = holders.select(F.col("doc_id").alias("_id"), "key")
    own = materialise(_cells_of(docs.join(holders, docs["doc_id"].eqNullSafe(F.col("_id")))), "cells")
    left, right = own.toDF("a", "cells_a"), own.toDF("b", "cells_b")

    def verify(pairs: DataFrame) -> DataFrame:
        both = F.size(F.array_intersect("cells_a", "cells_b"))
        either = F.size("cells_a") + F.size("cells_b") - both
        return pairs.join(left, "a").join(right, "b").filter(both * LEAST[1] >= either * LEAST[0])

    _, roots = linked_classes(members, verify, LEAST, lambda ids: _rare_buckets(own, ids))
    rows = signed.select("doc_id", "text_key", "key").join(roots.withColumnRenamed("id", "key"), "key", "left")
    rows = rows.select("doc_id", "text_key", F.coalesce("root", "key").alias("root"))
    per_class = rows.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_docs"))
    return rows.join(materialise(per_class, "perclass"), "root").select("doc_id", "text_key", "class_id", "n_docs")
