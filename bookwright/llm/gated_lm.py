"""Scores of texts under a gated recurrent language model trained on the corpus.

Word counts of all training texts are a Spark aggregate. The most frequent words are the model's own; the
rest, its tail, are one token to the network and share that token's probability by their counts. Tasks train
on their own texts from common parameters, which are averaged by the tokens seen, in rounds over parts of the
corpus. Scoring a text needs the count of each of its words: frequent ones stand in a bounded dictionary,
the others are packed by block of texts and hash of the word, and meet their counts there.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookwright.llm import gated_net as G
from bookwright.llm.common import slices, text_or_empty
from bookwright.session import materialise

#: Words looked up in every task.
DICTIONARY = 16_384
ROUNDS = 2
BLOCK_CHARS = 8_000_000
TEXTS_AT_ONCE = 512
#: Distinct words that a task counts before it hands them on.
COUNT_WORDS = 300_000
#: Words of the corpus per group in which rare words meet their counts.
GROUP_WORDS = 1_000_000
#: Parameter vectors that one task averages.
AVERAGE_ROWS = 64
END = b"\n"  # no word


def words_of(text: str) -> list[bytes]:
    """Words in lower case (A-Z only), then the end."""
    return [*text.encode().lower().split(), END]


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - 2**63


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, "text", BLOCK_CHARS)


def word_counts(train: DataFrame) -> DataFrame:
    """``hash, c`` of every word (and the end) in the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            arrays = [pa.array(list(map(word_hash, counts)), pa.int64()), pa.array(counts.values(), pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["hash", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(words_of(text))
                if len(counts) > COUNT_WORDS:
                    yield flush()
        yield flush()

    return train.select("text").mapInArrow(run, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("c"))


class Dictionary(dict):
    """A number for each word: its place in ``tokens`` and ``counts`` if it is a frequent one; those of others go on from there.

    ``by_hash`` has the frequent words' token and count by hash. The last place in ``tokens`` and ``logs`` is for all other words.
    Words are hashed once, and ``hashes`` has those of the others; ``begin`` forgets them where they have become many.
    """

    def __init__(self, by_hash: dict[int, tuple[int, int]]):
        super().__init__()
        self.places, self.hashes = {h: i for i, h in enumerate(by_hash)}, []
        self.tokens = np.array([token for token, _ in by_hash.values()] + [G.TAIL], np.int32)
        self.counts = np.array([c for _, c in by_hash.values()] + [0], np.int64)
        self.logs = np.log10(self.counts + 1.0)

    def begin(self) -> None:
        if len(self) > COUNT_WORDS:
            self.clear()
            self.hashes.clear()

    def __missing__(self, word: bytes) -> int:
        h = word_hash(word)
        found = self.places.get(h)
        if found is None:
            found = len(self.places) + len(self.hashes)
            self.hashes.append(h)
        self[word] = found
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def _tokens(texts: list[str], words: Dictionary) -> list[np.ndarray]:
    words.begin()
    last = len(words.places)
    return [words.tokens[np.minimum(words.of(words_of(t)), last)] for t in texts]


def _averaged(rows: DataFrame) -> np.ndarray | None:
    """The mean of parameter vectors (``at, weight, params``), weighted, a bounded number at a time."""

    def add(table: pa.Table) -> pa.Table:
        weight = sum(table.column("weight").to_pylist())
        total = sum(np.frombuffer(b, np.float64) for b in table.column("params").to_pylist())
        return pa.table({"at": table.column("at").slice(0, 1), "weight": [weight], "params": pa.array([total.tobytes()], pa.binary())})

    schema = "at bigint, weight double, params binary"
    rows = materialise(rows, "params")
    while (n := rows.count()) > 1:
        rows = rows.withColumn("at", F.pmod(F.xxhash64("at"), F.lit(-(-n // AVERAGE_ROWS))))
        rows = materialise(rows.groupBy("at").applyInArrow(add, schema), "params")
    one = rows.first()
    return None if one is None else np.frombuffer(one.params, np.float64) / one.weight


def train(texts: DataFrame, by_hash: dict[int, tuple[int, int]], flat: np.ndarray, end: int) -> np.ndarray:
    """Parameters after one round over ``text``: each task's own pass from ``flat``; the mean of all steps of all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, words = G.Net(flat.copy()), Dictionary(by_hash)
        for block in _blocks(batches):
            own = sorted(_tokens(block.column(0).to_pylist(), words), key=len)
            # Texts of like length go together, and the lengths in no order.
            for at in np.random.default_rng(len(own)).permutation(range(0, len(own), TEXTS_AT_ONCE)):
                net.learn(own[at : at + TEXTS_AT_ONCE], end)
        if net.seen:
            arrays = [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([float(net.seen)]), pa.array([net.sum.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["at", "weight", "params"])

    found = _averaged(texts.select("text").mapInArrow(run, "at bigint, weight double, params binary"))
    return flat if found is None else found.astype(np.float32)


class BlockScores:
    """What can be said of a block of texts here, and the rare words whose counts have yet to be met.

    ``logs`` sums ``log10(c + 1)`` over tokens whose count is known here, ``tail_logs`` over those of them that are
    the model's tail.
    """

    def __init__(self, texts: list[str], words: Dictionary, net: G.Net, end: int):
        n, last = len(texts), len(words.places)
        self.n_tokens, self.n_known, self.n_tail = (np.zeros(n, np.int64) for _ in range(3))
        self.logs, self.tail_logs = np.zeros(n), np.zeros(n)
        words.begin()
        tokens, rare, docs = [], [], []
        for i, text in enumerate(texts):
            numbers = words.of(words_of(text))
            places = np.minimum(numbers, last)
            token, logs = words.tokens[places], words.logs[places]
            tokens.append(token)
            tail = token == G.TAIL
            self.n_tokens[i], self.n_tail[i] = len(token), np.count_nonzero(tail)
            self.n_known[i] = np.count_nonzero(words.counts[places])
            self.logs[i], self.tail_logs[i] = logs.sum(), logs[tail].sum()
            rare.append(numbers[places == last] - last)
            docs.append(np.full(len(rare[-1]), i))
        self.score = net.score(tokens, end) / math.log(10)
        numbers, docs = np.concatenate([*rare, np.zeros(0, np.int64)]), np.concatenate([*docs, np.zeros(0, np.int64)])
        own, at = np.unique(numbers, return_inverse=True)
        pairs, times = np.unique(docs * (len(own) + 1) + at, return_counts=True)
        self.hashes = np.array(words.hashes, np.int64)[own]
        self.triples = np.array([pairs // (len(own) + 1), pairs % (len(own) + 1), times], np.int64)

    def by_group(self, groups: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Group, hashes of its words, and (text, word among them, times) by column."""
        group_of = (self.hashes.view(np.uint64) % np.uint64(groups)).astype(np.int64)
        order = np.argsort(group_of, kind="stable")
        edges = np.searchsorted(group_of[order], np.arange(groups + 1)) if groups <= len(order) else None
        place = np.empty(len(order), np.int64)
        rows = self.triples[:, np.argsort(group_of[self.triples[1]], kind="stable")]
        row_group = group_of[rows[1]]
        for group in np.unique(group_of):
            lo, hi = (edges[group], edges[group + 1]) if edges is not None else np.searchsorted(group_of[order], [group, group + 1])
            own = order[lo:hi]
            place[own] = np.arange(len(own))
            mine = rows[:, slice(*np.searchsorted(row_group, [group, group + 1]))].copy()
            mine[1] = place[mine[1]]
            yield int(group), self.hashes[own], mine


def _scored(docs: DataFrame, by_hash: dict, flat: np.ndarray, end: int, groups: int) -> DataFrame:
    """Rows of two kinds: a block's texts (``part`` null) and a block's rare words of a group.

    Numbers go as bytes: they are read by numpy only.
    """
    schema = f"block bigint, part int, ids array<{docs.schema['doc_id'].dataType.simpleString()}>, texts binary, hashes binary, rows binary"
    id_type = pa.list_(pa.int64() if docs.schema["doc_id"].dataType.simpleString() == "bigint" else pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, words, number = G.Net(flat), Dictionary(by_hash), TaskContext.get().partitionId() << 32
        for block in _blocks(batches):
            b = BlockScores(block.column(1).to_pylist(), words, net, end)
            stats = np.array([b.n_tokens, b.n_known, b.n_tail, b.logs, b.tail_logs, b.score], np.float64)
            rows = [(number, None, block.column(0).to_pylist(), stats.tobytes(), None, None)]
            rows += [(number, g, None, None, h.tobytes(), r.astype(np.uint32).tobytes()) for g, h, r in b.by_group(groups)]
            types = [pa.int64(), pa.int32(), id_type, pa.binary(), pa.binary(), pa.binary()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "part", "ids", "texts", "hashes", "rows"])
            number += 1

    return docs.mapInArrow(run, schema)


def _meet(words: pa.Table, counts: pa.Table) -> pa.Table:
    """For one group: adds what its words say to each block's texts (known tokens, and logarithms)."""
    order = pc.sort_indices(counts.column("hash"))
    hashes, c = (counts.column(n).take(order).to_numpy() for n in ("hash", "c"))
    found = []
    for own, rows in zip(words.column("hashes").to_pylist(), words.column("rows").to_pylist(), strict=True):
        own, rows = np.frombuffer(own, np.int64), np.frombuffer(rows, np.uint32).reshape(3, -1).astype(np.int64)
        at = np.minimum(np.searchsorted(hashes, own), max(0, len(hashes) - 1))
        n = np.where(hashes[at] == own, c[at], 0) if len(hashes) else np.zeros(len(own), np.int64)
        text, times, count = rows[0], rows[2], n[rows[1]]
        size = int(text.max()) + 1
        known = np.bincount(text, times * (count > 0), size)
        logs = np.bincount(text, times * np.log10(count + 1.0), size)
        found.append(np.array([known, logs]).tobytes())
    return pa.table({"block": words.column("block"), "sums": pa.array(found, pa.binary())})


def scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, one row per input row.

    The model learns from the rows that aren't held out. ``base_score`` is the unigram model's log10 probability
    with one added to each count, ``score`` the network's. A null text is the empty text, whose only token is
    the end; a null id counts as the empty name. Without training rows the counts are 0 and the network is
    as it begins. Rows may repeat; other columns are not read. Words are named by 64 bits of hash.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    doc_id = df[id_col] if id_type in ("bigint", "string") else df[id_col].cast("bigint" if id_type in ("int", "smallint", "tinyint") else "string")
    docs = df.select(doc_id.alias("doc_id"), text_or_empty(text_col).alias("text"))
    learning = docs.filter(~held_out(F.col("doc_id")))

    counts = materialise(word_counts(learning), "wordcounts")
    n, v = (x or 0 for x in counts.agg(F.sum("c"), F.count("*")).first())
    frequent = counts.orderBy(F.desc("c"), "hash").limit(DICTIONARY).collect()  # a bounded number of rows
    end_hash = word_hash(END)
    end_count = next((r.c for r in frequent if r.hash == end_hash), 0)
    ranked = [(r.hash, r.c) for r in frequent if r.hash != end_hash]
    known = [(end_hash, end_count), *ranked[: G.KNOWN - 1]]  # the end is always the model's own, and token 0
    by_hash = {h: (token, c) for token, (h, c) in enumerate(known)}
    by_hash |= {h: (G.TAIL, c) for h, c in ranked[G.KNOWN - 1 :]}
    tail_mass = float(n - sum(c for _, c in known) + max(0, v - len(known)) + 1)

    flat = G.initial(np.array([c for _, c in known], np.float64), tail_mass)
    for part in range(ROUNDS):
        round_of = F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(ROUNDS))
        flat = train(learning.filter(round_of == part), by_hash, flat, end=0)

    groups = int(max(8, n // GROUP_WORDS))
    both = materialise(_scored(docs, by_hash, flat, 0, groups), "scored")
    rare = both.filter("part IS NOT NULL").select("block", "part", "hashes", "rows")
    part = F.pmod(F.col("hash"), F.lit(groups))
    # The same group as by unsigned numbers: 2**64 mod groups more for what reads as negative.
    shifted = F.pmod(part + F.when(F.col("hash") < 0, F.lit(2**64 % groups)).otherwise(0), F.lit(groups))
    split = counts.select(shifted.cast("int").alias("part"), "hash", "c")
    sums = rare.groupBy("part").cogroup(split.groupBy("part")).applyInArrow(lambda w, c: _meet(w, c), "block bigint, sums binary")

    texts = both.filter("part IS NULL").select("block", "ids", "texts")
    base_space, tail_space = math.log10(n + v + 1), math.log10(tail_mass)
    held = pa.schema([("doc_id", pa.int64() if id_type != "string" else pa.string())])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("ids").combine_chunks().flatten()
        stats = np.frombuffer(left.column("texts")[0].as_py(), np.float64).reshape(6, -1)
        n_tokens, n_known, n_tail, logs, tail_logs, score = (s.copy() for s in stats)
        for data in right.column("sums").to_pylist():
            known_more, logs_more = np.frombuffer(data, np.float64).reshape(2, -1)
            at = slice(0, len(known_more))
            n_known[at] += known_more
            logs[at] += logs_more
            tail_logs[at] += logs_more
        return pa.table(
            {
                "doc_id": ids.cast(held.field(0).type),
                "n_tokens": pa.array(n_tokens.astype(np.int64)),
                "n_known": pa.array(n_known.round().astype(np.int64)),
                "base_score": pa.array(logs - n_tokens * base_space),
                "score": pa.array(score + tail_logs - n_tail * tail_space),
            }
        )

    out = "doc_id {}, n_tokens bigint, n_known bigint, base_score double, score double".format("string" if id_type == "string" else "bigint")
    scored = texts.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(finish, out)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score"
    )
