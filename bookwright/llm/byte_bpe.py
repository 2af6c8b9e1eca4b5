"""Byte-level BPE through a sentencepiece model made from a rank file.

The model is serialised here from the vocabulary alone: each token's bytes become one character each
(byte b is U+0100 + b), a piece's score is its negative rank, and the normaliser changes nothing. The
merge with the highest score is then the merge of the lowest rank, leftmost first.
"""

from __future__ import annotations

import base64
import itertools
import struct
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from bookwright.llm import pretokens
from bookwright.llm.common import map_texts, text_or_empty

CACHE_ENTRIES = 200_000
CACHE_CHARS = 64
_UP = {b: 0x100 + b for b in range(256)}
_DOWN = {0x100 + b: b for b in range(256)}


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in the order of their ranks, which start at 0 and leave no gap."""
    with open(path, "rb") as file:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, file))
    if [rank for rank, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return [token for _, token in ranked]


def to_chars(data: bytes) -> str:
    return data.decode("latin-1").translate(_UP)


def to_bytes(chars: str) -> bytes:
    return chars.translate(_DOWN).encode("latin-1")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece model whose ids are the ranks; the unknown piece, never met, comes last."""
    # Field numbers of the public model format, kind 2 (unknown) and model type 2 (BPE).
    def piece(text: str, score: float, *more: bytes) -> bytes:
        return _block(1, _block(1, text.encode()) + b"\x15" + struct.pack("<f", score) + b"".join(more))

    pieces = [piece(to_chars(token), -rank) for rank, token in enumerate(tokens)]
    unknown = piece("⁇", 0.0, _number(3, 2))
    trainer = _number(3, 2) + _number(4, len(tokens) + 1) + _number(40, len(tokens))
    normalizer = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + unknown + _block(2, trainer) + _block(3, normalizer)


@cache
def load(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=serialise(read_ranks(path)))


class Encoder:
    """Ids of pre-tokens, with a bounded memory of those met before."""

    def __init__(self, path: str):
        self.model = load(path)
        self.known: dict[str, tuple[int, ...]] = {}

    def _look_up(self, wanted: set[str]) -> None:
        new = list(wanted.difference(self.known))
        if len(self.known) + len(new) > CACHE_ENTRIES:
            self.known, new = {}, list(wanted)
        ids = self.model.encode([to_chars(t.encode()) for t in new], num_threads=1)
        self.known.update(zip(new, map(tuple, ids), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [pretokens.split(text) for text in texts]
        wanted = set().union(*split)
        self._look_up(wanted)
        ids = self.known.__getitem__
        found = [np.fromiter(itertools.chain.from_iterable(map(ids, parts)), np.int32) for parts in split]
        for long in [t for t in wanted if len(t) > CACHE_CHARS]:
            del self.known[long]
        return found


@cache
def encoder(path: str) -> Encoder:
    """One for each Python worker, so that its memory serves all its tasks."""
    return Encoder(path)


def list_array(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(offsets, np.concatenate(arrays) if arrays else np.zeros(0, np.int32))


def encode(df: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: the ids of every whole text, one row per input row.

    A null text is the empty text and has no ids; a null or repeated id is carried as it is; columns
    besides the two named are not read. The rank file must lie at the same path on every executor.
    """

    def make():
        own = encoder(ranks_path)

        def fn(batch: pa.RecordBatch) -> dict:
            return {"doc_id": batch.column(0), "ids": list_array(own.encode(batch.column(1).to_pylist()))}

        return fn

    texts = df.select(df[id_col].alias("doc_id"), text_or_empty(text_col).alias("text"))
    return map_texts(texts, "text", f"doc_id {df.schema[id_col].dataType.simpleString()}, ids array<int>", make)


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """The input's columns and ``decoded``, the bytes that the ids stand for (null ids: no bytes)."""
    kept = [c for c in df.columns if c != "decoded"]
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches):
        model = load(ranks_path)
        table = np.array([to_bytes(model.id_to_piece(i)) for i in range(model.vocab_size() - 1)], dtype=object)
        for batch in batches:
            lists = batch.column(kept.index(ids_col))
            values, offsets = lists.flatten().to_numpy(), np.zeros(len(lists) + 1, np.int64)
            np.cumsum(np.asarray(lists.value_lengths().fill_null(0)), out=offsets[1:])
            decoded = [b"".join(table[values[a:b]].tolist()) for a, b in itertools.pairwise(offsets)]
            arrays = [*batch.columns, pa.array(decoded, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "decoded"])

    return df.select(*kept).mapInArrow(run, f"{fields}, decoded binary")
