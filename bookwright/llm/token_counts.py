"""Token counts of a sentencepiece BPE model from its counts of pre-tokens.

No piece of such a model has a space mark behind another character, so no merge crosses the place where
one space run begins, and the pieces of a text are those of its pre-tokens: a space run and what follows.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from bookwright.llm.common import map_texts, text_or_empty

CACHE_ENTRIES = 400_000
CACHE_CHARS = 64
MARK = "▁"
_PRETOKEN = re.compile(" +[^ ]*")


class PieceCounter:
    """Counts pieces once per distinct pre-token, with a bounded memory of those met before."""

    def __init__(self, model_path: str):
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=model_path)
        if m.normalize(" a²  b ") != f"{MARK}{MARK}a²{MARK}{MARK}b{MARK}":
            raise ValueError("the model's normaliser must keep texts as they are and put one space in front")
        pieces = (m.id_to_piece(i) for i in range(m.vocab_size()))
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("the model has pieces that go on past a space")
        self.known: dict[str, int] = {" ": 1}

    def frequencies(self, text: str) -> Counter:
        return Counter(_PRETOKEN.findall(" " + text.replace(MARK, " "))) if text else Counter()

    def _look_up(self, wanted: set[str]) -> None:
        new = list(wanted.difference(self.known))
        if len(self.known) + len(new) > CACHE_ENTRIES:
            self.known = {" ": 1}
            new = list(wanted.difference(self.known))
        # The model puts the space in front that is taken off here.
        ids = self.model.encode([t[1:] for t in new], num_threads=1)
        self.known.update(zip(new, map(len, ids), strict=True))

    def lengths(self, texts: list[str]) -> list[int]:
        """Joins the counts to each text's pre-token frequencies and sums; no text's ids are made."""
        each = [self.frequencies(text) for text in texts]
        wanted = set().union(*each)
        self._look_up(wanted)
        pieces = self.known
        sums = [sum(n * pieces[t] for t, n in own.items()) for own in each]
        for long in [t for t in wanted if len(t) > CACHE_CHARS]:
            del pieces[long]
        return sums


@cache
def counter(model_path: str) -> PieceCounter:
    """One for each Python worker, so that its memory serves all its tasks."""
    return PieceCounter(model_path)


def count_tokens(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every whole text, one row per input row.

    A null or empty text has no tokens; a null or repeated id is carried as it is; columns besides the
    two named are not read. The model file must lie at the same path on every executor.

    A pre-token is counted once per task and run of rows, and remembered there within a bound. A join
    of all documents' frequencies with one table of the corpus's pre-tokens gives the same sums, but
    moves a row for each document and distinct pre-token (see README).
    """

    def make():
        own = counter(model_path)

        def fn(batch: pa.RecordBatch) -> dict:
            n_bytes = pc.cast(pc.binary_length(batch.column(1)), pa.int64())
            n_tokens = np.array(own.lengths(batch.column(1).to_pylist()), np.int64)
            return {"doc_id": batch.column(0), "n_bytes": n_bytes, "n_tokens": n_tokens}

        return fn

    texts = df.select(df[id_col].alias("doc_id"), text_or_empty(text_col).alias("text"))
    id_type = df.schema[id_col].dataType.simpleString()
    return map_texts(texts, "text", f"doc_id {id_type}, n_bytes bigint, n_tokens bigint", make)
