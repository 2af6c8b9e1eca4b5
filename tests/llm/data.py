"""Small tables for the tests."""

from __future__ import annotations

import random

ODD_TEXTS = [
    None,
    "",
    " ",
    "\n\n",
    "one",
    "It's a  test\t of <|endoftext|> and <s> ▁ ² 中文 \U0001f389 don't",
    "x" * 5000,
    " ".join(["again"] * 3000),
]
#: Columns whose names the operators use inside.
CLASHING = "doc_id long, text string, n_tokens string, ids string, key string, bucket int, spans int, text_key string, n int"


def odd_documents(spark):
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(4, "one"), (4, "two"), (None, "no id"), (None, "no id")]
    return spark.createDataFrame([(i, t, "a", "b", "c", 1, 2, "d", 3) for i, t in rows], CLASHING)


def empty_documents(spark):
    return spark.createDataFrame([], CLASHING)


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7))) for _ in range(n))
