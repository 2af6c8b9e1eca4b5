from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from bookwright.llm import subword_toxicity as T
from tests.llm.data import empty_documents, odd_documents, words

INSULTS = ["grobbler", "snivelwit", "dunderpox", "foulmonger", "wretchling"]


def text(rng, toxic, n=120):
    out = words(rng, n).split()
    if toxic:
        for _ in range(5):
            out[rng.randrange(n)] = rng.choice(INSULTS)
    return " ".join(out)


def grams(word_text):
    """Subwords by plain slicing, as strings."""
    out = []
    word = ""
    for c in word_text.lower() + " ":
        if c.isalnum() or ord(c) > 127:
            word += c
            continue
        if word:
            whole = f" {word} "
            out.append(("word", word))
            out += [(n, whole[i : i + n]) for n in T.GRAMS for i in range(len(whole) - n + 1)]
        word = ""
    return out


@pytest.mark.parametrize("sample", ["", "a", "Ab, c-d Straße", "x" * 50 + " yy", "été 12 \U0001f389", "..", "don't  stop\nnow"])
def test_subwords_are_words_and_grams(sample):
    """One bucket for each of them, and the same bucket for the same one."""
    found = T.subwords(sample)
    assert len(found) == len(grams(sample)) and len(np.unique(found)) == len(set(grams(sample)))


def test_runs_end_at_borders(monkeypatch):
    sample = " ".join(f"word{i}" for i in range(500))
    whole = sorted(T.subwords(sample))
    monkeypatch.setattr(T, "RUN_CHARS", 64)
    assert sorted(T.subwords(sample)) == whole


def test_unseen_misspellings_share_vectors():
    rng = random.Random(2)
    labels = np.array([i % 2 for i in range(400)])
    model = T.train([text(rng, bool(y)) for y in labels], labels)
    held = [(text(rng, y), y) for y in (True, False) for _ in range(60)]
    right = sum((model.score(t) >= 0.5) == y for t, y in held)
    assert right >= 115
    plain = [text(rng, False) for _ in range(20)]
    for spelt in ("grobblerr", "snivellwit", "dunderpoxx", "foulmongerz", "wrretchling"):
        bent = [t + f" {spelt}" * 8 for t in plain]
        assert np.mean([model.score(b) for b in bent]) > np.mean([model.score(p) for p in plain]) + 0.2


def test_held_out_rows_teach_nothing(spark):
    rng = random.Random(4)
    rows = [(i, text(rng, i % 3 == 0), int(i % 3 == 0)) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    right = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    away = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows], "doc_id long, toxic int")
    one = {r["doc_id"]: r for r in T.toxicity(docs, right).collect()}
    two = {r["doc_id"]: r for r in T.toxicity(docs, away).collect()}
    assert one == two and len(one) == 300
    held = [(one[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r["held_out"] for r, _ in held) and sum(r["predicted"] == y for r, y in held) >= 0.9 * len(held)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic"), "doc_id")
    scored = T.toxicity(docs.drop("toxic"), docs.select("doc_id", "toxic")).filter("held_out")
    rows = scored.join(docs.select("doc_id", "toxic"), "doc_id").collect()
    toxic = [r["score"] for r in rows if r["toxic"]]
    clean = [r["score"] for r in rows if not r["toxic"]]
    assert np.mean([s >= 0.5 for s in toxic]) >= 0.8
    assert np.mean([s >= 0.5 for s in clean]) <= 0.03


def test_odd_tables(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (4, 7), (None, 1), (99, 1)], "doc_id long, toxic int")
    odd = odd_documents(spark)
    got = T.toxicity(odd, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert T.toxicity(empty_documents(spark), labels).collect() == []
    none = T.toxicity(odd, labels.filter("false")).collect()
    assert len(none) == odd.count() and all(r["predicted"] == 0 for r in none)
