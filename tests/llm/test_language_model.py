"""The recurrent model: gradients, whole-text scores, counts and base scores."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from bookwright.llm import gated_lm as M
from bookwright.llm import gated_net as G
from tests.llm.data import empty_documents, odd_documents


@pytest.fixture
def net():
    rng = np.random.default_rng(0)
    flat = G.initial(np.arange(1000, 0, -1.0), 500.0)
    return G.Net(flat + rng.normal(0, 0.05, G.SIZE).astype(np.float32))


def _texts(seed: int, lengths=(20, 13, 9, 1, 75)):
    rng = np.random.default_rng(seed)
    return [rng.integers(0, G.KNOWN + 1, n).astype(np.int32) for n in lengths]


def test_gradients(net):
    texts = sorted(_texts(1, (20, 13, 9, 1)), key=len, reverse=True)
    ((n, w),) = G.windows(texts, 0)
    states, _, steps = net._run(w, np.zeros((n, G.HIDDEN), np.float32), True)
    flat = np.zeros(G.SIZE, np.float32)
    grads = G.views(flat)
    _, back = net._output(states[w.runs], w.wanted[w.runs], grads)
    above = np.zeros_like(states)
    above[w.runs] = back
    net._back(w, steps, above, grads)
    for i in np.argsort(-np.abs(flat))[:400:20]:
        losses = []
        for step in (0.01, -0.01):
            moved = net.flat.copy()
            moved[i] += step
            losses.append(-G.Net(moved).score(texts, 0).sum())
        assert flat[i] == pytest.approx((losses[0] - losses[1]) / 0.02, rel=0.03, abs=0.01)


def test_whole_texts_are_scored_with_the_state_carried_on(net):
    texts = _texts(2)
    together = net.score(texts, 0)
    p = net.p
    for text, got in zip(texts, together, strict=True):
        h, total, given = np.zeros(G.HIDDEN), 0.0, 0
        for token in text:
            own, back = p["E"][given], h @ p["U"]
            z, r = np.split(1 / (1 + np.exp(-(own + back)[: 2 * G.HIDDEN])), 2)
            new = np.tanh(own[2 * G.HIDDEN :] + r * back[2 * G.HIDDEN :])
            h = new + z * (h - new)
            logits = h @ p["Wc"] + p["bc"]
            c = token // G.CLASS_WORDS
            total += logits[c] - np.log(np.exp(logits).sum())
            if c < G.CLASSES:
                logits = h @ p["Ww"][c] + p["bw"][c]
                total += logits[token % G.CLASS_WORDS] - np.log(np.exp(logits).sum())
            given = token
        assert got == pytest.approx(total, rel=1e-4)
    assert net.score([], 0).tolist() == []


def test_probabilities_sum_to_one(net):
    start = np.arange(G.KNOWN + 1, dtype=np.int32)
    assert np.exp(net.score([np.array([t], np.int32) for t in start], 0)).sum() == pytest.approx(1, abs=1e-3)


def brute_force(docs: dict) -> dict:
    tokens = {i: M.words_of(t) for i, t in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    counts = Counter(w for i, own in tokens.items() if not held[i] for w in own)
    n, v = sum(counts.values()), len(counts)
    space = math.log10(n + v + 1)
    return {
        i: (held[i], len(own), sum(counts[w] > 0 for w in own), n, sum(math.log10(counts[w] + 1) - space for w in own))
        for i, own in tokens.items()
    }


def test_counts_and_base_scores(spark, monkeypatch):
    monkeypatch.setattr(M, "DICTIONARY", 2000)  # so that many words are met in groups
    monkeypatch.setattr(M, "COUNT_WORDS", 500)
    monkeypatch.setattr(M, "BLOCK_CHARS", 40_000)
    monkeypatch.setattr(M, "GROUP_WORDS", 3000)
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    docs = {r.doc_id: r.text or "" for r in df.collect()}
    rows = M.scores(df).collect()
    want = brute_force(docs)
    assert len(rows) == len(want)
    for r in rows:
        held, n_tokens, n_known, n, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n_tokens, n_known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0


def test_held_out_texts_become_more_likely(spark):
    rows = M.scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_odd_and_empty_documents(spark):
    rows = M.scores(odd_documents(spark)).collect()
    assert len(rows) == odd_documents(spark).count()
    assert sorted(r.n_tokens for r in rows)[:4] == [1, 1, 1, 1] and all(math.isfinite(r.score) and r.score <= 0 for r in rows)
    assert M.scores(empty_documents(spark)).count() == 0
    only_held_out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,) = M.scores(spark.createDataFrame([(only_held_out, "a b")], "doc_id long, text string")).collect()
    assert (row.train_tokens, row.n_known, row.base_score) == (0, 0, 0.0)


def test_words_get_numbers_of_which_rare_ones_are_forgotten_between_blocks(monkeypatch, net):
    monkeypatch.setattr(M, "COUNT_WORDS", 2)
    words = M.Dictionary({M.word_hash(M.END): (0, 5), M.word_hash(b"a"): (1, 4), M.word_hash(b"b"): (G.TAIL, 2)})
    assert words.of([b"a", b"x", M.END, b"y", b"x", b"b"]).tolist() == [1, 3, 0, 4, 3, 2]
    texts = ["z a z\tX", "", "b x z"]
    block = M.BlockScores(texts, words, net, 0)  # x and y are forgotten first
    assert block.hashes.tolist() == [M.word_hash(b"z"), M.word_hash(b"x")]
    assert sorted(block.triples.T.tolist()) == [[0, 0, 2], [0, 1, 1], [2, 0, 1], [2, 1, 1]]
    assert (block.n_tokens.tolist(), block.n_known.tolist(), block.n_tail.tolist()) == ([5, 1, 4], [2, 1, 2], [3, 0, 3])
    assert block.tail_logs.tolist() == pytest.approx([0, 0, math.log10(3)])
    alone = [net.score(M._tokens([t], words), 0)[0] / math.log(10) for t in texts]
    assert block.score.tolist() == pytest.approx(alone, rel=1e-5)


def test_windows_hold_each_token_once(monkeypatch):
    texts = sorted(_texts(4, (70, 33, 32, 5, 1, 0)), key=len, reverse=True)
    seen = [[] for _ in texts]
    for n, w in G.windows(texts, 7):
        for i in range(n):
            got, before = w.wanted[w.runs[:, i], i].tolist(), w.given[w.runs[:, i], i].tolist()
            assert before == [*(seen[i][-1:] or [7]), *got[:-1]]
            seen[i] += got
    assert seen == [t.tolist() for t in texts]
