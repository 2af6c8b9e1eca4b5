"""Byte-level BPE, token counts and packing against the public libraries."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from bookwright.llm import byte_bpe, packing, pretokens, token_counts
from bookwright.llm.queries import PIECES, RANKS, TOKENIZER
from tests.llm.data import empty_documents, odd_documents


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_split_of_every_latin_character_equals_the_pattern():
    for code in [*range(0x300), 0x2028, 0x3000, 0x200B, 0x4E2D, 0x1F389]:
        text = f"a{chr(code)}b 1{chr(code)} {chr(code)}{chr(code)} x"
        assert pretokens.split(text) == pretokens._ANY.findall(text), hex(code)


def test_every_token_is_reached_by_merges():
    tokens = byte_bpe.read_ranks(RANKS)
    ids = byte_bpe.load(RANKS).encode([byte_bpe.to_chars(t) for t in tokens], num_threads=1)
    assert ids == [[i] for i in range(len(tokens))]


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40))
def test_encoders_equal_the_libraries(library, text):
    assert byte_bpe.encoder(RANKS).encode([text])[0].tolist() == library.encode_ordinary(text)
    counter = token_counts.counter(PIECES)
    assert counter.lengths([text]) == [len(counter.model.encode(text))]


def test_memory_is_bounded(monkeypatch, library):
    monkeypatch.setattr(byte_bpe, "CACHE_ENTRIES", 3)
    encoder = byte_bpe.Encoder(RANKS)
    for text in ("a b c d e f", "g " + "h" * 200, "a b"):
        assert encoder.encode([text])[0].tolist() == library.encode_ordinary(text)
    assert not any(len(t) > byte_bpe.CACHE_CHARS for t in encoder.known)


def test_encode_and_decode_of_odd_documents(spark, library):
    got = byte_bpe.decode(byte_bpe.encode(odd_documents(spark), RANKS), RANKS).collect()
    want = [(r.doc_id, r.text or "") for r in odd_documents(spark).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1]))
    assert sorted(((r.doc_id, bytes(r.decoded).decode()) for r in got), key=key) == sorted(want, key=key)
    assert all(r.ids == library.encode_ordinary(bytes(r.decoded).decode()) for r in got)
    assert byte_bpe.decode(byte_bpe.encode(empty_documents(spark), RANKS), RANKS).count() == 0


def test_token_counts_of_odd_documents(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = Counter(tuple(r) for r in token_counts.count_tokens(odd_documents(spark), PIECES).collect())
    texts = [(r.doc_id, r.text or "") for r in odd_documents(spark).collect()]
    assert got == Counter((i, len(t.encode()), len(model.encode(t))) for i, t in texts)
    assert token_counts.count_tokens(empty_documents(spark), PIECES).count() == 0


def _fewest(items: list[int], most: int) -> int:
    best = len(items)

    def go(at: int, bins: list[int]) -> None:
        nonlocal best
        if len(bins) >= best:
            return
        if at == len(items):
            best = len(bins)
            return
        for i in {b: i for i, b in enumerate(bins) if b + items[at] <= most}.values():
            bins[i] += items[at]
            go(at + 1, bins)
            bins[i] -= items[at]
        go(at + 1, [*bins, items[at]])

    items = sorted(items, reverse=True)
    go(0, [])
    return best


def test_reduction_keeps_a_best_packing():
    rng = random.Random(5)
    for _ in range(400):
        most = rng.randint(5, 20)
        items = [rng.randint(1, most) for _ in range(rng.randint(0, 9))]
        fixed, rest = packing.reduce_instance(Counter(items), most)
        left = [x for x, n in rest.items() for _ in range(n)]
        assert sum(fixed.values()) + _fewest(left, most) == _fewest(items, most), (most, items)
        assert sum(packing.plan(Counter(items), most).values()) == _fewest(items, most)


def test_best_fit_equals_one_piece_at_a_time():
    rng = random.Random(6)
    for _ in range(100):
        counts = {rng.randint(1, 50): rng.randint(1, 30) for _ in range(8)}
        rooms: list[int] = []
        for x in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
            fits = [r for r in rooms if r >= x]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else 50) - x)
        assert sum(packing.best_fit(counts, 50).values()) == len(rooms)


def test_packed_documents(spark):
    found = packing.pack_documents(odd_documents(spark), TOKENIZER, 64, 2).collect()
    model = Tokenizer.from_file(TOKENIZER)
    texts = Counter((r.doc_id, r.text or "") for r in odd_documents(spark).collect())
    want = Counter()
    for (doc_id, text), n in texts.items():
        ids = [*model.encode(text, add_special_tokens=False).ids, 2]
        for k, (start, length) in enumerate(packing.cut(len(ids), 64)):
            data = np.array(ids[start : start + length], "<u4").tobytes()
            want[doc_id, k, start, length, zlib.crc32(data)] += n
    assert Counter((r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in found) == want
    places = defaultdict(list)
    for r in found:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(places) >= -(-sum(r.length for r in found) // 64)
    assert packing.pack_documents(empty_documents(spark), TOKENIZER, 64, 2).count() == 0


def test_a_hot_length_is_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 50)
    df = spark.range(700).selectExpr("id doc_id", "0 piece", "if(id % 3 = 0, id % 7 + 1, 5L) length").repartition(3)
    found = packing.pack(df, 16).collect()
    assert len({(r.sequence_id, r.offset) for r in found}) == len(found) == 700
    used = Counter()
    for r in found:
        used[r.sequence_id] += r.length
    counts = Counter(r.length for r in found)
    assert max(used.values()) <= 16 and len(used) == sum(packing.plan(counts, 16).values())


def test_cut_has_the_short_piece_first():
    assert packing.cut(10, 4) == [(0, 2), (2, 4), (6, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(3, 4) == [(0, 3)]


def test_query_digests(spark, library):
    from bookwright.llm.queries import all_queries

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in all_queries()["op1_byte_bpe"](spark, sf).collect():
        ids = library.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
