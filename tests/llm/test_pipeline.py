"""The pipeline against plain Python, and the contract of its stages."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as P
from bookwright.llm import line_join as L
from bookwright.llm import secret_ledger
from tests.llm.data import empty_documents, odd_documents
from tests.llm.test_lines import expected
from tests.llm.test_near import class_ids

SF = "/root/testdata/sf0.001"


def test_stages_equal_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = P.quality_rules(spark, docs, SF)
    assert kept.columns == docs.columns
    kept.write.parquet(f"{tmp_path}/kept")
    kept = spark.read.parquet(f"{tmp_path}/kept")
    verdicts = {r.doc_id: r.kept for r in P.outliers.quality(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if verdicts[r.doc_id]}
    assert {r.doc_id: r.text for r in kept.collect()} == texts

    lined = P.line_dedup(spark, kept, SF)
    assert lined.columns == docs.columns
    lined.write.parquet(f"{tmp_path}/lined")
    lined = spark.read.parquet(f"{tmp_path}/lined")
    long = sorted({x.strip(" \t\r\x0b\x0c") for t in texts.values() for x in t.split("\n")})
    group = {x: g[0] for g in expected([x for x in long if len(x) >= L.MIN_CHARS], 1) for x in g}
    seen, want = set(), {}
    for doc_id, text in sorted(texts.items()):
        left = []
        for line in text.split("\n"):
            bare = line.strip(" \t\r\x0b\x0c")
            name = group.get(bare, bare)
            if len(bare) < L.MIN_CHARS or name not in seen:
                left.append(line)
            if len(bare) >= L.MIN_CHARS:
                seen.add(name)
        if left == text.split("\n") or "\n".join(left).strip(" \t\n\r\x0b\x0c"):
            want[doc_id] = "\n".join(left)
    got = {r.doc_id: r.text for r in lined.collect()}
    assert got == want and all(r.n_chars == len(r.text) for r in lined.collect())

    single = P.near_dedup(spark, lined, SF)
    assert single.columns == docs.columns
    ids = class_ids(sorted(want.items()))
    want = {i: t for i, t in want.items() if ids[i] == i}
    single.write.parquet(f"{tmp_path}/single")
    single = spark.read.parquet(f"{tmp_path}/single")
    assert {r.doc_id: r.text for r in single.collect()} == want

    masked = P.secret_scans(spark, single, SF)
    assert masked.columns == docs.columns
    rows = masked.collect()
    assert {r.doc_id for r in rows} == set(want)
    assert not any(k in secret_ledger.BASE_KINDS for r in rows for k, _, _ in secret_ledger.find_spans(r.text))
    assert all(r.text == want[r.doc_id] for r in rows if not secret_ledger.find_spans(want[r.doc_id]))


def test_run_packs_what_is_left(spark):
    model = Tokenizer.from_file(P.TOKENIZER)
    rows = P.run(spark, SF).collect()
    tokens, places = defaultdict(dict), defaultdict(list)
    for r in rows:
        tokens[r.doc_id][r.start] = np.frombuffer(r.ids, "<u4")
        places[r.sequence_id].append((r.offset, r.length))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(tokens) <= set(docs)
    for doc_id, own in tokens.items():
        ids = np.concatenate([own[s] for s in sorted(own)])
        assert ids[-1] == P.END_ID
        if not secret_ledger.find_spans(docs[doc_id]) and "[secret]" not in (text := model.decode(ids[:-1].tolist())):
            assert set(text.split("\n")) <= set(docs[doc_id].split("\n"))
    for own in places.values():
        assert sum(n for _, n in own) <= P.SEQUENCE
        assert sorted(o for o, _ in own) == np.cumsum([0] + [n for _, n in sorted(own)])[:-1].tolist()


def test_odd_and_empty_documents(spark):
    for docs in (odd_documents(spark).selectExpr("*", "'' lang", "cast(null as string) source"), empty_documents(spark).selectExpr("*", "'' lang", "'' source")):
        for _, stage in P.STAGES[:-1]:
            assert stage(spark, docs, SF).columns == docs.columns
        for _, stage in P.STAGES:
            stage(spark, docs, SF).count()
