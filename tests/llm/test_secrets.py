"""Secret scans: rules against the contract's patterns, the ledger, and masking."""

from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from bookwright.llm import secret_ledger as L
from bookwright.llm.queries import all_queries
from bookwright.session import scratch_path
from tests.llm.data import empty_documents, odd_documents

# The contract's patterns.
BASE = [
    ("assign", re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), lambda m: len(m[2]) >= 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]


def base(text: str) -> list[tuple[str, int, int]]:
    found = [(kind, *m.span()) for kind, p, good in BASE for m in p.finditer(text) if good(m)]
    return sorted(found, key=lambda s: (s[1], [k for k, _, _ in BASE].index(s[0])))


_PARTS = st.sampled_from(["token", "=", " ", ":", "SECRET", '"', "abcdef12", "AKIA", "ABCDEFGH1234", "0123456789abcdef" * 2, "ſ", "api_key", "\U0001f389", "x"])


@settings(max_examples=400, deadline=None)
@given(st.lists(_PARTS, max_size=12).map("".join))
def test_base_spans_equal_the_patterns(text):
    assert [s for s in L.find_spans(text) if s[0] in L.BASE_KINDS] == base(text)


def test_method_adds_key_formats():
    text = "ghp_" + "x9" * 20 + " -----BEGIN RSA PRIVATE KEY-----\nMII=\n-----END RSA PRIVATE KEY----- xoxb-1234567890-ab"
    assert [k for k, _, _ in L.find_spans(text)] == ["github", "private_key", "slack"]


def test_only_unseen_blobs_are_scanned(spark):
    path = scratch_path(spark, "ledger")
    first = spark.createDataFrame([(1, "token=abcdefgh1"), (2, "token=abcdefgh1"), (3, None), (4, "")], "doc_id long, text string")
    rows = L.scan_versions(first, path).collect()
    assert sorted((r.doc_id, len(r.spans)) for r in rows) == [(1, 1), (2, 1), (3, 0), (4, 0)]
    assert spark.read.parquet(path).count() == 2
    # A finding that only the ledger has shows that the seen text isn't scanned again.
    fake = spark.read.parquet(path).filter("size(spans) > 0").selectExpr("blob", "rule_version", "concat(spans, spans) spans")
    other = scratch_path(spark, "ledger")
    fake.write.parquet(other)
    more = first.union(spark.createDataFrame([(5, "secret: 12345678")], "doc_id long, text string"))
    assert {r.doc_id: len(r.spans) for r in L.scan_versions(more, other).collect()} == {1: 2, 2: 2, 3: 0, 4: 0, 5: 1}
    assert spark.read.parquet(other).count() == 3


def test_older_rule_versions_do_not_count(spark, monkeypatch):
    path = scratch_path(spark, "ledger")
    df = spark.createDataFrame([(1, "token=abcdefgh1")], "doc_id long, text string")
    L.update_ledger(df, path).collect()
    monkeypatch.setattr(L, "RULE_VERSION", 99)
    assert L.update_ledger(df, path).count() == 1
    assert spark.read.parquet(path).count() == 2


def test_odd_and_empty_documents(spark):
    found = L.scan_versions(odd_documents(spark), scratch_path(spark, "ledger"))
    assert found.count() == odd_documents(spark).count()
    assert L.scan_versions(empty_documents(spark), scratch_path(spark, "ledger")).count() == 0


def test_masking(spark):
    key = "0123456789abcdef" * 2
    rows = [(1, f"\U0001f389 token={key} and AKIA{'A' * 16}."), (2, "clean"), (3, None), (1, f"{key}|{key}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' blob", "1 spans")
    got = L.redact(df, scratch_path(spark, "ledger"))
    assert got.columns == df.columns
    want = [(1, "\U0001f389 [secret] and [secret]."), (1, "[secret]|[secret]"), (2, "clean"), (3, None)]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


def test_query(spark):
    import hashlib

    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = all_queries()["op3_secret_ledger"](spark, sf).collect()
    assert len(rows) == len(docs) and sum(r.n_assign for r in rows) > 0
    for r in rows:
        want = base(docs[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for k, _, _ in want) for kind in L.BASE_KINDS)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) - {""} <= set(r.spans.split(","))
