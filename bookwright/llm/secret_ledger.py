"""Secret scans over a ledger of content-addressed texts.

Every version of a text is a blob, named by the SHA-256 of its bytes. The ledger is a Parquet folder
with one row per blob and rule version that were scanned; only pairs that it lacks are scanned, and the
findings go back to every row that holds the blob.
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookwright.llm.common import map_texts, text_or_empty

#: Goes up with every change of the rules; older findings then no longer count as scans.
RULE_VERSION = 1
BASE_KINDS = ("assign", "access", "hex")
# The contract's three kinds (pattern, measured group, least length), then public key formats.
RULES = {
    "assign": (
        r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        1,
        8,
    ),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
    "private_key": (r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END (?:[A-Z]+ )*PRIVATE KEY-----)?", 0, 0),
    "jwt": (r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    "github": (r"\bgh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    "slack": (r"\bxox[abposr]-[A-Za-z0-9-]{10,}", 0, 0),
    "google": (r"\bAIza[A-Za-z0-9_-]{35}", 0, 0),
}
# A text without any of these strings, compared in lower case, cannot match the rule.
_HINTS = {
    "assign": ("passw", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "private_key": ("private key",),
    "jwt": ("eyj",),
    "github": ("gh",),
    "slack": ("xox",),
    "google": ("aiza",),
}
_COMPILED = {kind: (re.compile(p, re.ASCII), group, least) for kind, (p, group, least) in RULES.items()}
_RANK = {kind: i for i, kind in enumerate(RULES)}

SPANS = "array<struct<kind:string,start:int,end:int>>"
LEDGER = f"blob binary, rule_version int, spans {SPANS}"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """Each rule's leftmost matches that do not overlap, by start and then in the order of the rules."""
    lower = text.lower()
    found = []
    for kind, (pattern, group, least) in _COMPILED.items():
        if kind in _HINTS and not any(hint in lower for hint in _HINTS[kind]):
            continue
        found += [(kind, *m.span()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found, key=lambda s: (s[1], _RANK[s[0]]))


def _scan(blobs: DataFrame) -> DataFrame:
    def make():
        def fn(batch: pa.RecordBatch) -> dict:
            rows = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find_spans(t)] for t in batch.column(1).to_pylist()]
            version = pa.array([RULE_VERSION] * len(rows), pa.int32())
            return {"blob": batch.column(0), "rule_version": version, "spans": pa.array(rows, _SPAN_TYPE)}

        return fn

    return map_texts(blobs.select("blob", "text"), "text", LEDGER, make)


def blob_name(text_col: str = "text") -> Column:
    """The SHA-256 of the text; a null text is the empty text."""
    return F.unhex(F.sha2(text_or_empty(text_col), 256))


def update_ledger(df: DataFrame, ledger_path: str, text_col: str = "text") -> DataFrame:
    """Scans the blobs of ``df`` that the ledger lacks under this rule version, and returns its findings.

    One job at a time may write to a ledger. A job that fails leaves it as it was.
    """
    spark = df.sparkSession
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(ledger_path)
    seen = spark.read.schema(LEDGER).parquet(ledger_path).filter(F.col("rule_version") == RULE_VERSION)
    texts = df.select(blob_name(text_col).alias("blob"), text_or_empty(text_col).alias("text"))
    # One row per blob and map task crosses the shuffle, however many copies a text has.
    unseen = texts.groupBy("blob").agg(F.first("text").alias("text")).join(seen.select("blob"), "blob", "left_anti")
    _scan(unseen).write.mode("append").parquet(ledger_path)
    return spark.read.schema(LEDGER).parquet(ledger_path).filter(F.col("rule_version") == RULE_VERSION)


def scan_versions(df: DataFrame, ledger_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, blob, spans``, one row per input row, through the ledger at ``ledger_path``.

    Spans count code points, the end exclusive. A null or empty text has no spans; a null or repeated id
    is carried as it is; columns besides the two named are not read.
    """
    findings = update_ledger(df, ledger_path, text_col).select("blob", "spans")
    versions = df.select(df[id_col].alias("doc_id"), blob_name(text_col).alias("blob"))
    return versions.join(findings, "blob", "left").select("doc_id", "blob", "spans")


def redact(df: DataFrame, ledger_path: str, mask: str = "[secret]", text_col: str = "text") -> DataFrame:
    """The input with every found span replaced by ``mask``; spans that touch or overlap become one."""
    found = update_ledger(df, ledger_path, text_col).filter(F.size("spans") > 0)
    found = found.select(F.col("blob").alias("_blob"), F.col("spans").alias("_spans"))
    text, at = F.col(text_col), F.col("_spans")
    # Merged from left to right: what is kept so far and the place up to which the text is used.
    start = F.struct(F.lit("").alias("kept"), F.lit(0).alias("upto"))

    def step(done: Column, span: Column) -> Column:
        between = F.substring(text, done.upto + 1, span.start - done.upto)
        fresh = (span.start > done.upto) | (done.upto == 0)
        return F.struct(
            F.when(fresh, F.concat(done.kept, between, F.lit(mask))).otherwise(done.kept).alias("kept"),
            F.greatest(done.upto, span.end).alias("upto"),
        )

    masked = F.aggregate(at, start, step, lambda d: F.concat(d.kept, F.substring(text, d.upto + 1, 2**31 - 1)))
    joined = df.withColumn("_blob", blob_name(text_col)).join(found, "_blob", "left")
    clean = joined.withColumn(text_col, F.when(at.isNull(), text).otherwise(masked))
    return clean.select(*df.columns)


def digest(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long")


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda s: reduce(lambda a, b: a | b, (s.kind == k for k in BASE_KINDS)))
