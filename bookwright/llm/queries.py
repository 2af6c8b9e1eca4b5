"""The registered queries of the operators, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookwright.llm import (
    byte_bpe,
    conversation_repair,
    dart_minhash,
    gated_lm,
    html_extract,
    impact_topk,
    line_join,
    outliers,
    packing,
    secret_ledger,
    subword_toxicity,
    token_counts,
    whitening,
)
from bookwright.llm.common import same_row, text_key
from bookwright.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
TOKEN_LIMIT = 4096
SEQUENCE = 1024
END_ID = 2
TOP_K = 20
QUERY_EVERY = 20

_REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _REGISTRY[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every document, as digests."""
    both = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), RANKS), RANKS)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op2_consensus_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op3_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, found through a new ledger."""
    found = secret_ledger.scan_versions(table(spark, sf_dir, "documents"), scratch_path(spark, "ledger"))
    spans = F.coalesce("spans", F.array().cast(secret_ledger.SPANS))
    return found.select(
        "doc_id",
        *(secret_ledger.count(spans, k).alias(f"n_{k}") for k in secret_ledger.BASE_KINDS),
        F.sha2(secret_ledger.digest(secret_ledger.base_spans(spans)), 256).alias("base_sha256"),
        secret_ledger.digest(spans).alias("spans"),
    )


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), PIECES)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


@query
def op5_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = outliers.quality(table(spark, sf_dir, "documents"))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *base, "base_failed", "kept")


@query
def op6_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dart_minhash.near_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_docs", (F.col("doc_id") == F.col("class_id")).alias("kept"))


@query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return packing.pack_documents(documents, TOKENIZER, SEQUENCE, END_ID, {"ids_crc32": F.crc32("ids")})


@query
def op8_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0, TOP_K)


@query
def op9_line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that are dropped from each document as repeats of an earlier line, exact or nearly so, and all lines of
    such classes with their class and their number of links."""
    documents = table(spark, sf_dir, "documents")
    line = F.struct("line_no", F.col("class").alias("class_id"), "n_links", "dropped")
    lines = line_join.line_links(documents).groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    rows = documents.select("doc_id", text_key().alias("_key"))
    dropped = F.transform(F.filter("lines", lambda x: x["dropped"]), lambda x: x["line_no"])
    return rows.join(lines, same_row(rows, lines, "doc_id"), "left").select(
        rows["doc_id"],
        F.coalesce(F.size(dropped), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(F.array_join(dropped.cast("array<string>"), ","), F.lit("")).alias("dropped"),
        F.transform("lines", lambda x: x.dropFields("dropped")).alias("lines"),
    )


@query
def op10_gated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated_lm.scores(table(spark, sf_dir, "documents"))


@query
def op11_survivor_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations with their faults, the cheapest repair and a hash of its result."""
    rows, present = conversation_repair.damage(table(spark, sf_dir, "conversations"))
    return conversation_repair.repair(rows, present=present)


@query
def op12_spectrum_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


@query
def op13_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subword_toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
