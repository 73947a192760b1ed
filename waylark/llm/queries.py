"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waylark.llm import (
    alignment, bitplanes, html_text, language, licenses, line_dedup, merkle, mixing, packing, prefix_trie, simhash, topk, toxicity,
)
from waylark.llm.common import shared_folder, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = bitplanes.write_tokens(table(spark, sf_dir, "documents"), TOKENIZER, shared_folder(spark, "tokens"))
    return bitplanes.read_tokens(spark, manifest).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


@query
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, bits=2)
    return found.withColumn("fingerprint", simhash.hex_digits(F.col("fingerprint")))


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), seed=42)


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(table(spark, sf_dir, "documents"), TOKENIZER, end_id=1)
    return pieces.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("length"), F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset")


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "segments")


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.without_boilerplate(docs, host="source", dropped="n_dropped").select("doc_id", "text", "n_dropped")


ORACLES["op3_line_dedup"] = line_dedup.ORACLE


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs)
    return language.predicted(docs.select("doc_id", "text"), model).select(
        "doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


@query
def op1_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.with_edits(table(spark, sf_dir, "documents"))


@query
def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


@query
def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), every=100, k=10)


ORACLES["op5_top_k"] = """
WITH whole AS (
    SELECT vec_id, row_number() OVER () AS own, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
    SELECT q.vec_id AS query_id, q.own, c.own AS other, c.vec_id,
        list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM whole q JOIN whole c ON q.own <> c.own AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id, other) AS rank FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query
def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", *licenses.digest())



@query
def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"), TOKENIZER, PIECES)


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(*prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


ORACLES["op11_prefix_trie"] = prefix_trie.ORACLE
