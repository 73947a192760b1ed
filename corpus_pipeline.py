"""The corpus pipeline: toxic documents out, boilerplate lines out, one document of each
near-duplicate group, a mix of sources by weight, packed training sequences.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it
kept. `run` writes each result as Parquet into the shared folder and reads it again, so
a lost executor costs part of one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waylark.llm import line_dedup, mixing, packing, simhash, toxicity
from waylark.llm.common import stored, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of the labelled ones predicts toxic go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are on too many pages of a source go; n_chars follows the text."""
    cut = line_dedup.without_boilerplate(docs, host="source")
    chars = F.coalesce(F.length("text").cast("bigint"), F.col("n_chars"))
    return cut.select(*[chars.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by fingerprints, the one with the smallest doc_id stays."""
    return simhash.one_of_each(docs, shingle=3, bits=2)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, which may be never."""
    return mixing.mixture(docs, seed=42)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids and their places in the sequences."""
    return packing.packed(docs, TOKENIZER, end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# A trained model, hashes and encoded tokens are beyond SQL; tests compare each stage
# with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = stored(stage(spark, docs, sf_dir), name)
    return docs
