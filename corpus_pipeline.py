"""From raw documents to packed training sequences, one stage per operator.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its
result is written as Parquet and read again as the next stage's documents. All but the
last return the columns of ``documents``.

All stages take an empty table to an empty one, keep repeated rows apart, read whole
texts of any length and leave further columns, whatever their names, as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from microatlas.llm import mixing, packing, quality, secret_scan, simhash
from microatlas.llm.queries import documents, tokenizer_path
from microatlas.runtime import settle


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the repetition rules. Null and empty texts have no words and go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints of four-word shingles link at four bits.

    The smallest id stays, null ids last; of repeated rows one stays. Texts without words
    have fingerprint zero and are one group with all that lies near it.
    """
    return simhash.keep_one(docs, radius=4, words=4)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with owner-specific secrets masked. Null texts stay null; a null source
    or lang is an owner of its own."""
    return secret_scan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them. A null source is the last one; texts
    without words weigh nothing; equal ids are told apart by their texts."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in the training sequences. A null text is empty
    and has the one closing id; pieces of equal length are placed in any order."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), keep=["doc_id"])


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixture),
    ("best-fit packing", packed),
]

#: Fingerprints and tokens are beyond SQL; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline's last rows; each stage is written to the shared folder first."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
