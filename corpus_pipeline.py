"""From raw documents to packed training sequences: toxicity, near copies, personal data, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet in the shared
folder and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from binsieve.llm import packing, pii, simhash, toxicity
from binsieve.llm.common import table, written

TOKENIZER = "byte_bpe_50k.json"
SEQUENCE_TOKENS, END_ID = 1024, 2
#: Near copies share this part of their five-word shingles.
SHINGLE_WORDS, SIMILARITY = 5, 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, learned from the table of labels, doesn't call toxic."""
    return toxicity.reject_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest id."""
    return simhash.drop_near_duplicates(docs, shingle=SHINGLE_WORDS, similarity=SIMILARITY)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind."""
    return pii.redact_pii(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' token pieces in training sequences."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), SEQUENCE_TOKENS, END_ID)


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_copies), ("pii", redact), ("best_fit_packing", pack)]

#: SQL can't express a fitted grammar, XXH64 fingerprints or tokenization; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
