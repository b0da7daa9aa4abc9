"""A corpus from raw documents: quality rules, near-duplicates, personal data, mixing, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textweir.llm.bpe import bpe_digests
from textweir.llm.common import staged, table
from textweir.llm.jaccard import one_of_each
from textweir.llm.mixing import mix
from textweir.llm.pii import mask_pii
from textweir.llm.quality import judge, trusted_ids
from textweir.llm.queries import MIX

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the n-gram ratio keep. A null or empty text has no words, so it
    goes; rows that repeat are judged alike and stay or go each; null ids have no label; without
    labels the rules alone decide. An empty table stays empty. Other columns are dropped."""
    labels = table(spark, sf_dir, "labels")
    return judge(docs.select(COLUMNS), trusted_ids(labels)).where("kept").select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates, one row with the smallest id: five-word shingles with a
    Jaccard similarity of 0.8 or more, also over several steps. Documents without an id cannot
    stand for a class and all stay."""
    rows = docs.select(COLUMNS)
    return one_of_each(rows.where("doc_id is not null")).union(rows.where("doc_id is null"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind. A null text stays null, and so n_chars;
    rows that repeat are masked alike, every row stays. Other columns are dropped."""
    masked = mask_pii(docs.select(COLUMNS))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the target mixture; one that is in two epochs comes twice. Null languages and
    sources are leaves of their own, a null text counts one token, rows that repeat are documents
    each, in an order that their ids and texts give. Other columns are dropped."""
    mixed = mix(docs.select(COLUMNS), **MIX)
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of every row of the mixture; a null text counts as empty, null ids
    and rows that repeat give a row each."""
    return bpe_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("pii", personal_data),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: The near-duplicate and token stages are beyond SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each to what its predecessor wrote."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
