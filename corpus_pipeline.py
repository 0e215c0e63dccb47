"""From documents to encoded training text: quality, exact and near duplicates, the mix, and BPE ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from seedloom.llm import bpe_lexicon, exact_dedup, kn_quality, mixing, ngram_join
from seedloom.llm.queries import LEVELS, MIX_SEED
from seedloom.llm.util import checkpointed, read, small_batches

#: Of ten parts of the tokens that reach the mix, those that it takes; no document is taken twice.
TENTHS = 9


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the trusted texts' model passes their language's fence go."""
    small_batches(spark)
    trusted = read(spark, sf_dir, "labels").filter("quality = 1 and doc_id is not null")
    return kn_quality.accepted_rows(docs, trusted)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest id stays."""
    return exact_dedup.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 over five-word shingles, the one with the smallest id stays."""
    small_batches(spark)
    return ngram_join.keep_one(docs, words=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tree's budgets decide how much of each source stays."""
    return mixing.mix(docs, LEVELS, f"tokens * {TENTHS} div 10", 1, MIX_SEED).select(docs.columns)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with digests of the ids and of what they decode to."""
    small_batches(spark)
    return bpe_lexicon.bpe_digests(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_duplicates),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", source_mix),
    ("BPE encoding and decoding", bpe_encoding),
]

#: The first stage's model is not expressible in SQL. Stages are tested as operators; the whole is not held against brute force yet.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = checkpointed(docs)
    return docs
