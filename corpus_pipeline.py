"""The corpus pipeline: from raw documents to packed training sequences, one written table a stage.

All stages but the last return the columns of their input, whatever names those have. A null text
counts as empty, a text is never shortened but by `cut_repeats`, and an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftgrain.llm import exact_dedup, ngram_join, packing, quality, suffix_dedup
from shiftgrain.llm.common import is_fold, read, stage


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; labels of the held-out fold are not learnt.

    Null and empty texts score the share of good labels. Null labels and those of null ids are not
    learnt; without any label to learn from every document stays. Repeated rows are judged alike.
    """
    labels = read(spark, sf_dir, "labels").where(~is_fold(F.col("doc_id"), 4, 2))
    return quality.good_documents(docs, quality.fit(read(spark, sf_dir, "documents"), labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document of largest id.

    A null id loses to any other; rows equal in id and text leave one, also under null ids.
    """
    return exact_dedup.distinct_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of smallest id.

    Rows of one id with different texts are documents of their own, and of such a tie the smallest
    hash of the text stays. Texts without words are near to nothing and stay.
    """
    return ngram_join.one_of_each_group(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes that a document of smaller id has.

    Null ids come after all others. A text that is cut away wholly stays as an empty one; `n_chars`
    is counted anew.
    """
    return suffix_dedup.without_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens; an empty text is its closing token alone."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack_sequences),
]

#: Votes of neighbours in a latent space have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the last stage, every stage reading what the one before has written."""
    docs = read(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
