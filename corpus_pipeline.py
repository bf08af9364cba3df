"""From raw documents to packed training sequences, stage by stage.

``STAGES`` lists the stages in order. Each takes what the one before it has
kept, written as Parquet and read again; all but the last return the columns of
``documents``. :func:`run` applies them to the table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from scrubline.llm import decontam, linededup, minhash, packing, quality
from scrubline.llm.common import load
from scrubline.staging import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counting rules and the likelihood ratio."""
    return quality.keep(docs, load(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand on five sites or more; those left without a word go.

    Long passages wait for :func:`near_dedup`, which could not tell copies by what is left of them.
    """
    return linededup.clean(docs, long_sites=5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles with a similarity of 0.8 or more.

    In those that stay, lines of over 50 words on two sites or more go but for their first
    occurrence; a document of nothing else stays whole.
    """
    return linededup.clean(stage(minhash.keep_one(docs), "one_each"), emptied="keep")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontam.clean(docs, load(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Tokenizing, hashing and the fitted threshold are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that every stage has kept."""
    docs = load(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
