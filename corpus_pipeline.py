"""From raw documents to packed training sequences: the stages, and run() over a whole table.

Language ID drops what is in none of the corpus's languages, the quality classifier what reads like junk, SimHash and an exact search
for what it misses leave one document of each group of near copies, and packing cuts what is left into sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import common, langid, nearcopies, packing, quality, simhash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is recognised; profiles are learned from docs."""
    return langid.keep_identified(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of quality; learned from the labels of those docs that the table `labels` covers."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near copies: five-word shingles of a similarity of 0.8 or more.

    Pairs come from the trie join of SimHash fingerprints, each checked in full, and, past its few bits, from the exact search of nearcopies.
    """
    return simhash.keep_one_each(docs, named=nearcopies.near_copies)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document with its sequence and its place there."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language_id), ("quality_classifier", quality_classifier), ("simhash_dedup", simhash_dedup), ("best_fit_packing", best_fit_packing)]

#: Profiles, a fitted classifier and branch and bound are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; between stages documents are written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    at = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{at}/{name}")
            docs = spark.read.parquet(f"{at}/{name}")
    return docs
