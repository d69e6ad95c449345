"""Corpus cleaning as a chain of stages, each reading what the last one wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewrack.llm import langid, packing, quality, simhash, suffix_dedup
from tidewrack.llm._scratch import cut


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their failing lines, and without those that lose too much.

    Null, empty and blank texts go; repeated rows are judged alike; an empty
    table stays empty; other columns stay as they are, ``n_chars`` is counted anew.
    """
    return quality.clean(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is sure; the model is fitted on a bounded sample of the rows labelled in ``lang``.

    Texts without letters go, null ones too; without a labelled row no language
    is sure, so everything goes. Null ids and repeated rows are rows like others.
    """
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the least id, a null one only where there is no other.

    Of repeated rows one stays; texts without words are in no group and stay.
    """
    return simhash.drop_near_duplicates(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words and more that stand earlier in the corpus, in order of ids, null ids last.

    Documents that lose all their words go, of repeated rows all but one; short,
    empty and null texts stay as they are.
    """
    return suffix_dedup.drop_repeated(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of the documents that are left: ``bin_id``, ``doc_ids``, ``pieces``, ``used``.

    Null and empty texts have no piece; null ids stay null; no documents, no bins.
    """
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("packed", packed)]

#: SQL can't express the fingerprints or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
