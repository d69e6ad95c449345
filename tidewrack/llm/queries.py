"""One query for each operator, on its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewrack.llm import fingerprints, langid, packing, quality, sampling, sharding, simhash, suffix_dedup, toxicity, url_filters

#: SentencePiece model that op5 encodes with.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template of each page's URL, its labelled purity and the decision."""
    return url_filters.judge(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op2_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each document's length that lies in chunks of other documents."""
    return fingerprints.containment(_table(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies to remove and the document of their group that stays."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that pass line-first cleaning, with their cleaned text."""
    return quality.report(_table(spark, sf_dir, "documents"))


def op5_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampled, reproducible segmentation of each document."""
    return sampling.sample_encode(_table(spark, sf_dir, "documents"), MODEL)


def op6_packed_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of documents, with the pieces of those that are longer than one."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous shard of each document, in order of ids."""
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op8_toxic_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Significant toxic passages of all documents."""
    return toxicity.toxic_passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document, and whether it is sure."""
    return langid.identify(_table(spark, sf_dir, "documents"))


def op10_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of words that repeat earlier text of the corpus."""
    return suffix_dedup.repeated_spans(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries of this subpackage but the pipeline."""
    every = (op1_url_templates, op2_containment, op3_near_duplicates, op4_quality_rules, op5_sampled_pieces, op6_packed_bins, op7_shards, op8_toxic_passages, op9_language_id, op10_repeated_spans)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of those that SQL can express."""
    return {"op1_url_templates": url_filters.SQL, "op4_quality_rules": quality.SQL, "op7_shards": sharding.SQL, "op10_repeated_spans": suffix_dedup.SQL}
