"""From raw documents to token files: filter, dedup, decontaminate, mix, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscan.llm import common, decontam, mixing, ordermin, quality, tokens
from folioscan.llm.queries import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return ordermin.deduplicated(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, listed by document."""
    return tokens.token_ids(docs, tokenizer_path())


STAGES = [
    ("quality classifier", keep_quality),
    ("near-duplicates", keep_one_of_near_duplicates),
    ("decontamination", keep_uncontaminated),
    ("mixing", mix_sources),
    ("token files", write_tokens),
]

#: trees, sketches and vocabulary merges are beyond SQL; tests use brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again by the next stage."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
