"""The corpus pipeline: documents go through five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.exact_dedup import stage_exact_dedup
from palimpsest.llm.packing import stage_packing
from palimpsest.llm.quality_rules import stage_quality_rules
from palimpsest.llm.simhash import stage_simhash
from palimpsest.llm.suffix_dedup import stage_suffix_dedup
from palimpsest.staging import stage

STAGES = [
    ("quality_rules", stage_quality_rules),
    ("exact_dedup", stage_exact_dedup),
    ("simhash", stage_simhash),
    ("suffix_dedup", stage_suffix_dedup),
    ("packing", stage_packing),
]

#: SimHash, byte suffixes and tokenising are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
