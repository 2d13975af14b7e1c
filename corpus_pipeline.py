"""The corpus pipeline: quality rules, SimHash near-dedup, benchmark decontamination, secret scans, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkveil.llm import decontaminate, packing, quality_rules, secrets, simhash
from linkveil.session import drop_made, made, materialize

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("simhash", simhash.stage),
    ("decontamination", decontaminate.stage),
    ("secrets", secrets.stage),
    ("packing", packing.stage),
]

#: Learned rules, fingerprints and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage leaves in the shared folder goes when its result is written, and that with the next."""
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), made(spark)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        drop_made(spark, since, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
