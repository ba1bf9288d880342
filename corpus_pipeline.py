"""The corpus pipeline: five stages over documents, each written and read again."""

from __future__ import annotations

from llm import stages
from llm.storage import stored
from pyspark.sql import DataFrame, SparkSession

STAGES = [
    ("quality", stages.keep_quality),
    ("near_dedup", stages.drop_near_duplicates),
    ("decontamination", stages.drop_contaminated),
    ("pii", stages.pseudonymise),
    ("packing", stages.pack),
]
#: Trained models, edit distances and permutations keep SQL from expressing the stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
