"""Query of the packing operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.packing import pack


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_minimum_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), capacity=4096, end=2))


QUERIES = {"op10_minimum_bin_slack_packing": op10_minimum_bin_slack_packing}
SQL: dict[str, str] = {}
