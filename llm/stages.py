"""The five stages of the corpus pipeline, each on all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import decontaminate, near_dedup, packing, pii, quality
from llm.queries_more import pii_key
from llm.queries_pack import digest
from llm.storage import join_checked, stored


def _aside(docs: DataFrame, names: set[str]) -> tuple[DataFrame, list[Column]]:
    """`docs` with clashing columns under other names, and what brings its columns back."""
    clash = {c: f"{c}__of_input" for c in docs.columns if c.lower() in names}
    for old, new in clash.items():
        docs = docs.withColumnRenamed(old, new)
    return docs, [F.col(f"`{c}`").alias(c.removesuffix("__of_input")) for c in docs.columns]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score of 0.7 or more); it learns from this stage's own input."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~quality.held_out())
    docs, columns = _aside(docs, {"score"})
    weights = quality.train(docs, labels)
    return quality.score(docs, weights).where("score >= 0.7").select(columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more.

    Rows are told apart by id and text, so different texts under one id, and
    rows without id, are judged each. Of equal rows one stays, unless they have
    no words; all columns of a row that stays are kept.
    """
    key = "near_key__"
    docs = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    found = stored(near_dedup.near_duplicates(docs, shingle=5, id=key), "near-found").withColumnRenamed("doc_id", key)
    gone = stored(found.where("not kept").select(key).distinct(), "near-gone")
    left = join_checked(docs, gone, [key], how="left_anti")
    twice = stored(found.where("kept and n_shingles > 0").groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key), "near-twice")
    if not twice.isEmpty():
        once = join_checked(left, twice, [key], how="left_semi").dropDuplicates([key])
        left = join_checked(left, twice, [key], how="left_anti").unionByName(once)
    return left.drop(key)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    docs, columns = _aside(docs, {"benchmark_hits"})
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("benchmark_hits") == 0).select(columns)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, columns = _aside(docs, {"pii"})
    return pii.pseudonyms(docs, key=pii_key(spark)).select(columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return digest(packing.pack(docs))
