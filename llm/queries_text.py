"""Queries of the operators on whole texts: substring, near-duplicate and byte dedup."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import arrays as A
from llm import near_dedup, substring_dedup, suffix_dedup
from llm.storage import with_row_key


def _word_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in A.chunks(batches, "text"):
        found = [(t or "").encode().split() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row_key"), pa.array([len(w) for w in found], pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in found])],
            ["doc_id", "row_key", "n_words", "sha"],
        )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spans = substring_dedup.repeated_spans(docs)
    kind = "doc_id long, row_key long, n_words long, sha string"
    every = with_row_key(docs).mapInArrow(_word_digest, kind)
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    cut = substring_dedup.without_spans(docs, spans).dropDuplicates(["row_key", "doc_id"])
    cut = cut.select(F.col("doc_id").alias("cut_id"), F.col("row_key").alias("cut_key"), gone.alias("n_gone"), F.sha2(F.col("text").cast("binary"), 256).alias("cut_sha"))
    return every.join(cut, (F.col("row_key") == F.col("cut_key")) & (F.col("doc_id") == F.col("cut_id")), "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_gone", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("cut_sha", "sha").alias("kept_sha256"),
    )


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=2, num=80, den=100)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes covered by repeated 400-byte strings, removed; n_repeated_words tells of repeated 50-word strings.

    Passages of 50 words and a few more are often shorter than 400 bytes, so the
    last column comes from the same passes over words; nothing is removed by it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cut = suffix_dedup.without_spans(docs, suffix_dedup.repeated_spans(docs))
    cut = cut.select("id_key", "row_key", F.octet_length("kept").cast("long").alias("n_kept"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("cut_sha"), F.lit(None).cast("long").alias("n_covered"))
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    passages = suffix_dedup.repeated_spans(docs, depth=50, gram=4, unit="words").select("id_key", "row_key", F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("string"), covered)
    found = cut.dropDuplicates(["id_key", "row_key"]).union(passages).groupBy(F.col("id_key").alias("cut_id"), F.col("row_key").alias("cut_key"))
    found = found.agg(*(F.max(c).alias(c) for c in ("n_kept", "n_spans", "cut_sha", "n_covered")))
    text = F.coalesce("text", F.lit(""))
    every = suffix_dedup.keyed(docs).select("doc_id", "id_key", "row_key", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("sha"))
    none = F.lit(0).cast("long")
    return every.join(found, (F.col("row_key") == F.col("cut_key")) & (F.col("id_key") == F.col("cut_id")), "left").select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.coalesce("n_kept", "n_bytes")).alias("n_removed"),
        F.coalesce("n_spans", none).alias("n_spans"),
        F.coalesce("cut_sha", "sha").alias("kept_sha256"),
        F.coalesce("n_covered", none).alias("n_repeated_words"),
    )


QUERIES = {"op4_substring_dedup": op4_substring_dedup, "op5_minhash_near_dedup": op5_minhash_near_dedup, "op7_suffix_dedup": op7_suffix_dedup}
SQL: dict[str, str] = {}
