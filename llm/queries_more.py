"""Queries of sharding, neighbour search, license scans, PII, quality, language ID and decontamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import ann, decontaminate, langid, licenses, pii, quality, sharding
from llm.storage import new_path

#: The key of the pseudonyms; `spark.corpus.pii.key` (hexadecimal) replaces it outside tests.
DEFAULT_KEY = "0123456789abcdef" * 4
ARRIVAL_DOCS = 256


def pii_key(spark: SparkSession) -> bytes:
    return bytes.fromhex(spark.conf.get("spark.corpus.pii.key", DEFAULT_KEY))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_size_tiered_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's shard after the arrivals (256 documents each) are appended and compacted."""
    root = new_path(spark, "shards")
    sharding.append(_table(spark, sf_dir, "documents"), root, arrival=F.floor(F.col("doc_id") / ARRIVAL_DOCS))
    at = sharding.compact(spark, root)
    shards = sharding.manifest(spark, root, at).select("shard", F.col("docs").alias("shard_docs"), F.col("bytes").alias("shard_bytes"))
    return sharding.read(spark, root, at).select(F.col("_shard").alias("shard"), "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")).join(shards.hint("merge"), "shard").select("doc_id", "n_bytes", "shard", "shard_docs", "shard_bytes")


def _tier(i: int, low: int, high: int) -> str:
    return f"""
m{i} AS (SELECT *, sum(size) OVER (PARTITION BY lane ORDER BY run) AS upto FROM
  (SELECT lane, run, any_value(size) AS size FROM s{i} GROUP BY lane, run) WHERE size >= {low} AND size < {high}),
b{i} AS (SELECT *, CAST(floor((upto - size) / {high}) AS BIGINT) AS bin FROM m{i}),
f{i} AS (SELECT lane, run, sum(size) OVER w AS total, min(run) OVER w AS into_, max(upto) OVER w >= (bin + 1) * {high} AS filled
  FROM b{i} WINDOW w AS (PARTITION BY lane, bin)),
s{i + 1} AS (SELECT s.first, s.docs, s.bytes, s.lane, coalesce(f.into_, s.run) AS run, coalesce(f.total, s.size) AS size
  FROM s{i} s LEFT JOIN (SELECT * FROM f{i} WHERE filled) f ON s.lane = f.lane AND s.run = f.run),"""


def _sharding_sql() -> str:
    tiers = "".join(_tier(i, 0 if i == 0 else sharding.BASE * sharding.FANOUT**i, sharding.BASE * sharding.FANOUT ** (i + 1)) for i in range(sharding.TIERS))
    last = f"s{sharding.TIERS}"
    return f"""WITH a AS (SELECT *, row_number() OVER (ORDER BY first) AS seq FROM (
  SELECT coalesce(CAST(floor(doc_id / {ARRIVAL_DOCS}) AS BIGINT), -1) AS first, count(*) AS docs, CAST(sum(coalesce(strlen(text), 0)) AS BIGINT) AS bytes FROM documents GROUP BY 1)),
s0 AS (SELECT first, docs, bytes, seq // {sharding.LANE} AS lane, seq AS run, bytes AS size FROM a),{tiers}
r AS (SELECT run, count(*) AS parts, min(first) AS only_, sum(docs) AS docs, sum(bytes) AS bytes FROM {last} GROUP BY run)
SELECT d.doc_id, CAST(coalesce(strlen(d.text), 0) AS BIGINT) AS n_bytes,
  CASE WHEN r.parts = 1 THEN 'v1-a' || lpad(CAST(r.only_ AS VARCHAR), 12, '0') ELSE 'v2-m' || lpad(CAST(r.run AS VARCHAR), 12, '0') END AS shard,
  CAST(r.docs AS BIGINT) AS shard_docs, CAST(r.bytes AS BIGINT) AS shard_bytes
FROM documents d JOIN {last} s ON s.first = coalesce(CAST(floor(d.doc_id / {ARRIVAL_DOCS}) AS BIGINT), -1) JOIN r ON r.run = s.run"""


def op2_permutation_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(_table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 100 == 0, top=10)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files of a tree: source / thousands / hundreds / doc_id."""
    docs, part = _table(spark, sf_dir, "documents"), lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    path = F.concat_ws("/", *(part(c) for c in (F.col("source"), F.floor(F.col("doc_id") / 1000), F.floor(F.col("doc_id") / 100), F.col("doc_id"))))
    found = licenses.licenses(docs.select(path.alias("path"), "text", "doc_id"), keep=["doc_id"])
    return found.select("kept.doc_id", "path", "license", F.round("score", 6).alias("score"), "how", "source_dir")


def op6_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonyms(_table(spark, sf_dir, "documents").select("doc_id", "text"), key=pii_key(spark))
    return found.select("doc_id", F.size("pii").alias("n_pii"), F.transform("pii", lambda x: x["kind"]).alias("kinds"), "text")


def op8_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    hits = F.col("benchmark_hits")
    return found.select("doc_id", (F.size(hits) > 0).alias("contaminated"), F.transform(hits, lambda x: x["item_id"]).alias("item_ids"), F.array_min(F.transform(hits, lambda x: x["edits"])).alias("least_edits"))


def op11_bigru_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_size_tiered_sharding, op2_permutation_ann, op3_license_scan, op6_pii_feistel, op8_quality_ftrl, op9_benchmark_decontamination, op11_bigru_language_id)}
SQL = {"op1_size_tiered_sharding": _sharding_sql()}
