"""Domain rows from the driver's tables. Times are whole milliseconds, so sums and hashes are exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHIFT_MS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as transcript rows: session_id, position, segment_id, role, speaker_id, text, start_ms, end_ms.

    A row starts 40 ms for each character that came before it; even turns last
    60 ms a character and so overlap the next, odd ones 20 ms and leave a gap.
    """
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "conversations").withColumn("text", text)
    start = F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)) * 40
    return rows.select(
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("position"),
        F.concat_ws("-", "conv_id", "turn").alias("segment_id"),
        F.when(F.col("role") == "user", "PATIENT").when(F.col("role") == "assistant", "DOCTOR").otherwise("UNKNOWN").alias("role"),
        F.concat(F.lit("spk_"), F.col("turn") % 3).alias("speaker_id"),
        "text",
        start.alias("start_ms"),
        (start + F.length("text") * F.when(F.col("turn") % 2 == 0, 60).otherwise(20)).alias("end_ms"),
    )


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference intervals (session_id, ordinal, ref_role, ref_start, ref_end, ref_text): the spoken roles, half a second late."""
    rows = transcript(spark, sf_dir).where(F.col("role").isin("DOCTOR", "PATIENT"))
    return rows.select("session_id", F.col("position").alias("ordinal"), F.col("role").alias("ref_role"), (F.col("start_ms") + SHIFT_MS).alias("ref_start"), (F.col("end_ms") + SHIFT_MS).alias("ref_end"), F.col("text").alias("ref_text"))


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as log rows: session_id, event, ts, value, k."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("event"), "ts", "value", F.get_json_object("props", "$.k").cast("long").alias("k"), "event_id")


#: The same rows for DuckDB, as common table expressions.
ROWS_SQL = """rows_ AS (SELECT conv_id AS session_id, turn AS position, conv_id || '-' || turn AS segment_id,
  CASE role WHEN 'user' THEN 'PATIENT' WHEN 'assistant' THEN 'DOCTOR' ELSE 'UNKNOWN' END AS role,
  'spk_' || (turn % 3) AS speaker_id, coalesce(text, '') AS text,
  CAST(40 * coalesce(sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms
  FROM conversations),
rows AS (SELECT *, start_ms + length(text) * CASE WHEN position % 2 = 0 THEN 60 ELSE 20 END AS end_ms FROM rows_),
refs AS (SELECT session_id, position AS ordinal, role AS ref_role, start_ms + 500 AS ref_start, end_ms + 500 AS ref_end, text AS ref_text
  FROM rows WHERE role IN ('DOCTOR', 'PATIENT'))"""
LOGS_SQL = "logs AS (SELECT user_id AS session_id, event_type AS event, ts, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id FROM events)"


def timed_words(rows: DataFrame, *more: str) -> DataFrame:
    """Scored words of transcript rows, each with its even share of the row's time: i, n, word, w_start, w_end, and more columns of the row."""
    ws = F.regexp_extract_all(F.lower("text"), F.lit("[a-z']+"), F.lit(0))
    # the size stands below the explode, so that it is found once for each row and not for each word
    each = rows.withColumn("ws", ws).withColumn("n", F.size("ws")).select("*", F.posexplode("ws").alias("i", "word"))
    at = lambda k: F.expr(f"start_ms + (end_ms - start_ms) * {k} div n")
    return each.select("session_id", "position", "segment_id", "speaker_id", "role", "i", "n", "word", at("i").alias("w_start"), at("(i + 1)").alias("w_end"), *more)


def numbered_words(rows: DataFrame) -> DataFrame:
    """timed_words with their number in the session from 1 (at), by the words of the rows before: rows are sorted, not words."""
    before = Window.partitionBy("session_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    n = F.size(F.regexp_extract_all(F.lower("text"), F.lit("[a-z']+"), F.lit(0)))
    rows = rows.withColumn("n_", n).withColumn("before_", F.coalesce(F.sum("n_").over(before), F.lit(0)))
    words = timed_words(rows, "before_")
    return words.withColumn("at", (F.col("before_") + F.col("i") + 1).cast("int")).drop("before_")


#: Follows ROWS_SQL.
WORDS_SQL = """wl AS (SELECT *, regexp_extract_all(lower(text), '[a-z'']+') AS ws FROM rows),
words AS (SELECT session_id, position, segment_id, speaker_id, role, CAST(j - 1 AS INT) AS i, CAST(len(ws) AS INT) AS n, ws[j] AS word,
  start_ms + (end_ms - start_ms) * (j - 1) // len(ws) AS w_start, start_ms + (end_ms - start_ms) * j // len(ws) AS w_end FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS j FROM wl))"""
