"""Log analytics: per-session aggregates, percentiles, outcome mixes and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import rate


def nearest_rank(events: DataFrame, by: list[str], value: str, percent: int) -> DataFrame:
    """The value at index round(percent / 100 * (n - 1)), half to even, of each group's sorted values.

    Equal values are counted before the shuffle, so a hot group sorts its
    distinct values only. Nulls take no part; a group of nulls gives no row.
    """
    counts = events.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*by)
    ranked = counts.withColumn("_upto", F.sum("_n").over(group.orderBy(value))).withColumn("_all", F.sum("_n").over(group))
    index = F.bround(F.lit(percent) * (F.col("_all") - 1) / 100)
    return ranked.where((F.col("_upto") > index) & (F.col("_upto") - F.col("_n") <= index)).select(*by, value)


def latency_record(events: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, interpolated p50 and p95, and max of each group; nulls take no part."""
    return events.groupBy(*by).agg(
        F.count(value).alias("count"),
        F.round(F.percentile(value, F.lit(0.5)), 6).alias("p50"),
        F.round(F.percentile(value, F.lit(0.95)), 6).alias("p95"),
        F.max(value).alias("max"),
    )


def routed_metrics(events: DataFrame, by: list[str], routes: dict[str, Column]) -> DataFrame:
    """(by, metric, n, total): each route's non-null values, counted and summed."""
    routed = F.array(*(F.struct(F.lit(k).alias("metric"), v.alias("v")) for k, v in routes.items()))
    each = events.select(*by, F.explode(routed).alias("r")).where("r.v is not null")
    return each.groupBy(*by, F.col("r.metric").alias("metric")).agg(F.count(F.lit(1)).alias("n"), F.sum("r.v").alias("total"))


def path_rates(events: DataFrame, by: list[str], fallback: Column, flipped: Column, confidence: Column) -> DataFrame:
    """Events, fallback and flip rates, and mean confidence where it is measured."""
    return events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("events"),
        rate(F.count_if(fallback), F.count(F.lit(1))).alias("fallback_rate"),
        rate(F.count_if(flipped), F.count(F.lit(1))).alias("flip_rate"),
        F.round(F.avg(confidence), 6).alias("confidence"),
    )


def outcomes(events: DataFrame, name: Column, prefix: str, failed: Column) -> DataFrame:
    """Events whose name begins with the prefix, by the rest of the name, with their failures."""
    rest = F.substring(name, F.lit(len(prefix) + 1), F.length(name))
    return events.where(name.startswith(prefix)).groupBy(rest.alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("failures"))


def session_lines(events: DataFrame, kind: str, amount: str) -> DataFrame:
    """Each session's events, total and a sorted list of its counts by kind.

    Counts by kind are made first, so what is listed is bounded by the number of
    kinds and not by the session's events.
    """
    counts = events.groupBy("session_id", kind).agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("total"))
    label = F.concat_ws("=", F.col(kind), F.col("n"))
    return counts.groupBy("session_id").agg(F.sum("n").alias("events"), F.sum("total").alias("total"), F.array_join(F.array_sort(F.collect_list(label)), ",").alias("mix"))


def report_totals(events: DataFrame, a: str, b: str, amount: str) -> DataFrame:
    """Totals by (a, b), by a alone, and of everything; `level` counts the keys that are summed over."""
    return events.rollup(a, b).agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("total"), F.bit_count(F.grouping_id()).alias("level"))


def timeline_summary(events: DataFrame, decision: Column, mapping: Column, order: list[str]) -> DataFrame:
    """Each session's decisions by kind, and its last mapping that is not empty."""
    told = F.when(F.length(mapping) > 0, mapping)
    last = F.max_by(told, F.when(told.isNotNull(), F.struct(*order)))
    return events.groupBy("session_id").agg(
        F.count_if(decision == "applied").alias("applied"),
        F.count_if(decision == "kept").alias("kept"),
        F.count_if(decision == "failed").alias("failed"),
        last.alias("last_mapping"),
    )


def reconciled(counted: DataFrame, recorded: DataFrame, key: str, n: str) -> DataFrame:
    """Counts from a log against those of a record: both sides, and whether they agree."""
    other = recorded.withColumnRenamed(n, "recorded")
    both = counted.withColumnRenamed(n, "counted").join(other, key, "full")
    return both.select(key, "counted", "recorded", F.coalesce(F.col("counted") == F.col("recorded"), F.lit(False)).alias("agrees"))


def level_of(status: Column) -> Column:
    """error from 500, warning from 400, else info; null without a status."""
    return F.when(status >= 500, "error").when(status >= 400, "warning").when(status.isNotNull(), "info")
