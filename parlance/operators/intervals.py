"""Joins and aggregates over half-open millisecond intervals inside a key.

Joins are hash joins on (key, time bucket): both sides are laid out over fixed
buckets and a pair is kept only in the bucket where its later start lies, so a
session of any length is spread over tasks and no pair appears twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH_MS = 60_000


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Common length; 0 for disjoint and for touching intervals."""
    return F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0))


def _laid_out(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    last = F.greatest(F.col(end), F.col(start))
    return df.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(last / width))))


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], l_start: str, l_end: str, r_start: str, r_end: str, *, width: int = WIDTH_MS) -> DataFrame:
    """Pairs of one key whose intervals have a positive overlap, with overlap_ms."""
    a, b = _laid_out(left, l_start, l_end, width), _laid_out(right, r_start, r_end, width)
    pair = a.join(b, [*on, "_bucket"]).where((F.col(l_start) < F.col(r_end)) & (F.col(r_start) < F.col(l_end)))
    pair = pair.where(F.col("_bucket") == F.floor(F.greatest(F.col(l_start), F.col(r_start)) / width)).drop("_bucket")
    return pair.withColumn("overlap_ms", overlap(F.col(l_start), F.col(l_end), F.col(r_start), F.col(r_end)))


def near_join(left: DataFrame, right: DataFrame, on: list[str], at: str, r_start: str, r_end: str, reach: int, *, width: int = WIDTH_MS) -> DataFrame:
    """Pairs of a point and the intervals (closed) within `reach` of it, with gap_ms (0 inside)."""
    a = left.withColumn("_bucket", F.floor(F.col(at) / width))
    last = F.greatest(F.col(r_end), F.col(r_start)) + reach
    b = right.withColumn("_bucket", F.explode(F.sequence(F.floor((F.col(r_start) - reach) / width), F.floor(last / width))))
    gap = F.greatest(F.col(r_start) - F.col(at), F.col(at) - F.col(r_end), F.lit(0))
    return a.join(b, [*on, "_bucket"]).drop("_bucket").withColumn("gap_ms", gap).where(F.col("gap_ms") <= reach)


def merge_spans(spans: DataFrame, on: list[str], start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Overlapping and touching spans of a key as one: key, start_ms, end_ms, n_spans."""
    w = Window.partitionBy(*on).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    marked = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*on, "_island").agg(F.min(start).alias("start_ms"), F.max(end).alias("end_ms"), F.count(F.lit(1)).alias("n_spans")).drop("_island")


def role_overlaps(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """Overlap of each row with each reference role: (session_id, segment_id, ref_role, overlap_ms)."""
    pairs = overlap_join(rows, refs, ["session_id"], "start_ms", "end_ms", "ref_start", "ref_end")
    return pairs.groupBy("session_id", "segment_id", "ref_role").agg(F.sum("overlap_ms").alias("overlap_ms"))


def expected_roles(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """`rows` with expected_role: the reference role with the most overlap, null without overlap and for ties."""
    by_role = role_overlaps(rows, refs)
    best = by_role.groupBy("session_id", "segment_id").agg(F.max("overlap_ms").alias("best"), F.max_by("ref_role", "overlap_ms").alias("top"), F.collect_list("overlap_ms").alias("all"))
    alone = F.size(F.filter("all", lambda x: x == F.col("best"))) == 1
    best = best.select("session_id", "segment_id", F.when(alone & (F.col("best") > 0), F.col("top")).alias("expected_role"))
    return rows.join(best, ["session_id", "segment_id"], "left")


def cross_talk(refs: DataFrame) -> DataFrame:
    """Merged spans in which both reference roles speak: session_id, start_ms, end_ms, n_spans."""
    doctor = refs.where("ref_role = 'DOCTOR'").select("session_id", "ref_start", "ref_end")
    patient = refs.where("ref_role = 'PATIENT'").select("session_id", F.col("ref_start").alias("p_start"), F.col("ref_end").alias("p_end"))
    both = overlap_join(doctor, patient, ["session_id"], "ref_start", "ref_end", "p_start", "p_end")
    return merge_spans(both.select("session_id", F.greatest("ref_start", "p_start").alias("start_ms"), F.least("ref_end", "p_end").alias("end_ms")), ["session_id"])


def touching(rows: DataFrame, spans: DataFrame, *, keep: bool = True) -> DataFrame:
    """Rows that overlap any span of their session (keep) or none."""
    spans = spans.select("session_id", F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"))
    hit = overlap_join(rows.select("session_id", "segment_id", "start_ms", "end_ms"), spans, ["session_id"], "start_ms", "end_ms", "_s", "_e")
    return rows.join(hit.select("session_id", "segment_id").distinct(), ["session_id", "segment_id"], "left_semi" if keep else "left_anti")


def word_points(rows: DataFrame, words: Column) -> DataFrame:
    """Each word at the centre of its even share of the row: session_id, segment_id, role, word_index, word, at_ms."""
    rows = rows.withColumn("words", words).withColumn("_n", F.size("words")).select("*", F.posexplode("words").alias("word_index", "word"))
    at = F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) * (2 * F.col("word_index") + 1) / (2 * F.col("_n")))
    return rows.select("session_id", "segment_id", "role", "speaker_id", "word_index", "word", at.alias("at_ms"))


def unique_active_role(points: DataFrame, refs: DataFrame) -> DataFrame:
    """`points` with active_role: the one reference role active at at_ms (start inclusive, end exclusive), else null."""
    pairs = near_join(points.select("session_id", "segment_id", "word_index", "at_ms"), refs, ["session_id"], "at_ms", "ref_start", "ref_end", 0).where(F.col("at_ms") < F.col("ref_end"))
    one = pairs.groupBy("session_id", "segment_id", "word_index").agg(F.count_distinct("ref_role").alias("n"), F.min("ref_role").alias("role_"))
    one = one.select("session_id", "segment_id", "word_index", F.when(F.col("n") == 1, F.col("role_")).alias("active_role"))
    return points.join(one, ["session_id", "segment_id", "word_index"], "left")


def containing_turn(points: DataFrame, turns: DataFrame) -> DataFrame:
    """Each word's shortest turn that contains it (closed bounds), ties to the lower turn index; null without one."""
    pairs = near_join(points.select("session_id", "segment_id", "word_index", "at_ms"), turns, ["session_id"], "at_ms", "ref_start", "ref_end", 0)
    best = pairs.groupBy("session_id", "segment_id", "word_index").agg(F.min_by("ordinal", F.struct(F.col("ref_end") - F.col("ref_start"), "ordinal")).alias("turn_index"))
    return points.join(best, ["session_id", "segment_id", "word_index"], "left")


def nearest_turn(points: DataFrame, turns: DataFrame, reach: int) -> DataFrame:
    """Each word's containing turn, or the nearest within `reach`; ties to the lower turn index."""
    pairs = near_join(points.select("session_id", "segment_id", "word_index", "at_ms"), turns, ["session_id"], "at_ms", "ref_start", "ref_end", reach)
    best = pairs.groupBy("session_id", "segment_id", "word_index").agg(F.min_by(F.struct("ordinal", "gap_ms"), F.struct("gap_ms", "ordinal")).alias("near"))
    return points.join(best.select("session_id", "segment_id", "word_index", F.col("near.ordinal").alias("turn_index"), F.col("near.gap_ms").alias("gap_ms")), ["session_id", "segment_id", "word_index"], "left")


def uncovered(rows: DataFrame, refs: DataFrame, *, share: float = 0.25, short_ms: int = 200) -> DataFrame:
    """Rows whose best single overlap is at most `share` of their duration (0 for rows under `short_ms`)."""
    pairs = overlap_join(rows.select("session_id", "segment_id", "start_ms", "end_ms"), refs, ["session_id"], "start_ms", "end_ms", "ref_start", "ref_end")
    best = pairs.groupBy("session_id", "segment_id").agg(F.max("overlap_ms").alias("best_ms"))
    length = F.col("end_ms") - F.col("start_ms")
    least = F.when(length < short_ms, 0).otherwise(length * share)
    return rows.join(best, ["session_id", "segment_id"], "left").withColumn("best_ms", F.coalesce("best_ms", F.lit(0))).where(F.col("best_ms") <= least)


def echo_pairs(rows: DataFrame, norm: Column) -> DataFrame:
    """Pairs of rows with equal text, other speakers and overlapping times: session_id, first_id, second_id, overlap_ms."""
    rows = rows.select("session_id", "segment_id", "position", "speaker_id", "start_ms", "end_ms", norm.alias("norm")).where("norm <> ''")
    later = rows.select("session_id", "norm", F.col("segment_id").alias("id2"), F.col("position").alias("p2"), F.col("speaker_id").alias("s2"), F.col("start_ms").alias("b2"), F.col("end_ms").alias("e2"))
    pair = overlap_join(rows, later, ["session_id", "norm"], "start_ms", "end_ms", "b2", "e2").where("position < p2 AND speaker_id <> s2")
    return pair.select("session_id", F.col("segment_id").alias("first_id"), F.col("id2").alias("second_id"), "overlap_ms")


def band_pairs(rows: DataFrame, band_ms: int) -> DataFrame:
    """Pairs of a session whose starts are at most `band_ms` apart, by start then position: first_id, second_id, gap_ms."""
    left = rows.select("session_id", "segment_id", "position", "start_ms", F.floor(F.col("start_ms") / band_ms).alias("_b"))
    right = rows.select("session_id", F.col("segment_id").alias("id2"), F.col("position").alias("p2"), F.col("start_ms").alias("b2"), F.explode(F.array(F.floor(F.col("start_ms") / band_ms), F.floor(F.col("start_ms") / band_ms) - 1)).alias("_b"))
    pair = left.join(right, ["session_id", "_b"]).where((F.col("b2") - F.col("start_ms")).between(0, band_ms) & (F.struct("start_ms", "position") < F.struct("b2", "p2")))
    return pair.select("session_id", F.col("segment_id").alias("first_id"), F.col("id2").alias("second_id"), (F.col("b2") - F.col("start_ms")).alias("gap_ms"))


def stitch_rows(rows: DataFrame, gap_ms: int = 2000) -> DataFrame:
    """Adjacent rows of one role at most `gap_ms` apart as one: session_id, first_position, role, start_ms, end_ms, n_rows, text."""
    w = Window.partitionBy("session_id").orderBy("position")
    joined = (F.lag("role").over(w) == F.col("role")) & (F.col("start_ms") - F.lag("end_ms").over(w) <= gap_ms)
    marked = rows.withColumn("_new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"])
    return marked.groupBy("session_id", "_run").agg(F.min("position").alias("first_position"), F.first("role").alias("role"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("n_rows"), F.array_join(parts, " ").alias("text")).drop("_run")
