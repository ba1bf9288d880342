"""Words dealt to rows and what can be checked of it: shares, splits, seams, runs, timings; and identity of files."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import display_words, rate, score_tokens

# Fixed values of the rules; times in milliseconds.
SEAM_LEAST, SEAM_MOST, SHORTEST_WORD_MS, ERROR_CHARS = 2, 8, 50, 200


def log_value(kind: Column, type_name: Column, value: Column) -> Column:
    """A logged value in bounds: scalars and containers stay, an exception is its type and 200 characters, else the type's name."""
    error = F.to_json(F.struct(type_name.alias("error_type"), F.left(value, F.lit(ERROR_CHARS)).alias("error")))
    return F.when(kind.isin("scalar", "list", "dict"), value).when(kind == "exception", error).otherwise(type_name)


def share_confidence(confidences: Column, start: Column, end: Column, total: Column, digits: int = 2) -> Column:
    """The least confidence of the measured words that stand for the shown words [start, end) of `total`; null without any."""
    n = F.size(confidences)
    scale = n / total
    first = F.floor(start * scale).cast("int")
    last = F.least(F.greatest(first + 1, F.floor(end * scale).cast("int")), n)
    least = F.round(F.array_min(F.slice(confidences, first + 1, F.greatest(last - first, F.lit(0)))), digits)
    return F.when((n > 0) & (total > 0) & (end > start), least)


def split_mixed(rows: DataFrame, pattern: str) -> DataFrame:
    """Rows that hold a doctor's prompt (group 1) and a patient's answer (group 2) as two rows, others as they are.

    The parts of a split row are numbered in their ids and share its time by words.
    """
    part = lambda role, i: F.struct(F.lit(role).alias("role"), F.trim(F.regexp_extract("text", pattern, i)).alias("text"))
    mixed = F.col("text").rlike(pattern)
    parts = F.when(mixed, F.array(part("DOCTOR", 1), part("PATIENT", 2))).otherwise(F.array(F.struct("role", "text")))
    each = rows.select("session_id", "position", "segment_id", "start_ms", "end_ms", mixed.alias("mixed"), parts.alias("parts"))
    words = lambda i: F.greatest(F.size(display_words(F.col("parts")[i]["text"])), F.lit(1))
    cut = F.expr("start_ms + (end_ms - start_ms) * a div (a + b)")
    each = each.withColumn("a", words(0)).withColumn("b", F.when(F.col("mixed"), words(F.size("parts") - 1))).withColumn("cut", cut)
    each = each.select("*", F.posexplode("parts").alias("at", "part"))
    id = F.when(F.col("mixed"), F.format_string("%s-%02d", "segment_id", F.col("at") + 1)).otherwise(F.col("segment_id"))
    start = F.when(F.col("mixed") & (F.col("at") == 1), F.col("cut")).otherwise(F.col("start_ms"))
    end = F.when(F.col("mixed") & (F.col("at") == 0), F.col("cut")).otherwise(F.col("end_ms"))
    return each.select("session_id", "position", id.alias("segment_id"), F.col("part.role").alias("role"), F.col("part.text").alias("text"), start.alias("start_ms"), end.alias("end_ms"))


def seam_repeats(words: DataFrame) -> DataFrame:
    """(session_id, at, n): seams whose n words before (2 to 8, the most) are the n from it on.

    `words` are (session_id, at, word, seam) with at counted from 1.
    """
    w = Window.partitionBy("session_id").orderBy("at")
    before = F.collect_list("word").over(w.rowsBetween(-SEAM_MOST, -1))
    after = F.collect_list("word").over(w.rowsBetween(0, SEAM_MOST - 1))
    longest = F.expr(f"array_max(filter(sequence({SEAM_LEAST}, {SEAM_MOST}), n -> n <= size(before) AND n <= size(after) AND slice(before, size(before) - n + 1, n) = slice(after, 1, n)))")
    return words.withColumn("before", before).withColumn("after", after).where("seam").select("session_id", "at", longest.alias("n")).where("n IS NOT NULL")


def insertion_classes(words: DataFrame, insertions: Column) -> DataFrame:
    """(session_id, at, class) of inserted words, the first class that holds.

    `words` are (session_id, at, word, seam, source, source_index, ambiguous):
    retained live words, words of a source that stands twice, words on either
    side of a repeat at a seam, words whose order in overlap is open, others.
    """
    places = F.explode(F.sequence(F.col("at") - F.col("n"), F.col("at") + F.col("n") - 1))
    seams = seam_repeats(words).select("session_id", places.alias("at")).distinct().withColumn("repeated", F.lit(True))
    twice = words.where("source <> 'retained_live'").groupBy("session_id", "source_index").agg((F.count(F.lit(1)) > 1).alias("twice")).where("twice")
    each = words.where(insertions).join(seams, ["session_id", "at"], "left").join(twice, ["session_id", "source_index"], "left")
    kind = (
        F.when(F.col("source") == "retained_live", "retained_live_fallback")
        .when(F.col("twice"), "duplicate_allocation_source")
        .when(F.col("repeated"), "chunk_seam_duplicate")
        .when(F.col("ambiguous"), "ambiguous_unclassified")
        .otherwise("other_corrected_asr")
    )
    return each.select("session_id", "at", kind.alias("class"))


def _ratio(a: str | None, b: str | None) -> float:
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def garble_similarity(rows: DataFrame, terms: list[str]) -> DataFrame:
    """(session_id, term, similarity): how much a term's letters resemble those of the row most like it, from 0 to 1."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_ratio(x, y) for x, y in zip(a, b)], dtype=float)

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    joined = lambda c: F.array_join(score_tokens(c), "")
    said = rows.select("session_id", joined(F.col("text")).alias("said")).distinct()
    each = said.select("session_id", "said", F.explode(F.array(*map(F.lit, terms))).alias("term"))
    return each.groupBy("session_id", "term").agg(F.max(F.pandas_udf(run, "double")(joined(F.col("term")), F.col("said"))).alias("similarity"))


def display_mapping(rows: DataFrame) -> DataFrame:
    """(session_id, position, display_index, piece_index, token): the scored words of each shown word."""
    shown = rows.select("session_id", "position", F.posexplode(display_words(F.col("text"))).alias("display_index", "shown"))
    return shown.select("session_id", "position", "display_index", F.posexplode(score_tokens(F.col("shown"))).alias("piece_index", "token"))


def conflicting_sources(words: DataFrame) -> DataFrame:
    """(session_id, source_index, wordings) of sources that are shown in more than one wording."""
    said = words.select("session_id", "source_index", F.array_join(score_tokens(F.col("word")), " ").alias("said"))
    # words are dealt out before they are counted, so that a task holds the sources of its share of words and not of its share of rows
    return said.repartition("session_id", "source_index").groupBy("session_id", "source_index").agg(F.count_distinct("said").alias("wordings")).where("wordings > 1")


def run_gaps(runs: DataFrame) -> DataFrame:
    """(session_id, runs, gaps, empty_runs, covered): whether runs [start_index, end_index) follow each other without gaps from 0."""
    w = Window.partitionBy("session_id").orderBy("row_index")
    each = runs.withColumn("due", F.coalesce(F.lag("end_index").over(w), F.lit(0)))
    gap = F.count_if(~F.col("start_index").eqNullSafe(F.col("due")))
    return each.groupBy("session_id").agg(F.count(F.lit(1)).alias("runs"), gap.alias("gaps"), F.count_if(F.col("end_index") <= F.col("start_index")).alias("empty_runs"), F.sum(F.col("end_index") - F.col("start_index")).alias("covered"))


def appended_times(steps: DataFrame) -> DataFrame:
    """`steps` (words, token_ms, tokens_before, frame_ms, step_ms) as a row for each word with its start and end.

    New tokens are dealt to words by whole shares, at least one each; a word
    lasts 50 ms at least. Without new tokens the step's own frame is the span.
    """
    each = steps.select("*", F.size("token_ms").alias("total"), F.size("words").alias("n"), F.posexplode("words").alias("i", "word"))
    each = each.withColumn("fresh", F.greatest(F.col("total") - F.col("tokens_before"), F.lit(0)))
    each = each.withColumn("lo", F.expr("cast(tokens_before + i * fresh div n as int)"))
    each = each.withColumn("hi", F.least(F.greatest(F.expr("cast(tokens_before + (i + 1) * fresh div n as int)"), F.col("lo") + 1), F.col("total")))
    known = F.col("fresh") > 0
    start = F.when(known, F.try_element_at("token_ms", F.col("lo") + 1)).otherwise(F.col("step_ms"))
    end = F.when(known, F.try_element_at("token_ms", F.greatest(F.col("hi"), F.lit(1))) + F.col("frame_ms")).otherwise(F.col("step_ms") + F.col("frame_ms"))
    each = each.withColumn("word_start", start).withColumn("word_end", F.greatest(end, F.col("word_start") + SHORTEST_WORD_MS))
    return each.drop("words", "token_ms", "tokens_before", "frame_ms", "step_ms", "total", "n", "fresh", "lo", "hi")


def session_rates(rows: DataFrame, correct: Column, scored: Column, fragment: Column) -> DataFrame:
    """(session_id, accuracy_percent, fragment_percent, rows_per_minute), null where there is nothing to share."""
    n = F.count(F.lit(1))
    minutes = (F.max("end_ms") - F.min("start_ms")) / 60_000
    return rows.groupBy("session_id").agg(
        rate(F.count_if(scored & correct) * 100.0, F.count_if(scored)).alias("accuracy_percent"),
        rate(F.count_if(fragment) * 100.0, n).alias("fragment_percent"),
        rate(n, minutes).alias("rows_per_minute"),
    )


def file_identity(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(path, status): matched, changed, missing or extra, by the sha256 of a manifest and of the files that are there."""
    here = found.select("path", F.col("sha256").alias("found_sha"), F.lit(True).alias("here"))
    both = expected.select("path", "sha256", F.lit(True).alias("listed")).join(here, "path", "full")
    status = F.when(F.col("here").isNull(), "missing").when(F.col("listed").isNull(), "extra").when(F.col("sha256").eqNullSafe(F.col("found_sha")), "matched").otherwise("changed")
    return both.select("path", status.alias("status"))


def file_hashes(spark, path: str) -> DataFrame:
    """(path, sha256) of the files of a folder, each read whole by its task."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"))
