"""Projections, merges and relabelling of stored transcript rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cleaned(rows: DataFrame) -> DataFrame:
    """Rows with text, ends not before starts, and a role, in time order by position."""
    w = Window.partitionBy("session_id").orderBy("start_ms", "end_ms", "segment_id")
    rows = rows.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("end_ms", F.greatest("start_ms", "end_ms")).withColumn("role", F.coalesce("role", F.lit("UNKNOWN")))
    return rows.withColumn("position", (F.row_number().over(w) - 1).cast("long"))


def upsert_sessions(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Sessions after a visit: created_at stays, last_accessed_at moves to the newest visit."""
    last = seen.groupBy("session_id").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    both = stored.join(last, "session_id", "full")
    return both.select("session_id", F.coalesce("created_at", "first_at").alias("created_at"), F.greatest("last_accessed_at", "last_at").alias("last_accessed_at"))


def merge_roles(stored: DataFrame, shown: DataFrame) -> DataFrame:
    """Stored rows with the shown role where no role_source has claimed the row, and whether a partner was found."""
    new = shown.select("segment_id", F.col("role").alias("_role"), F.lit(True).alias("_hit"))
    free = F.col("role_source").isNull() & F.col("_role").isNotNull()
    out = stored.join(new, "segment_id", "left")
    return out.withColumn("role", F.when(free, F.col("_role")).otherwise(F.col("role"))).withColumn("matched", F.coalesce("_hit", F.lit(False))).drop("_role", "_hit")


def apply_speaker_map(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Roles by speaker map; a mapped row loses its role_source."""
    named = mapping.select("session_id", "speaker_id", F.col("role").alias("_role"))
    out = rows.join(named, ["session_id", "speaker_id"], "left")
    return out.withColumn("role_source", F.when(F.col("_role").isNull(), F.col("role_source"))).withColumn("role", F.coalesce("_role", "role")).drop("_role")


def apply_exceptions(rows: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Row-level roles over mapped ones, marked with role_source auto_row."""
    named = exceptions.select("segment_id", F.col("role").alias("_role"))
    out = rows.join(named, "segment_id", "left")
    return out.withColumn("role_source", F.when(F.col("_role").isNotNull(), "auto_row").otherwise(F.col("role_source"))).withColumn("role", F.coalesce("_role", "role")).drop("_role")


def confirmed_over_inferred(inferred: Column, confirmed: Column) -> Column:
    """Maps combined, confirmed entries winning."""
    keys = F.map_filter(inferred, lambda k, _: ~F.map_contains_key(confirmed, k))
    return F.map_concat(keys, confirmed)


def withdraw_omitted(previous: Column, new: Column) -> Column:
    """The new map with speakers that it omits set to UNKNOWN."""
    return F.map_zip_with(previous, new, lambda _, old, now: F.coalesce(now, F.lit("UNKNOWN")))


def attributed_text(rows: DataFrame) -> DataFrame:
    """One text by session: `[role] text` lines in row order."""
    line = F.concat(F.lit("["), F.col("role"), F.lit("] "), F.col("text"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))), lambda x: x["line"])
    return rows.groupBy("session_id").agg(F.array_join(lines, "\n").alias("transcript"))


def within_budget(rows: DataFrame, budget: int, mark: int = 0) -> DataFrame:
    """Whole rows under a character budget: those of the opening quarter, then the longest run of last rows that fits."""
    w = Window.partitionBy("session_id").orderBy("position")
    length = F.length("text") + 1
    rows = rows.withColumn("_fore", F.sum(length).over(w)).withColumn("_back", F.sum(length).over(Window.partitionBy("session_id").orderBy(F.desc("position")))).withColumn("_all", F.sum(length).over(Window.partitionBy("session_id")))
    opening = F.col("_fore") <= budget // 4
    head = F.coalesce(F.sum(F.when(opening, length)).over(Window.partitionBy("session_id")), F.lit(0))
    keep = (F.col("_all") <= budget) | opening | (F.col("_back") + head + mark <= budget)
    return rows.withColumn("_keep", keep).where("_keep").drop("_fore", "_back", "_all", "_keep")


def channel_union(*channels: tuple[str, DataFrame]) -> DataFrame:
    """Histories of several channels as one, speaker ids prefixed by channel, in time order."""
    out = None
    for role, rows in channels:
        named = rows.withColumn("speaker_id", F.concat(F.lit(role.lower() + "_"), F.col("speaker_id"))).withColumn("role", F.lit(role))
        out = named if out is None else out.unionByName(named)
    w = Window.partitionBy("session_id").orderBy("start_ms", "end_ms", "role", "segment_id")
    return out.withColumn("position", (F.row_number().over(w) - 1).cast("long"))


def chunked_words(texts: DataFrame, id: str, words: Column, size: int = 18) -> DataFrame:
    """Rows of `size` words with made-up spans of a second each: id, chunk, text, start_ms, end_ms."""
    starts = lambda ws: F.when(F.size(ws) > 0, F.sequence(F.lit(1), F.size(ws), F.lit(size)))
    # the words are a variable of a lambda, so that they are split once; a text's chunks need no other text, so nothing is shuffled
    said = F.transform(F.array(words), lambda ws: F.transform(starts(ws), lambda i: F.array_join(F.slice(ws, i, size), " ")))[0]
    each = texts.select(id, F.posexplode(said).alias("chunk", "text")).withColumn("chunk", F.col("chunk").cast("long"))
    return each.select(id, "chunk", "text", (F.col("chunk") * 1000).alias("start_ms"), ((F.col("chunk") + 1) * 1000).alias("end_ms"))


def word_shares(spans: DataFrame, words: DataFrame) -> DataFrame:
    """A session's words over its spans by share of duration, at least one each while words last, the rest to the last span.

    spans: session_id, span, duration_ms; words: session_id, n_words. Returns
    session_id, span, from_word, to_word.
    """
    w = Window.partitionBy("session_id").orderBy("span")
    total, last = F.sum("duration_ms").over(Window.partitionBy("session_id")), F.max("span").over(Window.partitionBy("session_id"))
    out = spans.join(words, "session_id")
    share = F.greatest(F.lit(1), F.bround(F.col("n_words") * F.col("duration_ms") / F.when(total > 0, total)).cast("long"))
    out = out.withColumn("_share", F.coalesce(share, F.lit(1))).withColumn("_to", F.least(F.sum("_share").over(w), F.col("n_words"))).withColumn("_to", F.when(F.col("span") == last, F.col("n_words")).otherwise(F.col("_to")))
    return out.select("session_id", "span", F.coalesce(F.lag("_to").over(w), F.lit(0)).alias("from_word"), F.col("_to").alias("to_word"))


#: Confidence below which a row is flagged, by lane.
FLAG_BELOW = {"live": 0.76, "corrected": 0.78}


def low_confidence(lane: Column, confidence: Column) -> Column:
    """True below the lane's threshold; null confidence and unknown lanes are never flagged."""
    out = F.lit(False)
    for name, least in FLAG_BELOW.items():
        out = F.when(lane == name, confidence < least).otherwise(out)
    return F.coalesce(out, F.lit(False))
