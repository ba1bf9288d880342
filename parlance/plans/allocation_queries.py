"""Queries of words dealt to rows, their checks, and identity of files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parlance.functions.text import score_tokens
from parlance.operators import allocation, attribution, intervals, sequences
from parlance.plans.registry import query
from parlance.sources.adapt import ROWS_SQL, WORDS_SQL, numbered_words, reference, table, timed_words, transcript

_R = f"WITH {ROWS_SQL}"
_T = "regexp_extract_all(lower({0}), '[a-z'']+')"


@query("oc14_log_values", f"{_R} SELECT segment_id, CASE position % 4 WHEN 0 THEN text WHEN 1 THEN text WHEN 2 THEN CAST(to_json({{'error_type': 'ValueError', 'error': left(text, 200)}}) AS VARCHAR) ELSE 'Socket' END AS value FROM rows")
def log_values(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ["scalar", "list", "exception", "object"])), (F.col("position") % 4 + 1).cast("int"))
    name = F.when(kind == "exception", "ValueError").otherwise("Socket")
    return transcript(spark, sf).select("segment_id", allocation.log_value(kind, name, F.col("text")).alias("value"))


@query("oc19_share_confidence", f"{_R}, c AS (SELECT segment_id, position, [length(w) * 7 % 100 for w in {_T.format('text')}] AS c FROM rows), s AS (SELECT *, len(c) AS n, position % 3 AS a, position % 3 + 2 AS z, CAST(floor((position % 3) * (len(c) / (len(c) + 1))) AS INT) AS f FROM c) SELECT segment_id, CASE WHEN n > 0 THEN list_min(c[f + 1:least(greatest(f + 1, CAST(floor(z * (n / (n + 1))) AS INT)), n)]) END AS confidence FROM s")
def shares(spark, sf):
    rows = transcript(spark, sf).withColumn("c", F.transform(score_tokens(F.col("text")), lambda w: F.length(w) * 7 % 100))
    at = (F.col("position") % 3).cast("int")
    return rows.select("segment_id", allocation.share_confidence(F.col("c"), at, at + 2, F.size("c") + 1).alias("confidence"))


_MIXED = r"(?s)^(.*?[.?!]) (.+)$"


@query("of24_split_rows", f"{_R}, p AS (SELECT *, regexp_matches(text, '{_MIXED}') AS mixed, trim(regexp_extract(text, '{_MIXED}', 1)) AS d, trim(regexp_extract(text, '{_MIXED}', 2)) AS p FROM rows), c AS (SELECT *, start_ms + (end_ms - start_ms) * greatest(len(regexp_extract_all(d, '\\S+')), 1) // (greatest(len(regexp_extract_all(d, '\\S+')), 1) + greatest(len(regexp_extract_all(p, '\\S+')), 1)) AS cut FROM p) SELECT session_id, position, segment_id, role, text, start_ms, end_ms FROM c WHERE NOT mixed UNION ALL SELECT session_id, position, segment_id || '-01', 'DOCTOR', d, start_ms, cut FROM c WHERE mixed UNION ALL SELECT session_id, position, segment_id || '-02', 'PATIENT', p, cut, end_ms FROM c WHERE mixed")
def split_rows(spark, sf):
    return allocation.split_mixed(transcript(spark, sf), _MIXED)


_AT = f"{WORDS_SQL}, w AS (SELECT session_id, position, i, left(word, 1) AS word, row_number() OVER (PARTITION BY session_id ORDER BY position, i) AS at_, i = 0 AND position > 0 AS seam, CASE WHEN position % 5 = 4 THEN 'retained_live' ELSE 'corrected_asr' END AS source, role = 'UNKNOWN' AS ambiguous FROM words), x AS (SELECT *, CASE WHEN at_ % 11 = 10 THEN at_ - 1 ELSE at_ END AS source_index FROM w), b AS (SELECT *, list(word) OVER (PARTITION BY session_id ORDER BY at_ ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS before, list(word) OVER (PARTITION BY session_id ORDER BY at_ ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS after FROM x), seams AS (SELECT session_id, at_, max(k) AS n FROM b, (SELECT unnest(range(2, 9)) AS k) WHERE seam AND k <= len(before) AND k <= len(after) AND before[len(before) - k + 1:len(before)] = after[1:k] GROUP BY 1, 2)"


def _at(spark, sf):
    """Words by their initials, so that some repeat at seams; every eleventh shares its neighbour's source."""
    words = numbered_words(transcript(spark, sf)).select("session_id", "position", "i", F.left("word", F.lit(1)).alias("word"), "role", "at")
    source = F.when(F.col("position") % 5 == 4, "retained_live").otherwise("corrected_asr")
    index = F.when(F.col("at") % 11 == 10, F.col("at") - 1).otherwise(F.col("at"))
    return words.withColumns({"seam": (F.col("i") == 0) & (F.col("position") > 0), "source": source, "source_index": index, "ambiguous": F.col("role") == "UNKNOWN"})


@query("og16_seam_repeats", f"{_R}, {_AT} SELECT session_id, at_ AS at, n FROM seams")
def seams(spark, sf):
    return allocation.seam_repeats(_at(spark, sf))


@query("og16_insertion_classes", f"{_R}, {_AT}, m AS (SELECT DISTINCT session_id, at_ + unnest(range(-n, n)) AS at_, true AS repeated FROM seams), d AS (SELECT session_id, source_index, true AS twice FROM x WHERE source <> 'retained_live' GROUP BY 1, 2 HAVING count(*) > 1) SELECT x.session_id, x.at_ AS at, CASE WHEN source = 'retained_live' THEN 'retained_live_fallback' WHEN twice THEN 'duplicate_allocation_source' WHEN repeated THEN 'chunk_seam_duplicate' WHEN ambiguous THEN 'ambiguous_unclassified' ELSE 'other_corrected_asr' END AS class FROM x LEFT JOIN m USING (session_id, at_) LEFT JOIN d ON d.session_id = x.session_id AND d.source_index = x.source_index")
def classes(spark, sf):
    return allocation.insertion_classes(_at(spark, sf), F.lit(True))


@query("oh14_garble_similarity", None)
def garble(spark, sf):
    return allocation.garble_similarity(transcript(spark, sf), ["the", "und die", "question"])


@query("ox_op1_regional_errors", None)
def regional(spark, sf):
    spoken = reference(spark, sf)
    spans = intervals.cross_talk(spoken)
    refs = spoken.select("session_id", F.col("ordinal").cast("string").alias("segment_id"), F.col("ref_role").alias("role"), F.lit("").alias("speaker_id"), F.col("ref_start").alias("start_ms"), F.col("ref_end").alias("end_ms"), F.col("ref_text").alias("text"))
    points = lambda rows: intervals.word_points(rows, score_tokens(F.col("text")))
    ref, hyp = attribution.regional_words(points(refs), spans, "ref"), attribution.regional_words(points(transcript(spark, sf)), spans, "hyp")
    both = ref.join(hyp, ["session_id", "region"], "full").withColumn("key", F.concat_ws("|", "session_id", "region"))
    found = sequences.word_errors(both, "key", "ref", "hyp")
    return found.select(F.substring_index("key", "|", 1).alias("session_id"), F.substring_index("key", "|", -1).alias("region"), "distance", "substitutions", "insertions", "deletions", "matches")


@query("ox_op4_session_rates", f"{_R} SELECT session_id, round(count(*) FILTER (role <> 'UNKNOWN' AND speaker_id = 'spk_0') * 100.0 / nullif(count(*) FILTER (role <> 'UNKNOWN'), 0), 6) AS accuracy_percent, round(count(*) FILTER (len({_T.format('text')}) < 10) * 100.0 / count(*), 6) AS fragment_percent, round(count(*) / nullif((max(end_ms) - min(start_ms)) / 60000, 0), 6) AS rows_per_minute FROM rows GROUP BY 1")
def rates(spark, sf):
    return allocation.session_rates(transcript(spark, sf), F.col("speaker_id") == "spk_0", F.col("role") != "UNKNOWN", F.size(score_tokens(F.col("text"))) < 10)


_SHOWN = "s AS (SELECT session_id, position, CAST(j - 1 AS INT) AS display_index, ds[j] AS shown FROM (SELECT *, unnest(range(1, len(ds) + 1)) AS j FROM (SELECT *, regexp_extract_all(text, '\\S+') AS ds FROM rows)))"


@query("ox_op9_display_mapping", f"{_R}, {_SHOWN}, t AS (SELECT *, {_T.format('shown')} AS ts FROM s), u AS (SELECT *, unnest(range(1, len(ts) + 1)) AS k FROM t) SELECT session_id, position, display_index, CAST(k - 1 AS INT) AS piece_index, ts[k] AS token FROM u")
def mapping(spark, sf):
    return allocation.display_mapping(transcript(spark, sf))


@query("ox_op9_conflicting_sources", f"{_R}, {_AT} SELECT session_id, source_index, count(DISTINCT word) AS wordings FROM x GROUP BY 1, 2 HAVING count(DISTINCT word) > 1")
def conflicts(spark, sf):
    return allocation.conflicting_sources(_at(spark, sf))


@query("ox_op11_run_gaps", f"{_R}, n AS (SELECT session_id, position, len({_T.format('text')}) AS n, coalesce(sum(len({_T.format('text')})) OVER (PARTITION BY session_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM rows), r AS (SELECT session_id, position, a + CASE WHEN position % 7 = 6 THEN 1 ELSE 0 END AS a, a + n AS z FROM n), d AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY session_id ORDER BY position), 0) AS due FROM r) SELECT session_id, count(*) AS runs, count(*) FILTER (a <> due) AS gaps, count(*) FILTER (z <= a) AS empty_runs, CAST(sum(z - a) AS BIGINT) AS covered FROM d GROUP BY 1")
def gaps(spark, sf):
    n = F.size(score_tokens(F.col("text")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("session_id").orderBy("row_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = transcript(spark, sf).select("session_id", F.col("position").alias("row_index"), n.alias("n")).withColumn("a", before)
    late = F.when(F.col("row_index") % 7 == 6, 1).otherwise(0)
    return allocation.run_gaps(rows.select("session_id", "row_index", (F.col("a") + late).alias("start_index"), (F.col("a") + F.col("n")).alias("end_index")))


@query("ox_op34_appended_times", f"{_R}, w AS (SELECT segment_id, position, {_T.format('text')} AS ws, [start_ms + 80 * x for x in range(0, length(text) // 3 + 1)] AS ts, start_ms AS step FROM rows), e AS (SELECT *, len(ts) AS total, len(ws) AS n, position % 3 AS b, greatest(len(ts) - position % 3, 0) AS fresh, unnest(range(0, len(ws))) AS i FROM w), h AS (SELECT *, b + i * fresh // n AS lo, least(greatest(b + (i + 1) * fresh // n, b + i * fresh // n + 1), total) AS hi FROM e), t AS (SELECT segment_id, CAST(i AS INT) AS i, ws[i + 1] AS word, CASE WHEN fresh > 0 THEN ts[lo + 1] ELSE step END AS word_start, CASE WHEN fresh > 0 THEN ts[greatest(hi, 1)] + 80 ELSE step + 80 END AS z FROM h) SELECT segment_id, i, word, word_start, greatest(z, word_start + 50) AS word_end FROM t")
def appended(spark, sf):
    times = F.transform(F.sequence(F.lit(0), F.expr("length(text) div 3")), lambda x: F.col("start_ms") + 80 * x)
    steps = transcript(spark, sf).select("segment_id", score_tokens(F.col("text")).alias("words"), times.alias("token_ms"), (F.col("position") % 3).alias("tokens_before"), F.lit(80).alias("frame_ms"), F.col("start_ms").alias("step_ms"))
    return allocation.appended_times(steps)


@query("ol9_file_identity", "SELECT doc_id AS path, CASE WHEN doc_id % 10 = 3 THEN 'missing' WHEN doc_id % 10 = 4 THEN 'extra' WHEN doc_id % 10 = 5 THEN 'changed' ELSE 'matched' END AS status FROM documents")
def identity(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    last = F.col("path") % 10
    listed = docs.where(last != 4).withColumn("sha256", F.when(last == 5, F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    return allocation.file_identity(listed, docs.where(last != 3))
