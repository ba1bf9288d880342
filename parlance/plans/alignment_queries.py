"""Queries of word alignment, anchors and timings."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions.text import score_tokens
from parlance.operators import alignment, anchoring, intervals, sequences
from parlance.plans.interval_queries import _BEST
from parlance.plans.registry import query
from parlance.sources.adapt import ROWS_SQL, WORDS_SQL, numbered_words, reference, timed_words, transcript

_R = ROWS_SQL


def _adjacent(spark, sf):
    """Each turn's words against those of the turn before."""
    from pyspark.sql import Window

    words = score_tokens(F.col("text"))
    rows = transcript(spark, sf).select(F.col("segment_id").alias("key"), "session_id", "position", words.alias("words"))
    return rows.withColumn("was", F.lag("words").over(Window.partitionBy("session_id").orderBy("position"))).where("was is not null")


@query("og2_edit_operations")
def edit_operations(spark, sf):
    return alignment.operations(_adjacent(spark, sf), F.col("was"), F.col("words"))


@query("og3_forced_matches")
def forced(spark, sf):
    return alignment.unambiguous(_adjacent(spark, sf), F.col("was"), F.col("words"))


def _heard(spark, sf):
    """Each session's shown words, as a recogniser might hear them: every eleventh is lost, every seventh is another word."""
    words = numbered_words(transcript(spark, sf)).where("at % 11 <> 0").withColumn("word", F.when(F.col("at") % 7 == 0, F.concat(F.lit("x"), F.left("word", F.lit(1)))).otherwise(F.col("word")))
    return words.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("words"))


def _channels(spark, sf):
    """Each role's reference words of a whole session."""
    words = alignment.reference_words(reference(spark, sf).withColumn("session_id", F.struct("session_id", "ref_role")), F.lit(False))
    words = words.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "i", "word"))), lambda x: x["word"]).alias("words"))
    return words.select("session_id.session_id", F.col("session_id.ref_role").alias("role"), "words")


@query("og2_edit_steps")
def edit_steps(spark, sf):
    """Steps of each role's channel against all shown words, by the table function."""
    alignment.register_edit_steps(spark)
    pairs = _channels(spark, sf).join(_heard(spark, sf).withColumnRenamed("words", "heard"), "session_id")
    steps = spark.sql("SELECT p.session_id, p.role, s.op, s.ref_index, s.hyp_index FROM {pairs} AS p, LATERAL edit_steps(p.words, p.heard) AS s", pairs=pairs)
    return steps.groupBy("session_id", "role", "op").agg(F.count(F.lit(1)).alias("n"), F.sum("ref_index").alias("ref_places"), F.sum("hyp_index").alias("hyp_places"))


@query("og3_role_matches")
def role_matches(spark, sf):
    return alignment.role_matches(_channels(spark, sf), _heard(spark, sf))


@query("og4_one_role_matches", f"WITH {_R}, {WORDS_SQL}, m AS (SELECT session_id, role, i AS hyp_index, count(*) AS n FROM words GROUP BY ALL), o AS (SELECT session_id, hyp_index FROM m GROUP BY 1, 2 HAVING count(DISTINCT role) = 1) SELECT m.session_id, role, m.hyp_index, n FROM m JOIN o ON m.session_id = o.session_id AND m.hyp_index = o.hyp_index")
def one_role_places(spark, sf):
    words = timed_words(transcript(spark, sf)).groupBy("session_id", "role", F.col("i").alias("hyp_index")).agg(F.count(F.lit(1)).alias("n"))
    return alignment.one_role_matches(words)


@query("og4_one_role_words")
def one_role(spark, sf):
    return alignment.one_role_words(alignment.role_matches(_channels(spark, sf), _heard(spark, sf)))


@query("ox_op10_overlap_ambiguous")
def overlap_ambiguous(spark, sf):
    """Reference words of both roles in one line; a row overlaps if it starts before the one in front of it ends."""
    from pyspark.sql import Window

    refs = reference(spark, sf)
    order = Window.partitionBy("session_id").orderBy("ref_start", "ref_end", "ref_role", "ordinal")
    overlaps = F.coalesce(F.col("ref_start") < F.lag("ref_end").over(order), F.lit(False))
    words = alignment.reference_words(refs.withColumn("overlaps", overlaps), F.col("overlaps"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("place", "i")) - 1
    return alignment.overlap_ambiguous(words.select("session_id", place.alias("place"), "word", F.col("ambiguous").alias("overlaps")), _heard(spark, sf))


@query("og5_reference_words", f"WITH {_R}, p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ref_start, ref_end, ref_role, ordinal) - 1 AS place, regexp_extract_all(lower(ref_text), '[a-z'']+') AS ws FROM refs) SELECT session_id, place, ordinal % 2 = 0 AS ambiguous, j - 1 AS i, ws[j] AS word FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS j FROM p)")
def reference_words(spark, sf):
    return alignment.reference_words(reference(spark, sf), F.col("ordinal") % 2 == 0)


@query("og7_lcs_lengths")
def lcs_lengths(spark, sf):
    return _adjacent(spark, sf).select("key", sequences.lcs_words(F.col("was"), F.col("words")).alias("length"))


def _anchored(spark, sf):
    rows = transcript(spark, sf)
    stream = timed_words(rows).groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "i", "word"))), lambda x: x["word"]).alias("stream"), F.count(F.lit(1)).alias("total"))
    from pyspark.sql import Window

    own = F.size(score_tokens(F.col("text")))
    before = F.coalesce(F.sum(own).over(Window.partitionBy("session_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heard = F.transform(F.slice(score_tokens(F.col("text")), 1, 6), lambda w, i: F.when(i % 4 == 3, F.concat(w, F.lit("s"))).otherwise(w))
    return rows.select("session_id", "position", F.col("segment_id").alias("key"), own.alias("own"), heard.alias("heard"), before.alias("cursor")).join(stream, "session_id")


@query("og9_fuzzy_anchors")
def anchors(spark, sf):
    rows = _anchored(spark, sf)
    return alignment.anchors(rows, F.col("heard"), F.col("stream"), F.col("cursor"))


@query("og10_allocated_words")
def allocated(spark, sf):
    rows = _anchored(spark, sf)
    found = alignment.anchors(rows, F.col("heard"), F.col("stream"), F.col("cursor"))
    found = rows.select("session_id", "position", "key").join(found, "key").select("session_id", "position", "from_word")
    return alignment.allocated(rows.select("session_id", "position", "own"), found, rows.select("session_id", "total").distinct())


@query("og10_cursor_runs")
def cursor_runs(spark, sf):
    """All rows of a session, with their whole texts, against its words as they are heard."""
    words = _heard(spark, sf).select("session_id", F.posexplode("words").alias("at", "word"))
    return anchoring.allocation(transcript(spark, sf), words)


@query("og13_phrase_occurrences", f"""WITH {_R}, {WORDS_SQL}, l AS (SELECT session_id, position, word, row_number() OVER w - 1 AS "at", lead(word) OVER w AS w2, lead(position) OVER w AS p2 FROM words WINDOW w AS (PARTITION BY session_id ORDER BY position, i)) SELECT session_id, "at", position AS first_row, p2 AS last_row FROM l WHERE word = 'de' AND w2 = 'la' OR word = 'in' AND w2 = 'die'""")
def occurrences(spark, sf):
    rows = transcript(spark, sf).select("session_id", "position", score_tokens(F.col("text")).alias("words"))
    return alignment.occurrences(rows, ["de", "la"], ["in", "die"])


@query("og15_timing_validation", f"WITH {_R} SELECT segment_id, position % 4 = 0 OR position % 4 = 3 AND end_ms >= start_ms AS valid FROM rows")
def timing(spark, sf):
    s, e, k = F.col("start_ms").cast("double"), F.col("end_ms").cast("double"), F.col("position") % 4
    starts = F.when(k == 1, F.array(e + 1, s - 1)).when(k == 2, F.array(s, F.lit(float("nan")))).otherwise(F.array(s, s))
    ends = F.when(k == 1, F.array(e + 2, e + 2)).otherwise(F.array(e, e))
    return transcript(spark, sf).select("segment_id", alignment.valid_timing(F.array(F.lit("a"), F.lit("b")), starts, ends).alias("valid"))


@query("of15_ownership_counts", f"WITH {_R}, {_BEST} SELECT session_id, speaker_id, count(*) FILTER (expected_role = 'DOCTOR') AS doctor, count(*) FILTER (expected_role = 'PATIENT') AS patient, count(*) FILTER (expected_role IS NULL) AS unowned, greatest(count(*) FILTER (expected_role = 'DOCTOR'), count(*) FILTER (expected_role = 'PATIENT')) AS best FROM judged GROUP BY 1, 2")
def ownership(spark, sf):
    return alignment.ownership(intervals.expected_roles(transcript(spark, sf), reference(spark, sf)))
