"""Queries over intervals: overlap joins, span merging, attribution of rows and words."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions.text import norm_duplicate, rate, score_tokens
from parlance.operators import attribution, intervals
from parlance.plans.registry import query
from parlance.sources.adapt import ROWS_SQL, reference, table, transcript

_PAIRS = "pairs AS (SELECT a.session_id, a.segment_id, b.ref_role, b.ordinal, least(a.end_ms, b.ref_end) - greatest(a.start_ms, b.ref_start) AS ov FROM rows a JOIN refs b ON a.session_id = b.session_id AND a.start_ms < b.ref_end AND b.ref_start < a.end_ms)"
_BEST = f"{_PAIRS}, by_role AS (SELECT session_id, segment_id, ref_role, sum(ov) AS ov FROM pairs GROUP BY ALL), best AS (SELECT session_id, segment_id, max(ov) AS best FROM by_role GROUP BY ALL), expected AS (SELECT b.session_id, b.segment_id, CASE WHEN count(*) = 1 THEN min(ref_role) END AS expected_role FROM by_role b JOIN best USING (session_id, segment_id) WHERE ov = best GROUP BY ALL), judged AS (SELECT r.*, expected_role FROM rows r LEFT JOIN expected USING (session_id, segment_id))"
_MERGE = """{name}_m AS (SELECT *, CASE WHEN start_ms <= max(end_ms) OVER (PARTITION BY session_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM {src}),
{name}_i AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM {name}_m),
{name} AS (SELECT session_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_spans FROM {name}_i GROUP BY session_id, island)"""
_TALK = "both_ AS (SELECT d.session_id, greatest(d.ref_start, p.ref_start) AS start_ms, least(d.ref_end, p.ref_end) AS end_ms FROM refs d JOIN refs p ON d.session_id = p.session_id AND d.ref_role = 'DOCTOR' AND p.ref_role = 'PATIENT' AND d.ref_start < p.ref_end AND p.ref_start < d.ref_end), " + _MERGE.format(name="talk", src="both_")
_POINTS = "w1 AS (SELECT *, regexp_extract_all(lower(text), '[a-z'']+') AS ws FROM rows), points AS (SELECT session_id, segment_id, role, i - 1 AS word_index, ws[i] AS word, start_ms + CAST(floor((end_ms - start_ms) * (2 * (i - 1) + 1) / (2 * len(ws))) AS BIGINT) AS at_ms FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM w1))"


@query("oe1_overlap_by_role", f"WITH {ROWS_SQL}, {_PAIRS} SELECT session_id, segment_id, ref_role, CAST(sum(ov) AS BIGINT) AS overlap_ms FROM pairs GROUP BY ALL")
def overlap_by_role(spark, sf):
    return intervals.role_overlaps(transcript(spark, sf), reference(spark, sf))


@query("oe2_channel_cross_talk", f"WITH {ROWS_SQL}, {_TALK} SELECT * FROM talk")
def channel_cross_talk(spark, sf):
    return intervals.cross_talk(reference(spark, sf))


@query("oe3_rows_touching_cross_talk", f"WITH {ROWS_SQL}, {_TALK} SELECT session_id, segment_id, EXISTS (SELECT 1 FROM talk t WHERE t.session_id = r.session_id AND r.start_ms < t.end_ms AND t.start_ms < r.end_ms) AS touches FROM rows r")
def rows_touching(spark, sf):
    rows, spans = transcript(spark, sf), intervals.cross_talk(reference(spark, sf))
    hit = intervals.touching(rows, spans).select("session_id", "segment_id", F.lit(True).alias("touches"))
    return rows.select("session_id", "segment_id").join(hit, ["session_id", "segment_id"], "left").withColumn("touches", F.coalesce("touches", F.lit(False)))


@query("oe4_unique_active_role", f"WITH {ROWS_SQL}, {_POINTS} SELECT p.session_id, p.segment_id, p.word_index, p.at_ms, CASE WHEN count(DISTINCT ref_role) = 1 THEN min(ref_role) END AS active_role FROM points p LEFT JOIN refs r ON r.session_id = p.session_id AND r.ref_start <= p.at_ms AND p.at_ms < r.ref_end GROUP BY ALL")
def unique_active(spark, sf):
    points = intervals.word_points(transcript(spark, sf), score_tokens(F.col("text")))
    return intervals.unique_active_role(points, reference(spark, sf)).select("session_id", "segment_id", "word_index", "at_ms", "active_role")


@query("oe5_word_in_shortest_turn", f"WITH {ROWS_SQL}, {_POINTS} SELECT p.session_id, p.segment_id, p.word_index, (SELECT arg_min(ordinal, (ref_end - ref_start) * 1000000 + ordinal) FROM refs r WHERE r.session_id = p.session_id AND r.ref_start <= p.at_ms AND p.at_ms <= r.ref_end) AS turn_index FROM points p")
def shortest_turn(spark, sf):
    points = intervals.word_points(transcript(spark, sf), score_tokens(F.col("text")))
    return intervals.containing_turn(points, reference(spark, sf)).select("session_id", "segment_id", "word_index", "turn_index")


_NEAR = "near_ AS (SELECT p.session_id, p.segment_id, p.word_index, r.ordinal, greatest(r.ref_start - p.at_ms, p.at_ms - r.ref_end, 0) AS gap FROM points p JOIN refs r ON r.session_id = p.session_id AND r.ref_start - {0} <= p.at_ms AND p.at_ms <= r.ref_end + {0})"


def _nearest(spark, sf, reach):
    points = intervals.word_points(transcript(spark, sf), score_tokens(F.col("text")))
    return intervals.nearest_turn(points, reference(spark, sf), reach).select("session_id", "segment_id", "word_index", "turn_index", "gap_ms")


_NEAR_SQL = f"WITH {ROWS_SQL}, {_POINTS}, {_NEAR} SELECT p.session_id, p.segment_id, p.word_index, arg_min(n.ordinal, n.gap * 1000000 + n.ordinal) AS turn_index, CAST(min(n.gap) AS BIGINT) AS gap_ms FROM points p LEFT JOIN near_ n USING (session_id, segment_id, word_index) GROUP BY ALL"


@query("oe6_word_to_row_or_nearest", _NEAR_SQL.format(1500))
def row_or_nearest(spark, sf):
    return _nearest(spark, sf, 1500)


@query("oe7_word_to_nearest_turn", _NEAR_SQL.format(500))
def nearest_turn(spark, sf):
    return _nearest(spark, sf, 500)


@query("oe8_emission_window_asof", f"WITH {ROWS_SQL}, win AS (SELECT session_id, ordinal, lag(ref_end, 1, 0) OVER (PARTITION BY session_id ORDER BY ordinal) AS from_ms, ref_end AS until_ms FROM refs) SELECT r.session_id, r.segment_id, min(w.ordinal) AS window_index FROM rows r LEFT JOIN win w ON w.session_id = r.session_id AND w.from_ms < r.end_ms AND r.end_ms <= w.until_ms GROUP BY ALL")
def emission_window(spark, sf):
    return attribution.emission_window(transcript(spark, sf), attribution.emission_windows(reference(spark, sf)))


@query("oe9_uncovered_rows", f"WITH {ROWS_SQL}, {_PAIRS}, m AS (SELECT r.session_id, r.segment_id, r.end_ms - r.start_ms AS length, coalesce(max(ov), 0) AS best_ms FROM rows r LEFT JOIN pairs USING (session_id, segment_id) GROUP BY ALL) SELECT session_id, segment_id, CAST(best_ms AS BIGINT) AS best_ms FROM m WHERE best_ms <= CASE WHEN length < 200 THEN 0 ELSE length * 0.25 END")
def uncovered_rows(spark, sf):
    return intervals.uncovered(transcript(spark, sf), reference(spark, sf)).select("session_id", "segment_id", F.col("best_ms").cast("long").alias("best_ms"))


@query("oe10_echo_pairs", f"WITH {ROWS_SQL}, n AS (SELECT *, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS norm, FROM rows) SELECT a.session_id, a.segment_id AS first_id, b.segment_id AS second_id, CAST(least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) AS BIGINT) AS overlap_ms FROM n a JOIN n b ON a.session_id = b.session_id AND a.norm = b.norm AND a.position < b.position AND a.speaker_id <> b.speaker_id WHERE a.norm <> '' AND least(a.end_ms, b.end_ms) > greatest(a.start_ms, b.start_ms)")
def echo_pairs(spark, sf):
    return intervals.echo_pairs(transcript(spark, sf), norm_duplicate(F.col("text")))


@query("oe11_band_pairs", f"WITH {ROWS_SQL} SELECT a.session_id, a.segment_id AS first_id, b.segment_id AS second_id, CAST(b.start_ms - a.start_ms AS BIGINT) AS gap_ms FROM rows a JOIN rows b ON a.session_id = b.session_id AND b.start_ms BETWEEN a.start_ms AND a.start_ms + 5000 AND (a.start_ms < b.start_ms OR a.start_ms = b.start_ms AND a.position < b.position)")
def band_pairs(spark, sf):
    return intervals.band_pairs(transcript(spark, sf), 5000)


@query("oe14_lane_diff", f"WITH {ROWS_SQL}, lane AS (SELECT * FROM rows), fixed AS (SELECT segment_id || CASE WHEN position % 6 = 5 THEN '-new' ELSE '' END AS segment_id, session_id, CASE WHEN position % 5 = 0 THEN 'DOCTOR' ELSE role END AS role, position FROM rows) SELECT coalesce(a.segment_id, b.segment_id) AS segment_id, a.role AS live_role, b.role AS corrected_role, CASE WHEN a.segment_id IS NULL THEN 'added' WHEN b.segment_id IS NULL THEN 'removed' WHEN a.role = b.role THEN 'same' ELSE 'changed' END AS change FROM lane a FULL JOIN fixed b ON a.segment_id = b.segment_id")
def lane_diff(spark, sf):
    rows = transcript(spark, sf)
    corrected = rows.withColumn("role", F.when(F.col("position") % 5 == 0, "DOCTOR").otherwise(F.col("role")))
    corrected = corrected.withColumn("segment_id", F.concat("segment_id", F.when(F.col("position") % 6 == 5, "-new").otherwise("")))
    return attribution.lane_diff(rows, corrected)


@query("oe19_same_speaker_neighbours", f"WITH {ROWS_SQL} SELECT session_id, segment_id, CASE WHEN lag(speaker_id) OVER w = speaker_id THEN lag(text) OVER w END AS previous_text, CASE WHEN lead(speaker_id) OVER w = speaker_id THEN lead(text) OVER w END AS next_text FROM (SELECT * REPLACE ('spk_' || ((position // 2) % 2) AS speaker_id) FROM rows) WINDOW w AS (PARTITION BY session_id ORDER BY start_ms, end_ms, position)")
def same_speaker(spark, sf):
    return attribution.same_speaker_context(transcript(spark, sf).withColumn("speaker_id", F.concat(F.lit("spk_"), F.expr("position div 2") % 2)))


@query("of1_merged_spans", f"WITH {ROWS_SQL}, {_MERGE.format(name='merged', src='rows')} SELECT * FROM merged")
def merged_spans(spark, sf):
    return intervals.merge_spans(transcript(spark, sf), ["session_id"])


@query("of1_merged_order_spans", f"WITH src AS (SELECT l.l_suppkey AS session_id, CAST(epoch_ms(o.o_orderdate) AS BIGINT) AS start_ms, CAST(greatest(epoch_ms(l.l_shipdate), epoch_ms(o.o_orderdate)) AS BIGINT) AS end_ms FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey), {_MERGE.format(name='merged', src='src')} SELECT * FROM merged")
def merged_order_spans(spark, sf):
    both = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    spans = both.select(F.col("l_suppkey").alias("session_id"), ms("o_orderdate").alias("start_ms"), F.greatest(ms("l_shipdate"), ms("o_orderdate")).alias("end_ms"))
    return intervals.merge_spans(spans, ["session_id"])


@query("of3_stitched_rows", f"WITH {ROWS_SQL}, m AS (SELECT *, CASE WHEN lag(role) OVER w = role AND start_ms - lag(end_ms) OVER w <= 2000 THEN 0 ELSE 1 END AS fresh FROM (SELECT * REPLACE (CASE (position // 2) % 2 WHEN 0 THEN 'PATIENT' ELSE 'DOCTOR' END AS role) FROM rows) WINDOW w AS (PARTITION BY session_id ORDER BY position)), i AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS run FROM m) SELECT session_id, min(position) AS first_position, min(role) AS role, CAST(min(start_ms) AS BIGINT) AS start_ms, CAST(max(end_ms) AS BIGINT) AS end_ms, count(*) AS n_rows, string_agg(text, ' ' ORDER BY position) AS text FROM i GROUP BY session_id, run")
def stitched(spark, sf):
    return intervals.stitch_rows(transcript(spark, sf).withColumn("role", F.when(F.expr("position div 2") % 2 == 0, "PATIENT").otherwise("DOCTOR")))


@query("of6_attribution_accuracy", f"WITH {ROWS_SQL}, {_BEST}, {_TALK}, j AS (SELECT *, EXISTS (SELECT 1 FROM talk t WHERE t.session_id = g.session_id AND g.start_ms < t.end_ms AND t.start_ms < g.end_ms) AS touches FROM judged g) SELECT session_id, count(expected_role) AS scored, count(*) FILTER (role = expected_role) AS correct, round(count(*) FILTER (role = expected_role) / nullif(count(expected_role), 0), 6) AS accuracy, count(expected_role) FILTER (NOT touches) AS clean_scored, round(count(*) FILTER (role = expected_role AND NOT touches) / nullif(count(expected_role) FILTER (NOT touches), 0), 6) AS clean_accuracy FROM j GROUP BY session_id")
def attribution_accuracy(spark, sf):
    return attribution.accuracy(transcript(spark, sf), reference(spark, sf))


_STRICT = "SELECT session_id, count(expected_role) AS scored, count(*) FILTER (role = expected_role) AS correct, count(*) FILTER (expected_role IS NOT NULL AND role IN ('DOCTOR', 'PATIENT') AND role <> expected_role) AS wrong, count(*) FILTER (expected_role IS NOT NULL AND role NOT IN ('DOCTOR', 'PATIENT')) AS uncertain, count(*) FILTER (expected_role IS NULL) AS unscored, round(count(*) FILTER (role = expected_role) / nullif(count(expected_role), 0), 6) AS strict_accuracy, round(count(*) FILTER (role = expected_role) / nullif(count(*) FILTER (expected_role IS NOT NULL AND role IN ('DOCTOR', 'PATIENT')), 0), 6) AS confident_accuracy, round(count(*) FILTER (expected_role IS NOT NULL AND role NOT IN ('DOCTOR', 'PATIENT')) / nullif(count(expected_role), 0), 6) AS uncertain_rate FROM judged GROUP BY session_id"


@query("of7_strict_attribution", f"WITH {ROWS_SQL}, {_BEST} {_STRICT}")
def strict(spark, sf):
    return attribution.strict(intervals.expected_roles(transcript(spark, sf), reference(spark, sf)))


@query("of8_speaker_purity", f"WITH {ROWS_SQL}, {_BEST}, c AS (SELECT session_id, speaker_id, expected_role, count(*) AS n FROM judged WHERE expected_role IS NOT NULL GROUP BY ALL) SELECT session_id, speaker_id, CAST(sum(n) AS BIGINT) AS rows_scored, max(n) AS rows_best, round(max(n) / sum(n), 6) AS purity FROM c GROUP BY session_id, speaker_id")
def purity(spark, sf):
    return attribution.purity(intervals.expected_roles(transcript(spark, sf), reference(spark, sf)))


@query("of9_best_dyadic_mapping", f"WITH {ROWS_SQL}, {_BEST}, c AS (SELECT session_id, 'spk_' || (position % 2) AS speaker_id, count(*) FILTER (expected_role = 'DOCTOR') AS d, count(*) FILTER (expected_role = 'PATIENT') AS p FROM judged GROUP BY ALL), x AS (SELECT session_id, count(*) AS speakers, arg_min(d, speaker_id) AS d1, arg_min(p, speaker_id) AS p1, arg_max(d, speaker_id) AS d2, arg_max(p, speaker_id) AS p2, sum(d + p) AS n FROM c GROUP BY session_id) SELECT session_id, CAST(n AS BIGINT) AS scored, greatest(d1 + p2, p1 + d2) AS best_correct, CASE WHEN d1 + p2 >= p1 + d2 THEN 'DOCTOR' ELSE 'PATIENT' END AS first_speaker_role FROM x WHERE speakers = 2")
def dyadic(spark, sf):
    return attribution.dyadic_mapping(intervals.expected_roles(transcript(spark, sf).withColumn("speaker_id", F.concat(F.lit("spk_"), F.col("position") % 2)), reference(spark, sf)))


@query("of10_phantom_speakers", f"WITH {ROWS_SQL} SELECT session_id, count(DISTINCT speaker_id) AS speakers, greatest(0, count(DISTINCT speaker_id) - 2) AS phantoms FROM rows GROUP BY session_id")
def phantoms(spark, sf):
    return transcript(spark, sf).groupBy("session_id").agg(F.count_distinct("speaker_id").alias("speakers"), F.greatest(F.lit(0), F.count_distinct("speaker_id") - 2).alias("phantoms"))


@query("of12_segmentation", f"WITH {ROWS_SQL}, t AS (SELECT *, len(regexp_extract_all(lower(text), '[a-z'']+')) AS n FROM rows) SELECT session_id, count(*) AS n_rows, count(*) FILTER (n < 3) AS fragments, round(count(*) FILTER (n < 3) / count(*), 6) AS fragment_rate, round(count(*) * 60000 / nullif(max(end_ms) - min(start_ms), 0), 6) AS rows_per_minute FROM t GROUP BY session_id")
def segmentation(spark, sf):
    few = F.size(score_tokens(F.col("text"))) < 3
    length = F.max("end_ms") - F.min("start_ms")
    return transcript(spark, sf).groupBy("session_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(few).alias("fragments"), F.round(F.count_if(few) / F.count(F.lit(1)), 6).alias("fragment_rate"), rate(F.count(F.lit(1)) * 60000, length).alias("rows_per_minute"))


@query("of13_words_by_region", f"WITH {ROWS_SQL}, {_POINTS}, {_TALK} SELECT p.session_id, count(*) FILTER (NOT hit) AS clean_words, count(*) FILTER (hit) AS overlap_words FROM (SELECT *, EXISTS (SELECT 1 FROM talk t WHERE t.session_id = q.session_id AND t.start_ms <= q.at_ms AND q.at_ms < t.end_ms) AS hit FROM points q) p GROUP BY ALL")
def by_region(spark, sf):
    points = intervals.word_points(transcript(spark, sf), score_tokens(F.col("text")))
    return attribution.words_by_region(points, intervals.cross_talk(reference(spark, sf)))


@query("of14_boundary_buckets", f"WITH {ROWS_SQL}, {_POINTS}, edges AS (SELECT session_id, ref_start AS edge FROM refs UNION SELECT session_id, ref_end FROM refs), d AS (SELECT p.session_id, p.segment_id, p.word_index, p.role, (SELECT min(abs(e.edge - p.at_ms)) FROM edges e WHERE e.session_id = p.session_id AND abs(e.edge - p.at_ms) <= 400) AS dist, (SELECT CASE WHEN count(DISTINCT ref_role) = 1 THEN min(ref_role) END FROM refs r WHERE r.session_id = p.session_id AND r.ref_start <= p.at_ms AND p.at_ms < r.ref_end) AS active_role FROM points p) SELECT t AS tolerance_ms, coalesce(dist <= t, false) AS near_boundary, count(*) AS words, count(*) FILTER (active_role IS NOT NULL) AS scored, count(*) FILTER (role = active_role) AS correct FROM d, (SELECT unnest([150, 250, 400]) AS t) GROUP BY ALL")
def boundaries(spark, sf):
    points = intervals.word_points(transcript(spark, sf), score_tokens(F.col("text")))
    return attribution.boundary_buckets(intervals.unique_active_role(points, reference(spark, sf)), reference(spark, sf))


@query("of15_ownership_confusion", f"WITH {ROWS_SQL}, {_BEST} SELECT session_id, speaker_id, count(*) FILTER (expected_role = 'DOCTOR') AS doctor_rows, count(*) FILTER (expected_role = 'PATIENT') AS patient_rows, greatest(count(*) FILTER (expected_role = 'DOCTOR'), count(*) FILTER (expected_role = 'PATIENT')) AS oracle_rows FROM judged GROUP BY session_id, speaker_id")
def confusion(spark, sf):
    return attribution.confusion(intervals.expected_roles(transcript(spark, sf), reference(spark, sf)))



@query("of19_majority_role", f"WITH {ROWS_SQL}, c AS (SELECT session_id, speaker_id, role, count(*) AS n, min(position) AS first_at FROM rows GROUP BY ALL) SELECT session_id, speaker_id, arg_max(role, n * 1000000 - first_at) AS majority_role, max(n) AS votes FROM c GROUP BY session_id, speaker_id")
def majority(spark, sf):
    return attribution.majority_role(transcript(spark, sf))


@query("of20_suppressed_speakers", f"WITH {ROWS_SQL}, s AS (SELECT session_id, speaker_id, sum(end_ms - start_ms) AS ms, count(*) AS n FROM rows GROUP BY ALL), q AS (SELECT *, sum(ms) OVER (PARTITION BY session_id) AS total FROM s) SELECT session_id, speaker_id, CAST(ms AS BIGINT) AS speech_ms, n AS n_rows FROM q WHERE ms < total * 0.2 AND ms <= 20000 AND n < 2")
def suppressed(spark, sf):
    return attribution.suppressed_speakers(transcript(spark, sf), share=0.2, most_ms=20_000, rows_below=2)


@query("of21_orphan_speakers", f"WITH {ROWS_SQL}, c AS (SELECT session_id, speaker_id, CASE WHEN speaker_id = 'spk_1' THEN 'DOCTOR' ELSE 'PATIENT' END AS mapped_role, count(*) AS n FROM rows GROUP BY ALL), m AS (SELECT *, max(n) OVER (PARTITION BY session_id, mapped_role) AS top FROM c) SELECT session_id, speaker_id, mapped_role, n AS n_rows FROM m WHERE n < top")
def orphans(spark, sf):
    mapped = transcript(spark, sf).withColumn("mapped_role", F.when(F.col("speaker_id") == "spk_1", "DOCTOR").otherwise("PATIENT"))
    return attribution.orphan_speakers(mapped)



@query("entry_attribution_report", f"WITH {ROWS_SQL}, {_BEST}, {_TALK}, strict AS ({_STRICT}), spoken AS (SELECT session_id, CAST(sum(end_ms - start_ms) AS BIGINT) AS cross_talk_ms FROM talk GROUP BY 1) SELECT strict.*, cross_talk_ms FROM strict LEFT JOIN spoken USING (session_id)")
def report(spark, sf):
    judged = intervals.expected_roles(transcript(spark, sf), reference(spark, sf))
    return attribution.strict(judged).join(intervals.cross_talk(reference(spark, sf)).groupBy("session_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("cross_talk_ms")), "session_id", "left").orderBy("session_id")


_FOLDS = f"""spans AS (SELECT session_id, position // 2 AS window_, speaker_id AS origin, 'spk_' || ((position + 1) % 3) AS visible, start_ms, (start_ms + end_ms) // 2 AS end_ms, position AS n_words FROM rows
  UNION ALL SELECT session_id, position // 2 + 1, speaker_id, 'spk_' || ((position + 1) % 3), start_ms, (start_ms + end_ms) // 2, position + 100 FROM rows WHERE position % 2 = 0),
last_ AS (SELECT session_id, origin, visible, start_ms, end_ms, max(window_ * 1000 + n_words) AS w FROM spans GROUP BY ALL),
owed AS (SELECT l.session_id, l.origin, l.visible, l.start_ms, l.end_ms, ref_role, sum(least(l.end_ms, ref_end) - greatest(l.start_ms, ref_start)) AS ov FROM last_ l JOIN refs r ON r.session_id = l.session_id AND l.start_ms < ref_end AND ref_start < l.end_ms GROUP BY ALL),
top AS (SELECT session_id, origin, visible, start_ms, end_ms, CASE WHEN count(*) = 1 THEN min(ref_role) END AS expected_role FROM (SELECT *, max(ov) OVER (PARTITION BY session_id, origin, visible, start_ms, end_ms) AS best FROM owed) WHERE ov = best GROUP BY ALL),
seen AS (SELECT l.session_id, l.origin, l.visible, l.start_ms, l.end_ms, list_sort(list(DISTINCT r.role)) AS roles FROM last_ l JOIN rows r ON r.session_id = l.session_id AND r.speaker_id = l.visible AND r.role IN ('DOCTOR', 'PATIENT') AND l.start_ms < r.end_ms AND r.start_ms < l.end_ms GROUP BY ALL)"""


def _fold_windows(spark, sf):
    """Each row's first half as a span of its window, folded into the next speaker; every second one is told again by the next window."""
    p, c = F.col("position"), F.col
    span = lambda extra: F.struct(c("speaker_id").alias("origin"), F.concat(F.lit("spk_"), (p + 1) % 3).alias("visible"), c("start_ms"), F.expr("(start_ms + end_ms) div 2").alias("end_ms"), (p + extra).cast("long").alias("n_words"))
    rows = transcript(spark, sf)
    first = rows.select("session_id", F.expr("position div 2").alias("window"), span(0).alias("s"))
    again = rows.where(p % 2 == 0).select("session_id", F.expr("position div 2 + 1").alias("window"), span(100).alias("s"))
    return first.unionByName(again).groupBy("session_id", "window").agg(F.collect_list("s").alias("spans"))


@query(
    "ox_op6_scored_folds",
    f"""WITH {ROWS_SQL}, {_FOLDS} SELECT session_id, origin, visible, start_ms, end_ms, w // 1000 AS "window", w % 1000 AS n_words, expected_role, array_to_string(coalesce(roles, []), ',') AS visible_roles,
  CASE WHEN expected_role IS NULL OR roles IS NULL THEN 'unresolved_fold' WHEN list_contains(roles, expected_role) THEN 'benign_same_role_fold' ELSE 'harmful_cross_speaker_fold' END AS class,
  CASE WHEN expected_role IS NULL OR roles IS NULL OR len(roles) <> 1 THEN 'unresolved' WHEN list_contains(roles, expected_role) THEN 'correct' ELSE 'wrong' END AS state
FROM last_ LEFT JOIN top USING (session_id, origin, visible, start_ms, end_ms) LEFT JOIN seen USING (session_id, origin, visible, start_ms, end_ms)""",
)
def scored_folds(spark, sf):
    found = attribution.scored_folds(_fold_windows(spark, sf), transcript(spark, sf), reference(spark, sf))
    return found.withColumn("visible_roles", F.array_join("visible_roles", ","))
