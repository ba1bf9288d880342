"""Queries of notes: citations, grounding, terms, fragments, roles by cues and attribution of folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import attribution, intervals, notes
from parlance.plans.interval_queries import _BEST, _PAIRS
from parlance.plans.registry import query
from parlance.sources.adapt import ROWS_SQL, WORDS_SQL, reference, timed_words, transcript

_R = ROWS_SQL
_W = "' ' || array_to_string(regexp_extract_all(lower({0}), '[a-z'']+'), ' ') || ' '"
_TERMS = ["the", "und", "que", "die", "la", "de", "in", "of"]
_TERM_LIST = "['the', 'und', 'que', 'die', 'la', 'de', 'in', 'of']"
_CITES = "cites AS (SELECT session_id, segment_id AS claim_id, text AS claim, o AS ord, session_id || '-' || (position + CASE o WHEN 1 THEN 1 WHEN 2 THEN 40 ELSE -1 END) AS cited FROM rows, (SELECT unnest([0, 1, 2, 3]) AS o) WHERE role = 'DOCTOR')"


def _cites(rows):
    near = F.when(F.col("ord") == 1, 1).when(F.col("ord") == 2, 40).otherwise(-1)
    each = rows.where("role = 'DOCTOR'").withColumn("ord", F.explode(F.array(*map(F.lit, range(4)))))
    return each.select("session_id", F.col("segment_id").alias("claim_id"), F.col("text").alias("claim"), "ord", F.concat_ws("-", "session_id", F.col("position") + near).alias("cited"))


def _cited(rows):
    """Claims with the text of the rows that they cite, each once."""
    found = notes.resolved_citations(_cites(rows), rows).select("session_id", "claim_id", "cited")
    return found.join(rows.select("session_id", F.col("segment_id").alias("cited"), "text", "position"), ["session_id", "cited"])


_CITED = f"{_CITES}, cited AS (SELECT DISTINCT c.session_id, c.claim_id, c.cited, r.text, r.position FROM cites c JOIN rows r ON r.session_id = c.session_id AND r.segment_id = c.cited)"


@query("oe12_resolved_citations", f"WITH {_R}, {_CITES} SELECT c.session_id, claim_id, cited, min(ord) AS ord FROM cites c JOIN rows r ON r.session_id = c.session_id AND r.segment_id = c.cited GROUP BY ALL")
def resolved(spark, sf):
    rows = transcript(spark, sf)
    return notes.resolved_citations(_cites(rows), rows)


@query("oe13_unresolved_citations", f"WITH {_R}, {_CITES} SELECT c.session_id, count(*) AS citations, count(*) FILTER (r.segment_id IS NULL) AS unresolved, round(count(*) FILTER (r.segment_id IS NULL) / count(*), 6) AS share FROM cites c LEFT JOIN rows r ON r.session_id = c.session_id AND r.segment_id = c.cited GROUP BY 1")
def unresolved(spark, sf):
    rows = transcript(spark, sf)
    return notes.unresolved_citations(_cites(rows), rows)


@query("oe15_aligned_findings", f"WITH {_R} SELECT session_id, position, role, 'code' || position % 3 AS code, end_ms - start_ms AS ms FROM rows")
def aligned(spark, sf):
    rows = transcript(spark, sf)
    return notes.aligned(rows.select("session_id", "position", "role", F.concat(F.lit("code"), F.col("position") % 3).alias("code")), rows.select("session_id", "position", "role", F.expr("end_ms - start_ms").alias("ms")), ["session_id", "position"], ["role"])


_LINK = "link AS (SELECT a.session_id, 'spk_' || ((a.position + 1) % 3) AS voice, b.speaker_id AS slot, CAST(sum(least(a.end_ms + 400, b.end_ms) - greatest(a.start_ms + 400, b.start_ms)) AS BIGINT) AS linked_ms FROM rows a JOIN rows b ON a.session_id = b.session_id AND b.role <> 'UNKNOWN' AND a.start_ms + 400 < b.end_ms AND b.start_ms < a.end_ms + 400 GROUP BY ALL)"


def _linked(spark, sf):
    rows = transcript(spark, sf)
    rebuilt = rows.select("session_id", F.concat(F.lit("spk_"), (F.col("position") + 1) % 3).alias("voice"), (F.col("start_ms") + 400).alias("start_ms"), (F.col("end_ms") + 400).alias("end_ms"))
    live = rows.where("role <> 'UNKNOWN'").select("session_id", F.col("speaker_id").alias("slot"), F.col("start_ms").alias("ref_start"), F.col("end_ms").alias("ref_end"))
    pairs = intervals.overlap_join(rebuilt, live, ["session_id"], "start_ms", "end_ms", "ref_start", "ref_end")
    return notes.linkage(pairs.withColumn("overlap_ms", F.expr("least(end_ms, ref_end) - greatest(start_ms, ref_start)")))


@query("oe16_fold_linkage", f"WITH {_R}, {_LINK} SELECT * FROM link")
def fold_linkage(spark, sf):
    return _linked(spark, sf)


@query("of18_span_decisions", f"WITH {_R}, {_LINK}, t AS (SELECT *, coalesce(lead(linked_ms) OVER w, 0) AS second, row_number() OVER w AS n FROM link WINDOW w AS (PARTITION BY session_id, voice ORDER BY linked_ms DESC, slot)) SELECT session_id, voice, slot, linked_ms, CASE WHEN linked_ms < 3000 THEN 'keep_live_weak_linkage' WHEN linked_ms < 2 * second THEN 'keep_live_ambiguous_linkage' WHEN voice = slot THEN 'keep_live_same_voice' ELSE 'replace' END AS decision FROM t WHERE n = 1")
def span_decisions(spark, sf):
    return notes.span_decision(_linked(spark, sf))


_CARDS = [("articles", ["the ", "die ", "la "]), ("joins", ["und ", "and ", "et "]), ("asks", ["que", "?"]), ("endings", ["tion", "ung", "ing"]), ("rare", ["zzz"])]
_HITS = "ks AS (SELECT unnest([" + ", ".join(f"{{'card': '{c}', 'ord': {i}, 'word': '{w}'}}" for i, (c, ws) in enumerate(_CARDS) for w in ws) + "]) AS k), hits AS (SELECT session_id, k.card AS card, k.ord AS ord, count(DISTINCT k.word) AS hits FROM rows, ks WHERE contains(lower(text), k.word) GROUP BY ALL)"


@query("oe17_card_hits", f"WITH {_R}, {_HITS} SELECT * FROM hits")
def card_hits(spark, sf):
    return notes.card_hits(transcript(spark, sf), _CARDS)


@query("oh11_top_cards", f"WITH {_R}, {_HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY hits DESC, ord) AS rank FROM hits) SELECT session_id, rank, card, hits FROM r WHERE rank <= 3")
def top_cards(spark, sf):
    return notes.top_cards(notes.card_hits(transcript(spark, sf), _CARDS))


@query("oe18_phrase_collisions", f"WITH {_R}, p AS (SELECT unnest(['de la', 'in die', 'the', 'of and', 'que la', 'no such phrase']) AS phrase) SELECT phrase, count(*) AS uses, min(segment_id) AS first FROM rows, p WHERE contains({_W.format('text')}, ' ' || phrase || ' ') GROUP BY 1")
def collisions(spark, sf):
    return notes.phrase_uses(transcript(spark, sf), ["de la", "in die", "the", "of and", "que la", "no such phrase"])


_SHORT = "short AS (SELECT session_id, position, 'spk_' || ((position // 2) % 2) AS speaker_id, trim(left(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'), 4 + position % 3 * 9)) AS text, start_ms, end_ms FROM rows)"


def _short(spark, sf):
    text = F.trim(F.expr("left(regexp_replace(text, '[^A-Za-z]+', ' '), 4 + position % 3 * 9)"))
    return transcript(spark, sf).select("session_id", "position", F.concat(F.lit("spk_"), F.expr("position div 2") % 2).alias("speaker_id"), text.alias("text"), "start_ms", "end_ms")


@query(
    "of2_merged_fragments",
    f"""WITH RECURSIVE {_R}, {_SHORT}, o AS (SELECT *, len(regexp_extract_all(text, '\\S+')) AS nw, row_number() OVER (PARTITION BY session_id ORDER BY position) AS i FROM short),
g AS (SELECT session_id, i, position AS into_, speaker_id, text, start_ms AS s, end_ms AS e, nw, end_ms, start_ms FROM o WHERE i = 1
UNION ALL SELECT session_id, i, CASE WHEN fits THEN into_ ELSE position END, speaker_id, text, CASE WHEN fits THEN s ELSE start_ms END, CASE WHEN fits THEN greatest(e, end_ms) ELSE end_ms END, CASE WHEN fits THEN nw0 + nw ELSE nw END, end_ms, start_ms
  FROM (SELECT o.*, g.into_, g.s, g.e, g.nw AS nw0, g.speaker_id = o.speaker_id AND g.nw > 0 AND o.nw > 0 AND o.start_ms - g.e <= 400 AND (g.nw < 3 OR g.e - g.s < 1000 OR o.nw < 3 OR o.end_ms - o.start_ms < 1000) AS fits FROM g JOIN o ON o.session_id = g.session_id AND o.i = g.i + 1))
SELECT session_id, into_ AS position, count(*) AS n_rows, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(text, ' ' ORDER BY i) AS text FROM g GROUP BY session_id, into_""",
)
def merged_fragments(spark, sf):
    return notes.merged_fragments(_short(spark, sf))


_TURNS = "turns AS (SELECT session_id, position, CASE (position // 3) % 2 WHEN 0 THEN 'PATIENT' ELSE 'DOCTOR' END AS role, text FROM rows)"


@query(
    "of4_source_units",
    f"""WITH RECURSIVE {_R}, {_TURNS}, o AS (SELECT *, regexp_matches(rtrim(text, ' '), '[.!?]$') AS ends, row_number() OVER (PARTITION BY session_id ORDER BY position) AS i FROM turns),
g AS (SELECT session_id, position, i, role, ends, length(text) AS chars, CAST(0 AS BIGINT) AS unit FROM o WHERE i = 1
UNION ALL SELECT session_id, position, i, role, ends, CASE WHEN fresh THEN 0 ELSE chars0 END + length(text), unit0 + CASE WHEN fresh THEN 1 ELSE 0 END FROM (SELECT o.*, g.chars AS chars0, g.unit AS unit0, g.role <> o.role OR (g.chars > 700 AND g.ends) AS fresh FROM g JOIN o ON o.session_id = g.session_id AND o.i = g.i + 1))
SELECT session_id, position, unit FROM g""",
)
def source_units(spark, sf):
    role = F.when(F.expr("position div 3") % 2 == 0, "PATIENT").otherwise("DOCTOR")
    return notes.source_units(transcript(spark, sf).withColumn("role", role))


@query("of5_grouped_assignments", f"WITH {_R}, {WORDS_SQL}, k AS (SELECT *, 'slot' || ((i // 4 + position) % 2) AS key, row_number() OVER (PARTITION BY session_id ORDER BY position, i) AS at_ FROM words), f AS (SELECT *, CASE WHEN lag(key) OVER w = key THEN 0 ELSE 1 END AS fresh FROM k WINDOW w AS (PARTITION BY session_id ORDER BY at_)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY at_) AS run FROM f) SELECT session_id, CAST(run AS BIGINT) AS run, key, count(*) AS n_words, min(w_start) AS start_ms, max(w_end) AS end_ms, string_agg(word, ' ' ORDER BY at_) AS text FROM g GROUP BY session_id, run, key")
def grouped(spark, sf):
    key = F.concat(F.lit("slot"), (F.expr("i div 4") + F.col("position")) % 2)
    return notes.grouped_assignments(timed_words(transcript(spark, sf)), key, ["position", "i"])


_WIN = "win AS (SELECT session_id, ordinal, lag(ref_end, 1, 0) OVER (PARTITION BY session_id ORDER BY ordinal) AS from_ms, ref_end AS until_ms FROM refs), ew AS (SELECT r.session_id, r.segment_id, min(w.ordinal) AS window_index FROM rows r LEFT JOIN win w ON w.session_id = r.session_id AND w.from_ms < r.end_ms AND r.end_ms <= w.until_ms GROUP BY ALL)"


@query("of11_row_diagnostics", f"WITH {_R}, {_BEST}, {_WIN} SELECT segment_id, expected_role, role = expected_role AS correct, coalesce(role IN ('DOCTOR', 'PATIENT') AND role <> expected_role, false) AS confidently_wrong, window_index, window_index IS NOT NULL AND row_number() OVER (PARTITION BY j.session_id, window_index ORDER BY position) = 1 AS first_in_window FROM judged j JOIN ew USING (segment_id)")
def row_diagnostics(spark, sf):
    rows, refs = transcript(spark, sf), reference(spark, sf)
    return notes.row_diagnostics(intervals.expected_roles(rows, refs), attribution.emission_window(rows, attribution.emission_windows(refs)))


@query("of16_duplicate_starts", f"WITH {_R}, g AS (SELECT session_id, speaker_id, start_ms // 20000 * 20000 AS start_ms, count(*) AS n, count(*) FILTER (position % 2 = 1) AS f FROM rows GROUP BY ALL HAVING count(*) > 1) SELECT session_id, count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows_in_groups, CAST(sum(f) AS BIGINT) AS floor_rows, CAST(sum(n - f) AS BIGINT) AS real_rows, CAST(sum(n - 1) AS BIGINT) AS all_removable, CAST(sum(greatest(f - 1, 0)) AS BIGINT) AS floor_removable FROM g GROUP BY 1")
def duplicate_starts(spark, sf):
    # the driver's rows never start together, so their starts are put on a grid of 20 s first
    rows = transcript(spark, sf).withColumn("start_ms", F.expr("start_ms div 20000 * 20000"))
    return notes.duplicate_starts(rows, F.col("position") % 2 == 1)


_VISIBLE = "CASE position % 4 WHEN 0 THEN [] WHEN 1 THEN ['DOCTOR'] WHEN 2 THEN ['DOCTOR', 'PATIENT'] ELSE ['PATIENT'] END"
_STATE = "CASE WHEN expected_role IS NULL OR len({0}) <> 1 THEN 'unresolved' WHEN list_contains({0}, expected_role) THEN 'correct' ELSE 'wrong' END"


@query(
    "of17_fold_classes",
    f"""WITH {_R}, {_BEST}, v AS (SELECT *, {_VISIBLE} AS seen, [role] AS after_ FROM judged), s AS (SELECT *, {_STATE.format('seen')} AS before_, {_STATE.format('after_')} AS now_ FROM v),
k AS (SELECT *, CASE before_ WHEN 'wrong' THEN 0 WHEN 'unresolved' THEN 1 ELSE 2 END AS a, CASE now_ WHEN 'wrong' THEN 0 WHEN 'unresolved' THEN 1 ELSE 2 END AS b FROM s)
SELECT segment_id, CASE WHEN expected_role IS NULL OR len(seen) = 0 THEN 'unresolved_fold' WHEN list_contains(seen, expected_role) THEN 'benign_same_role_fold' ELSE 'harmful_cross_speaker_fold' END AS class, CASE WHEN b > a THEN 'improved' WHEN b < a THEN 'worsened' ELSE 'unchanged_' || now_ END AS change FROM k""",
)
def fold_classes(spark, sf):
    visible = F.expr("CASE position % 4 WHEN 0 THEN cast(array() AS array<string>) WHEN 1 THEN array('DOCTOR') WHEN 2 THEN array('DOCTOR', 'PATIENT') ELSE array('PATIENT') END")
    judged = intervals.expected_roles(transcript(spark, sf), reference(spark, sf)).withColumn("seen", visible)
    expected = F.col("expected_role")
    before, after = notes.attribution_state(expected, F.col("seen")), notes.attribution_state(expected, F.array("role"))
    return judged.select("segment_id", notes.fold_class(expected, F.col("seen")).alias("class"), notes.state_change(before, after).alias("change"))


@query("of22_flow", f"WITH {_R}, b AS (SELECT segment_id, start_ms, end_ms, lag(end_ms) OVER (PARTITION BY session_id ORDER BY position) AS p FROM rows) SELECT segment_id, CASE WHEN start_ms - p > 3000 THEN 'gap' WHEN start_ms - p < -150 THEN 'overlap' END AS kind, CAST(CASE WHEN start_ms - p > 3000 THEN start_ms - p WHEN start_ms - p < -150 THEN greatest(least(p, end_ms) - start_ms, 0) ELSE 0 END AS BIGINT) AS ms FROM b")
def flow(spark, sf):
    return notes.flow(transcript(spark, sf))


_MAPS = "CASE WHEN (position * 5 + session_id) % 3 = 0 THEN 'PATIENT' ELSE 'DOCTOR' END AS r0, CASE WHEN position % 4 = 3 THEN 'UNKNOWN' WHEN (position * 5 + session_id) % 3 = 0 THEN 'DOCTOR' ELSE 'PATIENT' END AS r1"


@query("of23_label_flips", f"WITH {_R}, m AS (SELECT session_id, position, {_MAPS} FROM rows), l AS (SELECT *, lag(r0) OVER w AS p0, lag(r1) OVER w AS p1 FROM m WINDOW w AS (PARTITION BY session_id ORDER BY position)) SELECT session_id, count(*) FILTER (r0 <> p0 AND r1 <> p1 AND list_sort([r0, r1]) = list_sort([p0, p1])) AS flips FROM l GROUP BY 1")
def label_flips(spark, sf):
    r0, r1 = (e.split(" AS r")[0] for e in _MAPS.split(", CASE WHEN position"))
    maps = F.create_map(F.lit("spk_0"), F.expr(r0), F.lit("spk_1"), F.expr("CASE WHEN position" + r1))
    return notes.label_flips(transcript(spark, sf).select("session_id", "position", maps.alias("mapping")))


@query("oh9_term_recall", f"WITH {_R}, t AS (SELECT DISTINCT session_id, role, unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS term FROM rows), f AS (SELECT DISTINCT session_id, term FROM t WHERE role = 'PATIENT' AND list_contains({_TERM_LIST}, term)), s AS (SELECT DISTINCT session_id, term, 1 AS hit FROM t WHERE role = 'DOCTOR') SELECT session_id, count(*) AS terms, count(hit) AS found, round(count(hit) / count(*), 6) AS recall FROM f LEFT JOIN s USING (session_id, term) GROUP BY 1")
def term_recall(spark, sf):
    rows = transcript(spark, sf)
    return notes.term_recall(rows.where("role = 'PATIENT'"), rows.where("role = 'DOCTOR'"), _TERMS)


@query("oh10_critical_terms", f"WITH {_R}, p AS (SELECT b.session_id, b.ordinal, b.ref_role, b.ref_text, a.role, a.text FROM refs b LEFT JOIN rows a ON a.session_id = b.session_id AND a.start_ms < b.ref_end AND b.ref_start < a.end_ms), t AS (SELECT *, unnest(list_filter({_TERM_LIST}, lambda w: list_contains(regexp_extract_all(lower(ref_text), '[a-z'']+'), w))) AS term FROM p), s AS (SELECT *, coalesce(list_contains(regexp_extract_all(lower(text), '[a-z'']+'), term), false) AS said FROM t) SELECT session_id, ordinal, term, CASE WHEN bool_or(said AND role = ref_role) THEN 'supported' WHEN bool_or(said) THEN 'wrong_speaker' ELSE 'omitted' END AS outcome FROM s GROUP BY ALL")
def critical_terms(spark, sf):
    rows, refs = transcript(spark, sf), reference(spark, sf)
    pairs = intervals.overlap_join(refs.select("session_id", "ordinal", "ref_role", "ref_start", "ref_end"), rows.select("session_id", "role", "text", "start_ms", "end_ms"), ["session_id"], "ref_start", "ref_end", "start_ms", "end_ms")
    said = pairs.select("session_id", "ordinal", "role", "text")
    return notes.critical_terms(refs.select("session_id", "ordinal", "ref_role", "ref_text").join(said, ["session_id", "ordinal"], "left"), _TERMS)


_D = "(CASE WHEN contains(lower(text), 'the ') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'und ') THEN 1 ELSE 0 END)"
_P = "(CASE WHEN contains(lower(text), 'que ') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'die ') THEN 1 ELSE 0 END)"


@query("oh12_representatives", f"WITH {_R}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id, speaker_id ORDER BY {_D} + {_P} DESC, start_ms DESC, position DESC) <= 2 AS a, row_number() OVER (PARTITION BY session_id, speaker_id ORDER BY position DESC) <= 3 AS b FROM rows) SELECT session_id, speaker_id, segment_id, CASE WHEN a AND b THEN 'strong+recent' WHEN a THEN 'strong' ELSE 'recent' END AS why FROM n WHERE a OR b")
def representatives(spark, sf):
    from parlance.operators.rules import cue_count

    strength = cue_count(F.col("text"), ["the ", "und "]) + cue_count(F.col("text"), ["que ", "die "])
    return notes.representatives(transcript(spark, sf), strength)


@query("oh13_establishment_hint", f"WITH {_R}, f AS (SELECT *, 'spk_' || (position % 2) AS who, row_number() OVER (PARTITION BY session_id, position % 2 ORDER BY position) AS n FROM rows), m AS (SELECT session_id, who, sum({_D} - {_P}) AS margin, min(position) AS seen FROM f WHERE n <= 3 GROUP BY ALL), b AS (SELECT session_id, count(*) AS n, arg_max(who, margin * 1000 - seen) AS doctor, max(margin) AS dm, arg_max(who, -margin * 1000 - seen) AS patient, max(-margin) AS pm FROM m GROUP BY 1) SELECT session_id, doctor, patient FROM b WHERE n = 2 AND dm > 0 AND pm > 0 AND doctor <> patient")
def hint(spark, sf):
    from parlance.operators.rules import cue_count

    rows = transcript(spark, sf).withColumn("speaker_id", F.concat(F.lit("spk_"), F.col("position") % 2))
    return notes.establishment_hint(rows, cue_count(F.col("text"), ["the ", "und "]), cue_count(F.col("text"), ["que ", "die "]))


@query(
    "oj5_keyword_roles",
    f"""WITH {_R}, t AS (SELECT session_id, speaker_id, min(position) AS first_, sum(DISTINCT 0) + max(CASE WHEN contains(lower(text), 'the ') THEN 1 ELSE 0 END) + max(CASE WHEN contains(lower(text), 'und ') THEN 1 ELSE 0 END) AS d, max(CASE WHEN contains(lower(text), 'que ') THEN 1 ELSE 0 END) + max(CASE WHEN contains(lower(text), 'die ') THEN 1 ELSE 0 END) AS p FROM rows GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN d > p THEN 'DOCTOR' WHEN p > d THEN 'PATIENT' END AS role FROM t),
n AS (SELECT *, coalesce(bool_or(role = 'DOCTOR') OVER (PARTITION BY session_id), false) AS hd, coalesce(bool_or(role = 'PATIENT') OVER (PARTITION BY session_id), false) AS hp, row_number() OVER (PARTITION BY session_id, role IS NULL ORDER BY first_) AS k FROM r)
SELECT session_id, speaker_id, coalesce(role, CASE WHEN NOT hd AND NOT hp THEN CASE k WHEN 1 THEN 'DOCTOR' WHEN 2 THEN 'PATIENT' END WHEN NOT hd AND k = 1 THEN 'DOCTOR' WHEN NOT hp AND k = 1 THEN 'PATIENT' END, 'UNKNOWN') AS role FROM n""",
)
def keyword_roles(spark, sf):
    return notes.keyword_roles(transcript(spark, sf), ["the ", "und "], ["que ", "die "])


@query("oj10_dispositions", f"WITH {_R}, {_BEST} SELECT segment_id, CASE WHEN expected_role IS NULL THEN 'reference_gap' WHEN role = expected_role THEN 'truth_aligned_heuristic_false_positive' WHEN role IN ('DOCTOR', 'PATIENT') THEN 'baseline_confirmed_role_error' ELSE 'unscored' END AS disposition FROM judged")
def dispositions(spark, sf):
    rows, refs = transcript(spark, sf), reference(spark, sf)
    return notes.disposition(notes.row_diagnostics(intervals.expected_roles(rows, refs), attribution.emission_window(rows, attribution.emission_windows(refs))))


@query("oj11_exact_inverse", f"WITH {_R}, m AS (SELECT session_id, position, {_MAPS} FROM rows) SELECT session_id, position, r0 = 'PATIENT' AND r1 = 'DOCTOR' AS inverse FROM m")
def inverse(spark, sf):
    r0, r1 = (e.split(" AS r")[0] for e in _MAPS.split(", CASE WHEN position"))
    maps = F.create_map(F.lit("spk_0"), F.expr(r0), F.lit("spk_1"), F.expr("CASE WHEN position" + r1))
    current = F.create_map(F.lit("spk_0"), F.lit("DOCTOR"), F.lit("spk_1"), F.lit("PATIENT"))
    return transcript(spark, sf).select("session_id", "position", notes.exact_inverse(maps, current).alias("inverse"))


@query("ok1_sentences", f"WITH {_R}, s AS (SELECT segment_id, unnest(string_split(regexp_replace(regexp_replace(text, '[\"''‘“”]', '', 'g'), '([.!?])\\s+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1))) AS sentence FROM rows) SELECT segment_id, count(*) AS n, CAST(sum(length(trim(sentence))) AS BIGINT) AS chars, min(trim(sentence)) AS first FROM s WHERE trim(sentence) <> '' GROUP BY 1")
def sentences(spark, sf):
    text = F.regexp_replace("text", "[\"'‘“”]", "")
    each = transcript(spark, sf).select("segment_id", F.explode(notes.sentences(text)).alias("s"))
    return each.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("s")).alias("chars"), F.min("s").alias("first"))


_HEDGES = ["in", "que"]
_HAS = "len(list_intersect(regexp_extract_all(lower({0}), '[a-z'']+'), {1})) > 0"


@query("ok3_answered_uncertainty", f"WITH {_R}, a AS (SELECT *, {_HAS.format('text', ['in', 'que'])} AS h, position % 2 = 0 AS asks FROM rows), b AS (SELECT *, coalesce(lead(h, 1) OVER w, false) OR coalesce(lead(h, 2) OVER w, false) AS hedged FROM a WINDOW w AS (PARTITION BY session_id ORDER BY position)) SELECT segment_id, hedged FROM b WHERE asks OR trim(text, ' ') LIKE '%?'")
def uncertainty(spark, sf):
    rows = transcript(spark, sf)
    return notes.answered_uncertainty(rows.withColumn("text", F.when(F.col("position") % 2 == 0, F.concat("text", F.lit(" ?"))).otherwise(F.col("text"))), _HEDGES)


_EXAM = {"exam": "(^| )(in|the|la) [^.;]*(of|die|que)( |[.,]|$)", "performed": "(^| )(under|queles|at)( |[.,])", "intent": "(^| )(for|para)( |[.,])", "absent": "(^| )(with|des)( |[.,])", "presupposed": "(^| )(on|der)( |[.,])"}
_SAYS = {k: f"regexp_matches(lower(text), '{v}')" for k, v in _EXAM.items()}


@query(
    "ok5_exam_claims",
    f"""WITH {_R}, done AS (SELECT DISTINCT session_id FROM rows WHERE role = 'DOCTOR' AND {_SAYS["performed"]}),
c AS (SELECT session_id, segment_id AS claim_id, CASE WHEN {_SAYS["intent"]} THEN NULL WHEN {_SAYS["presupposed"]} THEN 'exam-presupposed-without-performance' WHEN {_SAYS["absent"]} THEN NULL WHEN {_SAYS["exam"]} THEN 'exam-claim-without-performance' END AS subtype FROM rows)
SELECT * FROM c WHERE subtype IS NOT NULL AND session_id NOT IN (SELECT session_id FROM done)""",
)
def exams(spark, sf):
    rows = transcript(spark, sf)
    return notes.needs_exam(rows.select("session_id", F.col("segment_id").alias("claim_id"), F.col("text").alias("claim")), rows, **_EXAM)


_QUOTES = "quotes AS (SELECT session_id, segment_id AS claim_id, CASE WHEN position % 3 = 0 THEN 'DOCTOR' ELSE 'PATIENT' END AS role, array_to_string(list_slice(regexp_extract_all(lower(p), '[a-z'']+'), 2, 4), ' ') AS quote FROM (SELECT *, coalesce(lag(text) OVER (PARTITION BY session_id ORDER BY position), '') AS p FROM rows) WHERE role = 'DOCTOR')"
_SUPPORT = f"support AS (SELECT DISTINCT q.session_id, q.claim_id, r.segment_id AS cited FROM quotes q JOIN rows r ON r.session_id = q.session_id AND r.role = q.role AND q.quote <> '' AND contains({_W.format('r.text')}, ' ' || q.quote || ' '))"


def _quotes(rows):
    from pyspark.sql import Window

    before = F.coalesce(F.lag("text").over(Window.partitionBy("session_id").orderBy("position")), F.lit(""))
    words = F.slice(F.regexp_extract_all(F.lower(before), F.lit("[a-z']+"), F.lit(0)), 2, 3)
    each = rows.withColumn("quote", F.array_join(words, " ")).where("role = 'DOCTOR'")
    return each.select("session_id", F.col("segment_id").alias("claim_id"), F.when(F.col("position") % 3 == 0, "DOCTOR").otherwise("PATIENT").alias("role"), "quote")


_WORDS_OF = "regexp_extract_all(lower({0}), '[a-z'']+')"
RUNS_SQL = f"""ws AS (SELECT session_id, position, role, {_WORDS_OF.format("text")} AS w FROM rows),
worded AS (SELECT *, row_number() OVER s AS n, sum(len(w)) OVER s AS upto FROM ws WHERE len(w) > 0 WINDOW s AS (PARTITION BY session_id ORDER BY position)),
gaps AS (SELECT *, n - lag(n) OVER o - 1 AS gap, upto - len(w) - lag(upto) OVER o AS between_ FROM worded WINDOW o AS (PARTITION BY session_id, role ORDER BY position)),
parts AS (SELECT *, sum(CASE WHEN gap > 1 OR gap = 1 AND between_ > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, role ORDER BY position) AS run FROM gaps),
runs AS (SELECT session_id, role, run, ' ' || string_agg(array_to_string(w, ' '), ' ' ORDER BY position) || ' ' AS said FROM parts GROUP BY ALL)"""


@query(
    "ok7_verbatim_quotes",
    f"""WITH {_R}, {RUNS_SQL}, near AS (SELECT *, coalesce({_WORDS_OF.format("lag(text) OVER w")}, []) AS w1, coalesce({_WORDS_OF.format("lag(text, 2) OVER w")}, []) AS w2, {_WORDS_OF.format("text")} AS w0 FROM rows WINDOW w AS (PARTITION BY session_id ORDER BY position)),
quotes AS (SELECT session_id, segment_id AS claim_id, CASE WHEN position % 4 = 1 AND position % 3 <> 0 THEN 'PATIENT' ELSE 'DOCTOR' END AS role, array_to_string(CASE WHEN position % 4 = 1 THEN w1[2:4] ELSE list_concat(w2[-2:], w0[:2]) END, ' ') AS quote FROM near WHERE role = 'DOCTOR')
SELECT session_id, claim_id, role, quote, quote <> '' AND EXISTS (SELECT 1 FROM runs r WHERE r.session_id = q.session_id AND r.role = q.role AND contains(r.said, ' ' || q.quote || ' ')) AS found FROM quotes q""",
)
def quotes(spark, sf):
    """Words of the row before, and the last words of the row two before with the first of this one."""
    from pyspark.sql import Window

    rows, w = transcript(spark, sf), Window.partitionBy("session_id").orderBy("position")
    words = lambda c: F.coalesce(F.regexp_extract_all(F.lower(c), F.lit("[a-z']+"), F.lit(0)), F.array().cast("array<string>"))
    near = rows.withColumns({"w1": words(F.lag("text").over(w)), "w2": words(F.lag("text", 2).over(w)), "w0": words("text")}).where("role = 'DOCTOR'")
    tail = F.slice("w2", F.greatest(F.lit(1), F.size("w2") - 1), F.lit(2))
    inner = F.col("position") % 4 == 1
    quote = F.when(inner, F.slice("w1", 2, 3)).otherwise(F.concat(tail, F.slice("w0", 1, 2)))
    role = F.when(inner & (F.col("position") % 3 != 0), "PATIENT").otherwise("DOCTOR")
    return notes.quotes_found(near.select("session_id", F.col("segment_id").alias("claim_id"), role.alias("role"), F.array_join(quote, " ").alias("quote")), rows)


@query("ok8_hedge_dropped", f"WITH {_R}, {_CITED} SELECT DISTINCT r.segment_id AS claim_id FROM rows r JOIN cited c ON c.claim_id = r.segment_id WHERE r.role = 'DOCTOR' AND NOT {_HAS.format('r.text', ['in', 'que'])} AND {_HAS.format('c.text', ['in', 'que'])}")
def hedge_dropped(spark, sf):
    rows = transcript(spark, sf)
    claims = rows.where("role = 'DOCTOR'").select(F.col("segment_id").alias("claim_id"), F.col("text").alias("claim"))
    return notes.hedge_dropped(claims, _cited(rows), _HEDGES)


@query("ok13_low_confidence", f"WITH {_R}, {_CITED}, b AS (SELECT c.claim_id, (c.position * 37 + c.session_id * 11) % 100 AS conf FROM cited c JOIN rows r ON r.segment_id = c.claim_id WHERE len(list_intersect(list_distinct(regexp_extract_all(lower(r.text), '[a-z'']+')), list_distinct(regexp_extract_all(lower(c.text), '[a-z'']+')))) >= 2) SELECT claim_id, count(*) AS measured, count(*) FILTER (conf < 78) AS low, 2 * count(*) FILTER (conf < 78) > count(*) AS review FROM b GROUP BY 1")
def low_confidence(spark, sf):
    rows = transcript(spark, sf)
    claims = rows.where("role = 'DOCTOR'").select(F.col("segment_id").alias("claim_id"), F.col("text").alias("claim"))
    return notes.low_confidence(claims, _cited(rows).withColumn("confidence", F.expr("(position * 37 + session_id * 11) % 100")))


@query(
    "ok14_claim_grounding",
    f"""WITH {_R}, {_QUOTES}, {_SUPPORT}, {_CITES}, u AS (SELECT s.session_id, s.claim_id, count(*) FILTER (s.cited IN (SELECT cited FROM cites c WHERE c.claim_id = s.claim_id)) AS hits FROM support s GROUP BY ALL),
l AS (SELECT c.session_id, claim_id, count(*) AS unresolved FROM cites c LEFT JOIN rows r ON r.segment_id = c.cited WHERE r.segment_id IS NULL GROUP BY ALL)
SELECT q.session_id, q.claim_id, CASE WHEN hits IS NULL THEN 'unsupported' WHEN hits = 0 THEN 'miscited' ELSE 'supported' END AS outcome, coalesce(unresolved, 0) AS unresolved FROM quotes q LEFT JOIN u USING (session_id, claim_id) LEFT JOIN l USING (session_id, claim_id)""",
)
def grounding(spark, sf):
    rows = transcript(spark, sf)
    return notes.grounding(_quotes(rows), rows, _cites(rows))


@query("ok15_missing_units", f"WITH {_R}, {_CITES} SELECT session_id, segment_id FROM rows WHERE role = 'PATIENT' AND segment_id NOT IN (SELECT cited FROM cites)")
def missing_units(spark, sf):
    rows = transcript(spark, sf)
    used = _cites(rows).select(F.col("cited").alias("segment_id")).distinct()
    return rows.where("role = 'PATIENT'").join(used, "segment_id", "left_anti").select("session_id", "segment_id")


@query("ok17_best_drafts", f"WITH {_R} SELECT session_id, arg_min(position, {{'a': length(text) % 3, 'b': position * 7 % 5, 'c': position}}) AS draft FROM rows GROUP BY 1")
def drafts(spark, sf):
    rows = transcript(spark, sf)
    return notes.best_draft(rows.select("session_id", F.col("position").alias("draft"), (F.length("text") % 3).alias("violations"), (F.col("position") * 7 % 5).alias("uncited")))


@query("ox_op2_misplaced_terms", f"WITH {_R}, t AS (SELECT session_id, segment_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z'']+'))) AS term FROM rows WHERE role <> 'PATIENT') SELECT session_id, term, count(*) AS \"rows\" FROM t WHERE list_contains({_TERM_LIST}, term) GROUP BY 1, 2")
def misplaced(spark, sf):
    return notes.misplaced_terms(transcript(spark, sf), _TERMS, "PATIENT")


@query("ox_op3_preservation_defects", f"WITH {_R} SELECT segment_id, array_to_string(list_filter([CASE WHEN position % 3 = 1 AND length(text) > 0 THEN 'lexical_rewrite' END, CASE WHEN position % 4 = 2 AND role <> 'DOCTOR' THEN 'speaker_role_changed' END, CASE WHEN position % 5 = 3 THEN 'speaker_identity_changed' END], lambda x: x IS NOT NULL), ',') AS defects FROM rows")
def preservation(spark, sf):
    rows = transcript(spark, sf)
    source = F.when((F.col("position") % 3 == 1) & (F.length("text") > 0), F.concat("text", F.lit(" more"))).otherwise(F.col("text"))
    role = F.when(F.col("position") % 4 == 2, "doctor").when(F.col("position") % 4 == 1, F.col("role"))
    speaker = F.when(F.col("position") % 5 == 3, "other").otherwise(F.col("speaker_id"))
    return rows.select("segment_id", F.array_join(notes.preservation_defects(F.col("text"), F.col("role"), F.col("speaker_id"), source, role, speaker), ",").alias("defects"))


@query(
    "ox_op27_review_reasons",
    f"""WITH {_R}, {_CITED}, w AS (SELECT segment_id, list_distinct(regexp_extract_all(lower(text), '[a-z'']+')) AS ws FROM rows),
b AS (SELECT c.claim_id, c.cited, w.ws, (c.position * 37 + c.session_id * 11) % 100 AS conf FROM cited c JOIN w ON w.segment_id = c.claim_id WHERE len(list_intersect(w.ws, list_distinct(regexp_extract_all(lower(c.text), '[a-z'']+')))) >= 2),
f AS (SELECT claim_id FROM b GROUP BY 1 HAVING 2 * count(*) FILTER (conf < 78) > count(*))
SELECT claim_id, array_to_string(list_sort(list_intersect(any_value(ws), ['sch', 'une', 'ing', 'ción', 'the', 'una', 'ung'])), ',') AS terms, string_agg(DISTINCT cited, ',' ORDER BY cited) AS segment_ids
FROM b JOIN f USING (claim_id) WHERE conf < 78 GROUP BY claim_id HAVING len(list_intersect(any_value(ws), ['sch', 'une', 'ing', 'ción', 'the', 'una', 'ung'])) > 0""",
)
def review_reasons(spark, sf):
    rows = transcript(spark, sf)
    claims = rows.where("role = 'DOCTOR'").select(F.col("segment_id").alias("claim_id"), F.col("text").alias("claim"))
    found = notes.review_reasons(claims, _cited(rows).withColumn("confidence", F.expr("(position * 37 + session_id * 11) % 100")), ["sch", "une", "ing", "ción", "the", "una", "ung"])
    return found.select("claim_id", F.array_join("terms", ",").alias("terms"), F.array_join("segment_ids", ",").alias("segment_ids"))
