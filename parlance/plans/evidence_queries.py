"""Queries of evidence for claims and findings by cues."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions.text import score_tokens
from parlance.operators import evidence as E
from parlance.plans.registry import query
from parlance.sources.adapt import ROWS_SQL, transcript

_R = f"WITH {ROWS_SQL}"
_NO, _YES = ["und", "que", "les"], ["the", "de", "der"]
_list = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
_toks = lambda t: f"regexp_extract_all(lower({t}), '[a-z'']+')"
_has = lambda t, ws: f"list_has_any({_toks(t)}, {_list(ws)})"
_near = lambda a, z, t="text": f"coalesce(string_agg({t}, ' ') OVER (PARTITION BY session_id ORDER BY position ROWS BETWEEN {a} PRECEDING AND {z}), '')"
_CLAIMS = f"asked AS (SELECT DISTINCT session_id, segment_id AS claim_id, unnest([w for w in {_toks('text')} if length(w) > 5]) AS token FROM rows WHERE role = 'DOCTOR')"


def _claims(rows):
    """Claims of the doctor's rows on their longer words."""
    words = F.filter(score_tokens(F.col("text")), lambda w: F.length(w) > 5)
    return rows.where("role = 'DOCTOR'").select("session_id", F.col("segment_id").alias("claim_id"), words.alias("tokens"))


@query("ok9_superseded_states", f"{_R}, {_CLAIMS}, near AS (SELECT *, {_near(2, '2 FOLLOWING')} AS near FROM rows), said AS (SELECT DISTINCT session_id, position, unnest({_toks('text')}) AS token, {_has('near', _NO)} AS no, {_has('near', _YES)} AS yes FROM near), f AS (SELECT session_id, claim_id, min(position) FILTER (no) AS absent_at, max(position) FILTER (yes) AS affirmed_at FROM asked JOIN said USING (session_id, token) GROUP BY 1, 2) SELECT * FROM f WHERE affirmed_at > absent_at")
def superseded(spark, sf):
    rows = transcript(spark, sf)
    return E.superseded_states(_claims(rows), rows, _NO, _YES)


@query("ok10_unconfirmed_actions", f"{_R}, {_CLAIMS}, near AS (SELECT *, {_near(1, '1 FOLLOWING')} AS near FROM rows), said AS (SELECT DISTINCT session_id, position, unnest({_toks('text')}) AS token, {_has('near', _YES)} AS promised, {_has('text', ['und', 'que'])} AS done FROM near), f AS (SELECT session_id, claim_id, min(position) FILTER (promised) AS promised_at, bool_or(done) AS done FROM asked JOIN said USING (session_id, token) GROUP BY 1, 2) SELECT session_id, claim_id, promised_at FROM f WHERE promised_at IS NOT NULL AND NOT done")
def unconfirmed(spark, sf):
    rows = transcript(spark, sf)
    return E.unconfirmed_actions(_claims(rows), rows, _YES, ["und", "que"])


@query("ok10_unspoken_content", f"{_R}, {_CLAIMS}, said AS (SELECT DISTINCT session_id, unnest({_toks('text')}) AS token FROM rows WHERE role = 'PATIENT') SELECT session_id, claim_id, list_sort(list(DISTINCT token)) AS unspoken FROM asked ANTI JOIN said USING (session_id, token) GROUP BY 1, 2")
def unspoken(spark, sf):
    rows = transcript(spark, sf)
    return E.unspoken_content(_claims(rows), rows.where("role = 'PATIENT'"))


@query("ok4_undenied_topics", f"{_R}, {_CLAIMS}, r AS (SELECT session_id, position, role, CASE WHEN role = 'PATIENT' AND position % 4 = 2 THEN 'No.' ELSE text END AS text FROM rows), q AS (SELECT *, coalesce(string_agg(CASE WHEN role = 'DOCTOR' THEN text END, ' ') OVER (PARTITION BY session_id ORDER BY position ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), '') AS question FROM r), c AS (SELECT session_id, unnest(regexp_split_to_array(text, '[.!?;]')) AS clause FROM r WHERE role = 'PATIENT'), denied AS (SELECT session_id, unnest({_toks('clause')}) AS token FROM c WHERE {_has('clause', ['no', 'und', 'que'])} UNION SELECT session_id, unnest({_toks('question')}) FROM q WHERE role = 'PATIENT' AND len({_toks('text')}) <= 3 AND {_has('text', ['no', 'und', 'que'])}) SELECT session_id, claim_id, list_sort(list(DISTINCT token)) AS undenied FROM asked ANTI JOIN denied USING (session_id, token) GROUP BY 1, 2")
def undenied(spark, sf):
    rows = transcript(spark, sf)
    answers = rows.withColumn("text", F.when((F.col("role") == "PATIENT") & (F.col("position") % 4 == 2), "No.").otherwise(F.col("text")))
    return E.undenied_topics(_claims(rows), answers, ["no", "und", "que"])


@query("ok6_states_without_evidence", f"{_R}, {_CLAIMS}, o AS (SELECT *, sum(CASE WHEN role = 'PATIENT' THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY position) AS run, {_has('text', _NO)} AS st FROM rows), p AS (SELECT *, bool_or(st) OVER (PARTITION BY session_id, run) AS ok FROM o WHERE role = 'PATIENT'), proven AS (SELECT DISTINCT session_id, unnest({_toks('text')}) AS token FROM p WHERE ok) SELECT session_id, claim_id, list_sort(list(DISTINCT token)) AS missing FROM asked ANTI JOIN proven USING (session_id, token) GROUP BY 1, 2")
def states(spark, sf):
    rows = transcript(spark, sf)
    return E.states_without_evidence(_claims(rows), rows, _NO)


_NUM = "map {" + ", ".join(f"'{w}': {n}" for w, n in E.NUMBERS.items()) + "}"
_part = lambda p: f"coalesce(try_cast({p} AS INT), {_NUM}[{p}])"
_value = lambda i: f"(CASE WHEN len(g{i}) = 1 THEN {_part(f'g{i}[1]')} ELSE {_part(f'g{i}[len(g{i})]')} + coalesce({_part(f'g{i}[1]')}, 0) END)"


@query("ok11_altered_ranges", f"{_R}, r AS (SELECT session_id, position, CASE position % 3 WHEN 0 THEN 'for about twenty-one to' WHEN 1 THEN 'forty hours' ELSE '5 to 6 days' END AS text FROM rows), n AS (SELECT session_id, lower({_near(1, '1 FOLLOWING')}) AS near FROM r), p AS (SELECT session_id, unnest(regexp_extract_all(near, '{E.SPOKEN_RANGE}', 0)) AS phrase FROM n), g AS (SELECT session_id, regexp_split_to_array(regexp_extract(phrase, '{E.SPOKEN_RANGE}', 1), '[- ]') AS g1, regexp_split_to_array(regexp_extract(phrase, '{E.SPOKEN_RANGE}', 2), '[- ]') AS g2, regexp_extract(phrase, '{E.SPOKEN_RANGE}', 3) AS unit FROM p), s AS (SELECT DISTINCT session_id, {_value(1)} AS low, {_value(2)} AS high, unit FROM g), c AS (SELECT session_id, segment_id AS claim_id, CAST(CASE WHEN position % 2 = 0 THEN 21 ELSE 5 END AS INT) AS low, CAST(CASE WHEN position % 4 = 0 THEN 40 ELSE 6 END AS INT) AS high, CASE WHEN position % 2 = 0 THEN 'hour' ELSE 'day' END AS unit FROM rows) SELECT c.* FROM c WHERE EXISTS (SELECT 1 FROM s WHERE s.session_id = c.session_id AND s.unit = c.unit AND low IS NOT NULL AND high IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM s WHERE s.session_id = c.session_id AND s.unit = c.unit AND s.low = c.low AND s.high = c.high)")
def ranges(spark, sf):
    rows = transcript(spark, sf)
    text = F.when(F.col("position") % 3 == 0, "for about twenty-one to").when(F.col("position") % 3 == 1, "forty hours").otherwise("5 to 6 days")
    even = F.col("position") % 2 == 0
    claims = rows.select("session_id", F.col("segment_id").alias("claim_id"), F.when(even, 21).otherwise(5).alias("low"), F.when(F.col("position") % 4 == 0, 40).otherwise(6).alias("high"), F.when(even, "hour").otherwise("day").alias("unit"))
    return E.altered_ranges(claims, rows.withColumn("text", text))


_FOUND = f"r AS (SELECT session_id, position, role, CASE WHEN position % 3 = 2 THEN 'Yeah.' ELSE text END AS text FROM rows), e AS (SELECT *, {_has('text', _NO)} AS asks, {_has('text', _YES)} AS tells, array_to_string({_toks('text')}, ' ') IN ('yeah', 'no') AS short FROM r), l AS (SELECT *, coalesce(lag(role) OVER w = 'DOCTOR' AND lag(asks) OVER w, false) AS asked FROM e WINDOW w AS (PARTITION BY session_id ORDER BY position)), k AS (SELECT session_id, position, role, [x for x in [CASE WHEN role = 'PATIENT' AND asks THEN 'doctor_question_in_patient_row' END, CASE WHEN role = 'DOCTOR' AND tells THEN 'patient_statement_in_doctor_row' END, CASE WHEN asks AND tells THEN 'mixed_role_cues' END, CASE WHEN role = 'DOCTOR' AND short AND asked THEN 'patient_ack_after_doctor_question' END] if x IS NOT NULL] AS codes FROM l WHERE role <> 'UNKNOWN'), f AS (SELECT *, CASE WHEN codes = ['patient_ack_after_doctor_question'] THEN 'warning' ELSE 'error' END AS severity FROM k WHERE len(codes) > 0)"


@query("oj9_role_findings", f"{_R}, {_FOUND} SELECT * FROM f")
def findings(spark, sf):
    rows = transcript(spark, sf).withColumn("text", F.when(F.col("position") % 3 == 2, "Yeah.").otherwise(F.col("text")))
    return E.role_findings(rows, _NO, _YES, ["yeah", "no"])


@query("ox_op37_finding_totals", f"{_R}, {_FOUND} SELECT session_id, count(*) AS findings, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM f GROUP BY 1")
def totals(spark, sf):
    return E.finding_totals(findings(spark, sf))


@query("ox_op36_shared_cue_fragments", f"{_R}, e AS (SELECT session_id, position, CASE WHEN position % 2 = 0 THEN {_toks('text')}[1:3] ELSE {_toks('text')} END AS ws FROM rows), o AS (SELECT *, list_intersect(ws, {_list(_NO + _YES)}) AS own FROM e), s AS (SELECT session_id, position, len(ws) AS n, coalesce(list_has_any(own, lag(own) OVER w), false) AS before, coalesce(list_has_any(own, lead(own) OVER w), false) AS after FROM o WINDOW w AS (PARTITION BY session_id ORDER BY position)) SELECT session_id, position, before, after FROM s WHERE n <= 3 AND (before OR after)")
def fragments(spark, sf):
    words = score_tokens(F.col("text"))
    rows = transcript(spark, sf).withColumn("text", F.array_join(F.when(F.col("position") % 2 == 0, F.slice(words, 1, 3)).otherwise(words), " "))
    return E.shared_cue_fragments(rows, _NO + _YES)


_PARTS = [("stay", ["the"], ["und"]), ("call", ["und"], ["the"]), ("drive", ["que"], ["de"])]


@query("ox_op39_missing_components", f"{_R}, n AS (SELECT session_id, role, {_near(1, '1 FOLLOWING')} AS near FROM rows), s AS (SELECT session_id, " + ", ".join(f"bool_or({_has('near', said)}) AS s{i}" for i, (_, said, _) in enumerate(_PARTS)) + " FROM n WHERE role = 'DOCTOR' GROUP BY 1), t AS (SELECT session_id, " + ", ".join(f"bool_or({_has('text', wrote)}) AS n{i}" for i, (_, _, wrote) in enumerate(_PARTS)) + " FROM rows WHERE role = 'UNKNOWN' GROUP BY 1), m AS (SELECT session_id, [x for x in [" + ", ".join(f"CASE WHEN s{i} AND NOT coalesce(n{i}, false) THEN '{name}' END" for i, (name, _, _) in enumerate(_PARTS)) + "] if x IS NOT NULL] AS missing FROM s LEFT JOIN t USING (session_id)) SELECT * FROM m WHERE len(missing) > 0")
def components(spark, sf):
    rows = transcript(spark, sf)
    return E.missing_components(rows, rows.where("role = 'UNKNOWN'"), _PARTS)


_RULES = [("r1", "all", ["the", "und"]), ("r2", "any", ["que", "die"]), ("r3", "none", ["les", "und"]), ("r4", "together", ["the", "of"])]
_seen = lambda w: f"bool_or(list_contains({_toks('text')}, '{w}'))"
_MET = "met AS (" + " UNION ALL ".join(
    f"SELECT session_id, '{name}' AS rule, "
    + {"all": " AND ".join(map(_seen, ws)), "any": " OR ".join(map(_seen, ws)), "none": "NOT (" + " OR ".join(map(_seen, ws)) + ")", "together": f"bool_or(list_has_all({_toks('text')}, {_list(ws)}))"}[kind]
    + " AS met FROM rows GROUP BY 1"
    for name, kind, ws in _RULES
) + ")"


@query("ox_op24_expectations", f"{_R}, {_MET} SELECT * FROM met")
def expected(spark, sf):
    return E.expectations(transcript(spark, sf), _RULES)


@query("ox_op23_verdicts", f"{_R}, {_MET}, ok AS (SELECT DISTINCT session_id FROM rows WHERE role = 'DOCTOR'), a AS (SELECT session_id, count(*) FILTER (met) AS hit, count(*) AS n FROM met GROUP BY 1) SELECT a.session_id, CASE WHEN ok.session_id IS NULL THEN 'not_scorable_source' WHEN hit < n THEN 'fail' ELSE 'pass' END AS verdict, round(hit / n, 6) AS coverage FROM a LEFT JOIN ok ON ok.session_id = a.session_id")
def verdict(spark, sf):
    return E.verdicts(expected(spark, sf), transcript(spark, sf).where("role = 'DOCTOR'"))
