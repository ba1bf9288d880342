"""The query of the violation finder: the doctor's rows as notes of their session."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import fidelity, notes
from parlance.plans.note_queries import RUNS_SQL
from parlance.plans.registry import query
from parlance.sources.adapt import ROWS_SQL, transcript

_TOPICS = {"north": ["ntion", "enheit"], "west": ["quela", "the"], "south": ["ereau", "ung"], "east": ["cion", "zu"]}
_RULES = fidelity.Rules(
    topics=_TOPICS,
    characteristics={"onset": ("(^| )(is|die) ", "(^| )(in|it|le)( |[.,]|$)"), "course": ("(^| )(la|of) ", "(^| )(que|das|an)( |[.,]|$)")},
    uncertain="(^| )(on|mit|pour)( |[.,]|$)",
    preserved="(^| )(for|con)( |[.,]|$)",
    denial="(^| )(are|als|un|no)( |[.,]|$)",
    denied="(^| )(by|der|de)( |[.,]|$)",
    equivocal="(^| )(is|von|el)( |[.,]|$)",
    states={"worried": ("(^| )(was|ein) ", "(^| )(as|des)( |[.,]|$)"), "calm": ("(^| )(at|los) ", "(^| )(be|se)( |[.,]|$)")},
    exam={"exam": "(^| )(this|elle) [^.;]*(of|la)( |[.,]|$)", "performed": "(^| )(under|leche)( |[.,])", "intent": "(^| )(or|para)( |[.,])", "absent": "(^| )(with|sich)( |[.,])", "presupposed": "(^| )(dem|had)( |[.,])"},
    doctor_quote="(^| )(the|und|que) ",
    asserts="(^| )(ein|is|the|de) ",
    attributes="(^| )(and|den|la) ",
)


def _sql(r: fidelity.Rules) -> str:
    says = lambda text, p: f"coalesce(regexp_matches(lower({text}), '{p}'), false)"
    topics = lambda text: "list_filter([" + ", ".join(f"CASE WHEN {says(text, fidelity.stem_pattern(s))} THEN '{n}' END" for n, s in r.topics.items()) + "], lambda x: x IS NOT NULL)"
    values = " UNION ALL ".join(f"SELECT session_id, location, ordinal, sentence, own_words, '{n}' AS name, {says('sentence', r.asserts + v.removeprefix('(^| )'))} AS asserted, {says('sentence', r.attributes + v.removeprefix('(^| )'))} AS attributed FROM s WHERE {says('sentence', v)}" for n, (_, v) in r.characteristics.items())
    asked = " UNION ALL ".join(f"SELECT session_id, '{n}' AS name, answered_at FROM unsure WHERE {says('text', q)}" for n, (q, _) in r.characteristics.items())
    states = " UNION ALL ".join(f"SELECT session_id, location, ordinal, 'patient-state-without-evidence', '{n}', NULL FROM s WHERE {says('sentence', c)} AND session_id NOT IN (SELECT session_id FROM rows_q WHERE role = 'PATIENT' AND {says('text', e)})" for n, (c, e) in r.states.items())
    x = {k: says("sentence", v) for k, v in r.exam.items()}
    runs = RUNS_SQL.replace("FROM rows)", "FROM rows_q)")  # quoted words are looked up in the rows as they are judged
    return f"""WITH {ROWS_SQL},
rows_q AS (SELECT session_id, position, segment_id, role, CASE WHEN position % 4 = 1 THEN text || ' ?' WHEN position % 4 = 2 AND session_id % 2 = 0 THEN 'un ' || text[:8] ELSE text END AS text FROM rows), {runs},
split AS (SELECT session_id, segment_id AS location, string_split(regexp_replace(regexp_replace(text, '["''‘“”]', '', 'g'), '([.!?])\\s+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS ss FROM rows WHERE role = 'DOCTOR'),
cut AS (SELECT session_id, location, generate_subscripts(ss, 1) - 1 AS ordinal, trim(unnest(ss)) AS plain FROM split),
marked AS (SELECT session_id, location, ordinal, plain, array_to_string(regexp_extract_all(lower(plain), '[a-z'']+')[2:3], ' ') AS quote FROM cut WHERE plain <> ''),
q AS (SELECT *, CASE WHEN ordinal % 3 = 0 AND quote <> '' THEN plain || ' "' || quote || '"' ELSE plain END AS sentence, ordinal % 3 = 0 AND quote <> '' AS quoted FROM marked),
f AS (SELECT *, CASE WHEN {says("sentence", r.doctor_quote)} THEN 'DOCTOR' ELSE 'PATIENT' END AS speaker FROM q),
s0 AS (SELECT *, quoted AND EXISTS (SELECT 1 FROM runs u WHERE u.session_id = f.session_id AND u.role = speaker AND contains(u.said, ' ' || quote || ' ')) AS found FROM f),
s AS (SELECT *, found AND speaker = 'PATIENT' AS own_words FROM s0),
unsure AS (SELECT session_id, text, least(CASE WHEN {{1}} THEN p1 END, CASE WHEN {{2}} THEN p2 END) AS answered_at FROM (SELECT session_id, role, text, lead(position) OVER w AS p1, lead(role) OVER w AS r1, lead(text) OVER w AS t1, lead(position, 2) OVER w AS p2, lead(role, 2) OVER w AS r2, lead(text, 2) OVER w AS t2 FROM rows_q WINDOW w AS (PARTITION BY session_id ORDER BY position)) WHERE role = 'DOCTOR'),
open_ AS (SELECT session_id, name, min(answered_at) AS answered_at FROM ({asked}) WHERE answered_at IS NOT NULL GROUP BY 1, 2),
told AS (SELECT v.*, o.answered_at, CASE WHEN asserted THEN 'resolved-to-definitive' WHEN attributed THEN 'invented-attribution' WHEN NOT ({says("sentence", r.preserved)} OR own_words) THEN 'uncertainty-not-preserved' END AS subtype FROM ({values}) v JOIN open_ o USING (session_id, name)),
around AS (SELECT *, coalesce(string_agg(CASE WHEN role = 'DOCTOR' THEN text END, ' ') OVER (PARTITION BY session_id ORDER BY position ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), '') AS asked,
  coalesce(bool_or(role = 'DOCTOR' AND contains(text, '?')) OVER (PARTITION BY session_id ORDER BY position ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), false) AS question FROM rows_q),
own AS (SELECT * FROM around WHERE role = 'PATIENT'),
clauses AS (SELECT session_id, position, unnest(regexp_split_to_array(text, '[.!?;,]')) AS clause FROM own),
facts AS (SELECT session_id, unnest({topics("clause")}) AS topic, position AS denied_at, NULL AS hedged_at FROM clauses WHERE {says("clause", r.denial)}
  UNION ALL SELECT session_id, unnest({topics("asked")}), position, NULL FROM own WHERE len(regexp_extract_all(lower(text), '[a-z'']+')) <= 3 AND {says("text", r.denial)}
  UNION ALL SELECT session_id, unnest({topics("text")}), NULL, position FROM own WHERE question AND {says("text", r.equivocal)}),
idx AS (SELECT session_id, topic, min(denied_at) AS denied_at, min(hedged_at) AS hedged_at FROM facts GROUP BY 1, 2),
neg AS (SELECT n.*, idx.denied_at, idx.hedged_at FROM (SELECT *, unnest({topics("sentence")}) AS topic FROM s WHERE {says("sentence", r.denied)}) n LEFT JOIN idx USING (session_id, topic)),
found AS (SELECT DISTINCT * FROM (SELECT session_id, location, ordinal, 'uncertainty-resolved' AS rule, subtype, answered_at AS "row" FROM told WHERE subtype IS NOT NULL
  UNION ALL SELECT session_id, location, ordinal, 'negative-without-denial', topic, NULL FROM neg WHERE denied_at IS NULL AND hedged_at IS NULL
  UNION ALL SELECT * FROM (SELECT session_id, location, ordinal, 'exam-not-performed', CASE WHEN {x["intent"]} THEN NULL WHEN {x["presupposed"]} THEN 'exam-presupposed-without-performance' WHEN {x["absent"]} THEN NULL WHEN {x["exam"]} THEN 'exam-claim-without-performance' END AS k, NULL FROM s
    WHERE session_id NOT IN (SELECT session_id FROM rows_q WHERE role = 'DOCTOR' AND {says("text", r.exam["performed"])})) WHERE k IS NOT NULL
  UNION ALL {states}
  UNION ALL SELECT session_id, location, ordinal, 'non-verbatim-quote', 'not-verbatim', NULL FROM s WHERE quoted AND NOT found)),
hedged AS (SELECT session_id, location, ordinal, min(hedged_at) AS hedged_at FROM neg WHERE hedged_at IS NOT NULL AND NOT {says("sentence", r.preserved)} AND NOT own_words GROUP BY 1, 2, 3)
SELECT * FROM found UNION ALL SELECT session_id, location, ordinal, 'uncertainty-resolved', 'hedge-dropped', hedged_at FROM hedged h ANTI JOIN found USING (session_id, location, ordinal)""".replace("{1}", f"r1 = 'PATIENT' AND {says('t1', r.uncertain)}").replace("{2}", f"r2 = 'PATIENT' AND {says('t2', r.uncertain)}")


@query("ok2_violations", _sql(_RULES))
def violations(spark, sf):
    """Sentences of the doctor's rows, some with quoted words; in some rows questions and short answers stand."""
    rows, at = transcript(spark, sf), F.col("position") % 4
    text = F.when(at == 1, F.concat("text", F.lit(" ?"))).when((at == 2) & (F.col("session_id") % 2 == 0), F.concat(F.lit("un "), F.left("text", F.lit(8)))).otherwise(F.col("text"))
    plain = rows.where("role = 'DOCTOR'").select("session_id", F.col("segment_id").alias("location"), F.posexplode(notes.sentences(F.regexp_replace("text", "[\"'‘“”]", ""))).alias("ordinal", "sentence"))
    plain = plain.select("session_id", "location", F.col("ordinal").cast("long"), "sentence")
    quote = F.array_join(F.slice(F.regexp_extract_all(F.lower("sentence"), F.lit("[a-z']+"), F.lit(0)), 2, 2), " ")
    marked = plain.withColumn("sentence", F.when((F.col("ordinal") % 3 == 0) & (quote != ""), F.concat("sentence", F.lit(' "'), quote, F.lit('"'))).otherwise(F.col("sentence")))
    return fidelity.violations(marked, rows.withColumn("text", text), _RULES)
