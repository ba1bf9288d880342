"""The query of the cue cleanup; its SQL walks through each session's rows by recursion."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import cues
from parlance.plans.log_queries import first_cue_sql, phrase_role_sql
from parlance.plans.registry import query
from parlance.sources.adapt import ROWS_SQL, transcript

_CUES = cues.Cues(
    doctor=("of the", "by", "die", "la", "on", "it"),
    patient=("the", "in", "zu", "que", "for", "un el"),
    questions=("the", "die", "la", "in"),
    answers=("in", "es be", "que", "le", "la"),
    weak=("on", "in", "la"),
    starts=("ein", "un", "it", "le", "es", "than"),
    fillers=("es", "ung"),
)


def _any(line: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({line}, ' {p} ')" for p in phrases) + ")"


def _names(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _cleanup_sql(c: cues.Cues) -> str:
    words = r"list_filter(list_transform(regexp_split_to_array(lower(trim({0})), '\s+'), lambda w: regexp_replace(w, '[^a-z0-9]', '', 'g')), lambda w: w <> '')"
    line = "' ' || array_to_string({0}, ' ') || ' '"
    strong = {"doctor": [p for p in c.doctor if p not in c.weak], "patient": [p for p in c.patient if p not in c.weak]}
    shares = lambda at: "(" + " OR ".join(f"contains({at}, ' {p} ') AND len(list_intersect(ow, {_names(p.split())})) > 0" for p in c.patient) + ")"
    role = lambda at: phrase_role_sql(at, c.doctor, c.patient)
    inferred = lambda b: f"""CASE WHEN fixed OR len(ow) = 0 THEN NULL WHEN direct IS NOT NULL THEN direct WHEN answers AND '{b}' = 'DOCTOR' THEN 'PATIENT' WHEN len(ow) > 3 THEN NULL
    WHEN '{b}' = 'DOCTOR' AND with_before = 'DOCTOR' THEN 'DOCTOR' WHEN role_after = 'DOCTOR' AND starts AND with_after = 'DOCTOR' THEN 'DOCTOR'
    WHEN '{b}' = 'PATIENT' AND with_before = 'PATIENT' AND shares_before THEN 'PATIENT' WHEN role_after = 'PATIENT' AND with_after = 'PATIENT' AND shares_after THEN 'PATIENT' END"""  # noqa: E731
    by = lambda kind, to: f"CASE {to} WHEN 'DOCTOR' THEN {kind}_doctor ELSE {kind}_patient END"
    outcomes = []
    for b in ("DOCTOR", "PATIENT", "OTHER"):
        to, s = f"to_{b}", f"(direct = to_{b} AND {by('own', f'to_{b}')})"
        outcomes += [f"coalesce(to_{b}, role) AS on_{b}", f"coalesce({to} <> role AND {s}, false) AS strong_{b}", f"CASE WHEN {s} OR (answers AND '{b}' = 'DOCTOR') OR {by('joined', to)} THEN coalesce({to}, role) ELSE role END AS off_{b}"]
    pick = lambda kind, before: f"CASE {before} WHEN 'DOCTOR' THEN r.{kind}_DOCTOR WHEN 'PATIENT' THEN r.{kind}_PATIENT ELSE r.{kind}_OTHER END"
    return f"""WITH RECURSIVE {ROWS_SQL},
a AS (SELECT session_id, position, segment_id, role, position % 7 = 5 AS fixed, row_number() OVER w AS n, lead(role) OVER w AS role_after,
  {words.format("text")} AS ow, {words.format("coalesce(lag(text) OVER w, '')")} AS bw, {words.format("coalesce(lead(text) OVER w, '')")} AS aw FROM rows WINDOW w AS (PARTITION BY session_id ORDER BY position)),
l AS (SELECT *, {line.format("ow")} AS own, {line.format("bw")} AS asked, {line.format("bw || ow")} AS backward, {line.format("ow || aw")} AS forward FROM a),
e AS (SELECT *, {role("own")} AS direct, {role("backward")} AS with_before, {role("forward")} AS with_after, trim(own) IN ({", ".join(f"'{x}'" for x in c.answers)}) AND {first_cue_sql("asked", c.questions)} IS NOT NULL AS answers,
  coalesce(list_contains({_names(c.starts)}, list_filter(ow, lambda x: NOT list_contains({_names(c.fillers)}, x))[1]), false) AS starts, {shares("backward")} AS shares_before, {shares("forward")} AS shares_after,
  {", ".join(f"{_any('own', v)} AS own_{k}, ({_any('backward', v)} OR {_any('forward', v)}) AS joined_{k}" for k, v in strong.items())} FROM l),
t AS (SELECT *, {", ".join(f"{inferred(b)} AS to_{b}" for b in ("DOCTOR", "PATIENT", "OTHER"))} FROM e),
o AS (SELECT session_id, position, segment_id, role, n, {", ".join(outcomes)} FROM t),
walk AS (SELECT session_id, n, segment_id, role, on_OTHER AS now_on, off_OTHER AS now_off, strong_OTHER AS strong FROM o WHERE n = 1
  UNION ALL SELECT r.session_id, r.n, r.segment_id, r.role, {pick("on", "walk.now_on")}, {pick("off", "walk.now_off")}, {pick("strong", "walk.now_on")} FROM walk JOIN o r ON r.session_id = walk.session_id AND r.n = walk.n + 1),
s AS (SELECT *, count(*) FILTER (strong) OVER (PARTITION BY session_id) AS n_strong FROM walk)
SELECT segment_id, CASE WHEN n_strong >= 3 THEN now_on ELSE now_off END AS role, CASE WHEN n_strong >= 3 THEN now_on ELSE now_off END <> role AS changed, n_strong AS strong FROM s"""


@query("oj8_cue_cleanup", _cleanup_sql(_CUES))
def cleaned_roles(spark, sf):
    rows = transcript(spark, sf).withColumn("fixed", F.col("position") % 7 == 5)
    return cues.cue_cleanup(rows, _CUES).select("segment_id", "role", "changed", "strong")
