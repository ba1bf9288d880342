"""Queries over log events, text rules and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import logs, rules
from parlance.plans.registry import query
from parlance.sources.adapt import LOGS_SQL, ROWS_SQL, log_events, table, transcript

_L = f"WITH {LOGS_SQL}"


@query("oi1_oi8_session_lines", f"{_L}, c AS (SELECT session_id, event, count(*) AS n, sum(k) AS t FROM logs GROUP BY ALL) SELECT session_id, CAST(sum(n) AS BIGINT) AS events, CAST(sum(t) AS BIGINT) AS total, string_agg(event || '=' || n, ',' ORDER BY event || '=' || n) AS mix FROM c GROUP BY 1")
def session_lines(spark, sf):
    return logs.session_lines(log_events(spark, sf), "event", "k")


@query("oi2_routed_metrics", f"{_L} SELECT session_id, 'cycles' AS metric, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM logs WHERE event = 'view' AND k IS NOT NULL GROUP BY 1 UNION ALL SELECT session_id, 'tokens', count(*), CAST(sum(2 * k) AS BIGINT) FROM logs WHERE event IN ('click', 'purchase') AND k IS NOT NULL GROUP BY 1")
def routed(spark, sf):
    routes = {"cycles": F.when(F.col("event") == "view", F.col("k")), "tokens": F.when(F.col("event").isin("click", "purchase"), 2 * F.col("k"))}
    return logs.routed_metrics(log_events(spark, sf), ["session_id"], routes)


@query("oi3_nearest_rank", f"{_L}, r AS (SELECT session_id, value, row_number() OVER (PARTITION BY session_id ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY session_id) AS n FROM logs WHERE value IS NOT NULL) SELECT session_id, value FROM r WHERE i = round_even(95 * (n - 1) / 100, 0)")
def nearest_rank(spark, sf):
    return logs.nearest_rank(log_events(spark, sf), ["session_id"], "value", 95)


@query("oi4_latency_record", f"{_L} SELECT event, count(value) AS \"count\", round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS \"max\" FROM logs GROUP BY 1")
def latency(spark, sf):
    return logs.latency_record(log_events(spark, sf), ["event"], "value")


@query("oi5_path_rates", f"{_L} SELECT event, count(*) AS events, round(count(*) FILTER (k = 0) / count(*), 6) AS fallback_rate, round(count(*) FILTER (k = 1) / count(*), 6) AS flip_rate, round(avg(CASE WHEN k > 1 THEN k END), 6) AS confidence FROM logs GROUP BY 1")
def paths(spark, sf):
    k = F.col("k")
    return logs.path_rates(log_events(spark, sf), ["event"], k == 0, k == 1, F.when(k > 1, k))


@query("oi6_outcomes", f"{_L} SELECT substr(event, 2) AS outcome, count(*) AS n, count(*) FILTER (k = 9) AS failures FROM logs WHERE starts_with(event, 'p') GROUP BY 1")
def outcomes(spark, sf):
    return logs.outcomes(log_events(spark, sf), F.col("event"), "p", F.col("k") == 9)


@query("oi9_report_totals", f"{_L} SELECT session_id, event, count(*) AS n, CAST(sum(k) AS BIGINT) AS total, CAST(grouping(session_id) + grouping(event) AS INT) AS level FROM logs GROUP BY ROLLUP (event, session_id)")
def totals(spark, sf):
    return logs.report_totals(log_events(spark, sf), "event", "session_id", "k")


_DECIDED = "CASE WHEN event = 'error' THEN 'failed' WHEN starts_with(event, 'p') THEN 'applied' ELSE 'kept' END"


@query("oi10_oi11_role_timeline", f"{_L}, d AS (SELECT *, {_DECIDED} AS decision, CASE WHEN k > 4 THEN 'map' || k ELSE '' END AS mapping FROM logs) SELECT session_id, count(*) FILTER (decision = 'applied') AS applied, count(*) FILTER (decision = 'kept') AS kept, count(*) FILTER (decision = 'failed') AS failed, arg_max(mapping, (ts, event_id)) FILTER (mapping <> '') AS last_mapping FROM d GROUP BY 1")
def timeline(spark, sf):
    decision = F.when(F.col("event") == "error", "failed").when(F.col("event").startswith("p"), "applied").otherwise("kept")
    mapping = F.when(F.col("k") > 4, F.concat(F.lit("map"), F.col("k"))).otherwise("")
    return logs.timeline_summary(log_events(spark, sf), decision, mapping, ["ts", "event_id"])


@query("oi12_reconciled", f"{_L}, a AS (SELECT session_id, count(*) AS counted FROM logs WHERE event = 'view' GROUP BY 1), b AS (SELECT session_id, count(*) AS recorded FROM logs WHERE event = 'click' GROUP BY 1) SELECT session_id, counted, recorded, coalesce(counted = recorded, false) AS agrees FROM a FULL JOIN b USING (session_id)")
def reconciled(spark, sf):
    n = lambda e: log_events(spark, sf).where(F.col("event") == e).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    return logs.reconciled(n("view"), n("click"), "session_id", "n")


@query("oi17_levels", "SELECT page_id, regexp_extract(url, '/([a-z]{2})/', 1) AS session, CASE WHEN page_id % 600 >= 500 THEN 'error' WHEN page_id % 600 >= 400 THEN 'warning' ELSE 'info' END AS level FROM pages")
def levels(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "/([a-z]{2})/", 1).alias("session"), logs.level_of(F.col("page_id") % 600).alias("level"))


@query("oj1_lexicon_rewrite", r"SELECT conv_id, turn, regexp_replace(regexp_replace(text, '\bD[iI][eE]\b', 'This', 'g'), '\bd[iI][eE]\b', 'this', 'g') AS text, len(regexp_extract_all(text, '(?i)\bdie\b')) AS found FROM (SELECT conv_id, turn, regexp_replace(text, '[^A-Za-z .]', 'x', 'g') AS text FROM conversations)")
def rewritten(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.regexp_replace("text", "[^A-Za-z .]", "x").alias("text"))
    text, found = rules.lexicon_rewrite(F.col("text"), [("this", ["die"])])
    return rows.select("conv_id", "turn", text.alias("text"), found.alias("found"))


_CUES = {"DOCTOR": ["the ", "und "], "PATIENT": ["que ", "die "]}
_D = "(CASE WHEN contains(lower(text), 'the ') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'und ') THEN 1 ELSE 0 END)"
_P = "(CASE WHEN contains(lower(text), 'que ') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'die ') THEN 1 ELSE 0 END)"


@query("oj2_oj6_row_exceptions", f"WITH {ROWS_SQL}, c AS (SELECT segment_id, {_D} AS own, {_P} AS other, len(regexp_extract_all(lower(text), '[a-z'']+')) AS n FROM rows) SELECT segment_id, CAST(own AS INT) AS own, CAST(other AS INT) AS other, CASE WHEN other > 0 AND own > 0 THEN 'uncertain' WHEN n >= 5 AND other >= 2 THEN 'flip' ELSE 'keep' END AS verdict FROM c")
def exceptions(spark, sf):
    own, other = (rules.cue_count(F.col("text"), _CUES[r]) for r in ("DOCTOR", "PATIENT"))
    rows = transcript(spark, sf).select("segment_id", own.alias("own"), other.alias("other"), F.size(T.score_tokens(F.col("text"))).alias("n"))
    return rows.select("segment_id", "own", "other", rules.row_exception(F.col("own"), F.col("other"), F.col("n")).alias("verdict"))


CUE_PHRASE_SQL = r"' ' || array_to_string(list_filter(list_transform(regexp_split_to_array(lower(trim({0})), '\s+'), lambda w: regexp_replace(w, '[^a-z0-9]', '', 'g')), lambda w: w <> ''), ' ') || ' '"


def first_cue_sql(phrase: str, cues: list[str]) -> str:
    """Place of the first cue in a phrase; null without one."""
    return "least(" + ", ".join(f"nullif(instr({phrase}, ' {c} '), 0)" for c in cues) + ")"


def phrase_role_sql(phrase: str, doctor: list[str], patient: list[str]) -> str:
    d, p = first_cue_sql(phrase, doctor), first_cue_sql(phrase, patient)
    return f"CASE WHEN {d} IS NULL AND {p} IS NULL THEN NULL WHEN {p} IS NULL OR {d} <= {p} THEN 'DOCTOR' ELSE 'PATIENT' END"


_DOC, _PAT = ["the", "und", "la"], ["que", "in die", "of"]
_JOINED = {"own": "text", "backward": "before || ' ' || text", "forward": "text || ' ' || after"}


@query(
    "oj4_oj7_orphan_roles",
    f"""WITH {ROWS_SQL}, k AS (SELECT *, 'spk_' || (position // 2 % 3) AS speaker FROM rows),
n AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker THEN lag(text) OVER w END AS before, CASE WHEN lead(speaker) OVER w = speaker THEN lead(text) OVER w END AS after,
  CASE WHEN speaker = 'spk_1' THEN 'PATIENT' ELSE 'DOCTOR' END AS mapped FROM k WINDOW w AS (PARTITION BY session_id ORDER BY position)),
p AS (SELECT *, {", ".join(f"{CUE_PHRASE_SQL.format(t)} AS {name}" for name, t in _JOINED.items())} FROM n)
SELECT segment_id, CASE WHEN speaker = 'spk_2' THEN coalesce({", ".join(phrase_role_sql(name, _DOC, _PAT) for name in _JOINED)}, mapped) ELSE mapped END AS role FROM p""",
)
def orphans(spark, sf):
    """Speakers of two rows each; the third has the first one's role and fewer rows, so it is the orphan."""
    speaker = F.expr("position div 2 % 3")
    rows = transcript(spark, sf).withColumns({"speaker_id": F.concat(F.lit("spk_"), speaker), "role": F.when(speaker == 1, "PATIENT").otherwise("DOCTOR"), "orphan": speaker == 2})
    return rules.orphan_role(rows, _DOC, _PAT).select("segment_id", "role")


@query("oj12_without_markers", r"SELECT doc_id, regexp_replace(text || ' [3] end [1, 2].', '\s*\[\d+(?:\s*,\s*\d+)*\]', '', 'g') AS text FROM documents")
def unmarked(spark, sf):
    return table(spark, sf, "documents").select("doc_id", rules.without_markers(F.concat("text", F.lit(" [3] end [1, 2]."))).alias("text"))


@query("ol1_parity", f"{_L}, a AS (SELECT session_id || '-' || k AS entry, count(*) AS n FROM logs WHERE event = 'error' GROUP BY 1), b AS (SELECT DISTINCT session_id || '-' || k AS entry FROM logs WHERE event = 'signup'), j AS (SELECT coalesce(a.entry, b.entry) AS entry, a.n, a.entry AS ak, b.entry AS bk FROM a FULL JOIN b ON a.entry = b.entry) SELECT entry, 'missing' AS finding FROM j WHERE ak IS NULL UNION ALL SELECT entry, 'extra' FROM j WHERE bk IS NULL UNION ALL SELECT entry, 'duplicate' FROM j WHERE n > 1")
def parity(spark, sf):
    log = log_events(spark, sf).withColumn("entry", F.concat(F.col("session_id"), F.lit("-"), F.col("k")))
    return rules.parity(log.where("event = 'error'"), log.where("event = 'signup'"), "entry")


@query("ol2_closed_schema", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'k,ref' ELSE 'ref' END AS missing, CASE WHEN event_id % 2 = 0 THEN 'v' ELSE '' END AS unknown FROM events")
def closed(spark, sf):
    props = F.when(F.col("event_id") % 2 == 0, F.replace("props", F.lit('"k"'), F.lit('"v"'))).otherwise(F.col("props"))
    return table(spark, sf, "events").select("event_id", rules.closed_schema(props, ["k", "ref"]).alias("s")).select("event_id", "s.*")


@query("ol4_out_of_order", f"{_L}, p AS (SELECT session_id, event_id, event, k, lag(event) OVER w AS e0, lag(k) OVER w AS k0 FROM logs WINDOW w AS (PARTITION BY session_id ORDER BY event_id)) SELECT session_id, event_id FROM p WHERE e0 > event OR e0 = event AND k0 > k")
def disordered(spark, sf):
    return rules.out_of_order(log_events(spark, sf), "session_id", ["event", "k"], "event_id").select("session_id", "event_id")


@query("ol5_one_finding_each", f"{_L} SELECT session_id, event, min(event_id) AS event_id, arg_min(k, event_id) AS k FROM logs GROUP BY 1, 2")
def findings(spark, sf):
    return rules.one_finding_each(log_events(spark, sf).select("session_id", "event", "event_id", "k"), ["session_id", "event"], "event_id")
