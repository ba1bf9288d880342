"""Queries of audits, gates, records and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from parlance.operators import governance as G
from parlance.operators import notes, rules
from parlance.plans.note_queries import _CITES, _MAPS, _cites
from parlance.plans.registry import query
from parlance.sources.adapt import LOGS_SQL, ROWS_SQL, log_events, table, transcript

_R, _L = ROWS_SQL, f"WITH {LOGS_SQL}"


@query("oi7_eval_accuracy", f"{_L} SELECT event, count(value) AS evals, round(avg(value), 6) AS accuracy FROM logs GROUP BY 1")
def accuracy(spark, sf):
    return G.mean_accuracy(log_events(spark, sf), ["event"], F.col("value"))


@query("oi13_continuity_sums", f"{_L} SELECT session_id, count(*) AS windows, count(*) FILTER (k % 5 > 0) AS with_remaps, CAST(sum(k % 5) AS BIGINT) AS remaps, CAST(sum(k) AS BIGINT) AS emitted, CAST(sum(k // 10) AS BIGINT) AS held FROM logs GROUP BY 1")
def continuity(spark, sf):
    return G.continuity_sums(log_events(spark, sf).select("session_id", (F.col("k") % 5).alias("remaps"), F.col("k").alias("emitted"), F.expr("k div 10").alias("held")))


@query("oi14_tool_rates", f"{_L}, c AS (SELECT session_id, event, count(*) AS calls, count(*) FILTER (k < 50) AS ok FROM logs GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY calls DESC, event) AS n FROM c) SELECT session_id, event, calls, round(ok / calls, 6) AS success_rate FROM r WHERE n <= 3")
def tools(spark, sf):
    return G.tool_rates(log_events(spark, sf), ["session_id"], "event", F.col("k") < 50, 3)


_FLIPS = f"m AS (SELECT session_id, position, {_MAPS} FROM rows), l AS (SELECT *, lag(r0) OVER w AS p0, lag(r1) OVER w AS p1 FROM m WINDOW w AS (PARTITION BY session_id ORDER BY position)), flips AS (SELECT session_id, count(*) FILTER (r0 <> p0 AND r1 <> p1 AND list_sort([r0, r1]) = list_sort([p0, p1])) AS flips FROM l GROUP BY 1)"


@query("oi15_quality_record", f"WITH {_R}, {LOGS_SQL}, {_FLIPS}, k AS (SELECT session_id, count(*) AS stored_segments, max(end_ms) AS duration_ms FROM rows GROUP BY 1), e AS (SELECT session_id, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS top, count(*) FILTER (event = 'error') AS errors FROM logs GROUP BY 1) SELECT session_id, 'finalized' AS status, stored_segments, duration_ms, coalesce(n, 0) AS latency_count, p50, p95, top AS latency_max, coalesce(errors, 0) AS error_count, coalesce(flips, 0) AS role_flips_accepted FROM k LEFT JOIN e USING (session_id) LEFT JOIN flips USING (session_id)")
def quality_record(spark, sf):
    from parlance.plans.note_queries import label_flips

    return G.quality_record(transcript(spark, sf), log_events(spark, sf), label_flips(spark, sf))


@query("oi16_heuristic_accuracy", f"WITH {_R}, w AS (SELECT session_id, speaker_id, arg_min(role, position) AS want FROM rows GROUP BY 1, 2), a AS (SELECT session_id, speaker_id, arg_max(role, position) AS got FROM rows WHERE role <> 'UNKNOWN' GROUP BY 1, 2) SELECT session_id, count(*) AS speakers, count(*) FILTER (want = got) AS matched, round(count(*) FILTER (want = got) / count(*), 6) AS accuracy FROM w LEFT JOIN a USING (session_id, speaker_id) GROUP BY 1")
def heuristic(spark, sf):
    rows = transcript(spark, sf)
    want = rows.groupBy("session_id", "speaker_id").agg(F.min_by("role", "position").alias("role"))
    got = rows.where("role <> 'UNKNOWN'").groupBy("session_id", "speaker_id").agg(F.max_by("role", "position").alias("role"))
    return G.expected_matches(want, got, ["session_id", "speaker_id"])


@query("oi18_review_counters", f"WITH {_R} SELECT session_id AS note_id, count(*) FILTER (position % 3 = 0) AS uncited, count(*) FILTER (position % 2 = 1) AS reason_flagged, count(*) FILTER (length(text) > 200) AS wording FROM rows GROUP BY 1")
def counters(spark, sf):
    sentence = F.struct((F.col("position") % 3).alias("cited"), F.when(F.col("position") % 2 == 1, "why").alias("reason"), (F.length("text") > 200).alias("wording"))
    whole = transcript(spark, sf).groupBy(F.col("session_id").alias("note_id")).agg(F.collect_list(sentence).alias("sentences"))
    return G.review_counters(whole, "sentences")


@query("oi6_status_mix", f"{_L} SELECT substr(event, 2) AS outcome, CASE WHEN k >= 90 THEN 'failed' WHEN k >= 50 THEN 'partial' ELSE 'ok' END AS status, count(*) AS n FROM logs WHERE starts_with(event, 'p') GROUP BY 1, 2")
def status_mix(spark, sf):
    status = F.when(F.col("k") >= 90, "failed").when(F.col("k") >= 50, "partial").otherwise("ok")
    return log_events(spark, sf).where("startswith(event, 'p')").groupBy(F.expr("substring(event, 2)").alias("outcome"), status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("oi12_after_snapshot", f"{_L}, s AS (SELECT session_id, max(ts) AS at_ FROM logs WHERE event = 'purchase' GROUP BY 1) SELECT session_id, count(*) FILTER (ts <= at_) AS recorded, count(*) FILTER (ts > at_) AS after_snapshot FROM logs JOIN s USING (session_id) GROUP BY 1")
def after_snapshot(spark, sf):
    logs = log_events(spark, sf)
    snap = logs.where("event = 'purchase'").groupBy("session_id").agg(F.max("ts").alias("at"))
    return logs.join(snap, "session_id").groupBy("session_id").agg(F.count_if(F.col("ts") <= F.col("at")).alias("recorded"), F.count_if(F.col("ts") > F.col("at")).alias("after_snapshot"))


@query("oi17_telemetry", f"{_L} SELECT event_id, regexp_extract('https://host/s/' || session_id || '/x', '/s/([0-9]+)/', 1) AS session, round(value, 1) AS latency, CASE WHEN k >= 90 THEN 'error' WHEN k >= 70 THEN 'warning' ELSE 'info' END AS level FROM logs")
def telemetry(spark, sf):
    from parlance.operators.logs import level_of

    url = F.concat(F.lit("https://host/s/"), F.col("session_id"), F.lit("/x"))
    status = F.when(F.col("k") >= 90, 500).when(F.col("k") >= 70, 404).otherwise(200)
    return log_events(spark, sf).select("event_id", F.regexp_extract(url, "/s/([0-9]+)/", 1).alias("session"), F.round("value", 1).alias("latency"), level_of(status).alias("level"))


@query("oj1_variant_counts", f"WITH {_R}, t AS (SELECT regexp_replace(text, '[^A-Za-z .]', 'x', 'g') AS text FROM rows), v AS (SELECT unnest([{{'c': 'this', 'v': 'die', 'p': '(?i)\\bdie\\b'}}, {{'c': 'from the', 'v': 'de la', 'p': '(?i)\\bde\\s+la\\b'}}, {{'c': 'from the', 'v': 'of the', 'p': '(?i)\\bof\\s+the\\b'}}]) AS x) SELECT x.c AS canonical, x.v AS variant, CAST(sum(len(regexp_extract_all(text, x.p))) AS BIGINT) AS hits FROM t, v GROUP BY 1, 2")
def variant_counts(spark, sf):
    rows = transcript(spark, sf).select(F.regexp_replace("text", "[^A-Za-z .]", "x").alias("text"))
    return G.variant_counts(rows, [("this", ["die"]), ("from the", ["de la", "of the"])])


_CUE = "(CASE WHEN contains(lower(text), '{}') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), '{}') THEN 1 ELSE 0 END)"


@query("oj3_capped_exceptions", f"WITH {_R}, c AS (SELECT session_id, position, segment_id, {_CUE.format('the ', 'und ')} AS own, {_CUE.format('que ', 'die ')} AS other, contains(lower(text), 'ein ') AS strong, len(regexp_extract_all(lower(text), '[a-z'']+')) AS n FROM rows), v AS (SELECT *, CASE WHEN other > 0 AND own > 0 THEN 'UNKNOWN' WHEN n >= 5 AND (other >= 2 OR strong) THEN 'flip' ELSE 'keep' END AS verdict FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY position) AS r FROM v WHERE verdict <> 'keep') SELECT session_id, segment_id, verdict FROM k WHERE r <= 50")
def capped_exceptions(spark, sf):
    from pyspark.sql import Window

    from parlance.functions.text import score_tokens

    own, other = rules.cue_count(F.col("text"), ["the ", "und "]), rules.cue_count(F.col("text"), ["que ", "die "])
    verdict = G.strong_exception(own, other, F.contains(F.lower("text"), F.lit("ein ")), F.size(score_tokens(F.col("text"))))
    each = transcript(spark, sf).withColumn("verdict", verdict).where("verdict <> 'keep'")
    return each.withColumn("_n", F.row_number().over(Window.partitionBy("session_id").orderBy("position"))).where("_n <= 50").select("session_id", "segment_id", "verdict")


@query("ol1_full_parity", f"{_L}, a AS (SELECT session_id || '-' || k AS entry, count(*) AS a FROM logs WHERE event = 'error' GROUP BY 1), b AS (SELECT session_id || '-' || k AS entry, count(*) AS b, bool_or(k % 3 <> 0) AS active FROM logs WHERE event = 'signup' GROUP BY 1), j AS (SELECT coalesce(a.entry, b.entry) AS entry, a, b, active FROM a FULL JOIN b ON a.entry = b.entry) SELECT entry, 'missing' AS finding FROM j WHERE a IS NULL AND active UNION ALL SELECT entry, 'extra' FROM j WHERE b IS NULL UNION ALL SELECT entry, 'inactive_executable' FROM j WHERE a IS NOT NULL AND NOT active UNION ALL SELECT entry, 'duplicate' FROM j WHERE a > 1 OR b > 1")
def full_parity(spark, sf):
    log = log_events(spark, sf).withColumn("entry", F.concat(F.col("session_id"), F.lit("-"), F.col("k"))).withColumn("active", F.col("k") % 3 != 0)
    return G.parity(log.where("event = 'error'"), log.where("event = 'signup'"), "entry")


@query("ol3_keyword_collisions", "WITH k AS (SELECT DISTINCT p_partkey % 40 AS owner, lower(trim(x)) AS k FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS x FROM part) WHERE x <> '') SELECT DISTINCT a.k AS short, b.k AS long, CASE WHEN a.k = b.k THEN 'equal' ELSE 'substring' END AS kind FROM k a JOIN k b ON a.owner <> b.owner AND contains(b.k, a.k) AND length(a.k) >= 3")
def collisions(spark, sf):
    words = table(spark, sf, "part").select((F.col("p_partkey") % 40).alias("owner"), F.explode(F.split("p_name", " ")).alias("keyword")).where("keyword <> ''")
    return G.keyword_collisions(words)


@query("ol5_status_counts", f"{_L}, f AS (SELECT session_id, event, min(CASE WHEN k % 2 = 0 THEN 'open' ELSE 'closed' END) AS status FROM logs GROUP BY 1, 2) SELECT status, count(*) AS findings FROM f GROUP BY 1")
def status_counts(spark, sf):
    status = F.when(F.col("k") % 2 == 0, "open").otherwise("closed")
    return G.finding_counts(log_events(spark, sf).withColumn("status", status), ["session_id", "event"], "status")


@query("ol6_predicates", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN false ELSE o_orderkey % 31 < 29 AND o_orderkey % 31 > 0 OR o_orderkey % 31 = 29 END AS is_date, o_orderkey % 2 = 0 AS is_sha, regexp_matches('id-' || o_orderkey || CASE WHEN o_orderkey % 5 = 0 THEN '-' ELSE '' END, '^[a-z0-9]+(-[a-z0-9]+)*$') AS is_slug FROM orders")
def predicates(spark, sf):
    k = F.col("o_orderkey")
    date = F.when(k % 3 == 0, "2024/02/01").otherwise(F.concat(F.lit("2024-02-"), F.lpad((k % 31).cast("string"), 2, "0")))
    sha = F.when(k % 2 == 0, F.sha2(k.cast("string"), 256)).otherwise(F.upper(F.sha2(k.cast("string"), 256)))
    slug = F.concat(F.lit("id-"), k, F.when(k % 5 == 0, "-").otherwise(""))
    return table(spark, sf, "orders").select("o_orderkey", G.is_iso_date(date).alias("is_date"), G.is_sha256(sha).alias("is_sha"), G.is_slug(slug).alias("is_slug"))


@query("ol7_hard_negatives", f"WITH {_R}, f AS (SELECT segment_id AS text_id, array_to_string(list_filter(['que ', 'die ', 'zzz'], lambda w: contains(lower(text), w)), ',') AS fired FROM rows) SELECT * FROM f WHERE fired <> ''")
def negatives(spark, sf):
    return G.fired_negatives(transcript(spark, sf).select(F.col("segment_id").alias("text_id"), "text"), ["que ", "die ", "zzz"])


@query("ol8_review_ledger", f"WITH {_R}, l AS (SELECT position % 4 = 3 AS guard, contains(' ' || regexp_replace(lower(text), '[^a-z]+', ' ', 'g') || ' ', ' die ') AS has FROM rows) SELECT CASE WHEN guard THEN CASE WHEN has THEN 'broken' ELSE 'kept' END WHEN has THEN 'fixed' ELSE 'missed' END AS verdict, count(*) AS \"rows\" FROM l GROUP BY 1")
def ledger(spark, sf):
    text = F.regexp_replace(F.lower("text"), "[^a-z]+", " ")
    new, _ = rules.lexicon_rewrite(text, [("this", ["die"])])
    expected = F.when(new == text, F.concat(text, F.lit("?"))).otherwise(new)
    return G.ledger_scores(transcript(spark, sf), new, text, expected, F.col("position") % 4 == 3)


@query("ol10_gate_disposition", f"{_L}, g AS (SELECT session_id AS run, event AS gate, CASE WHEN max(k) > 97 THEN 'fail' WHEN max(k) > 90 THEN 'alert' ELSE 'pass' END AS state FROM logs GROUP BY 1, 2), n AS (SELECT unnest(['view', 'click', 'error']) AS gate), j AS (SELECT r.run, n.gate, coalesce(g.state, 'missing') AS state FROM (SELECT DISTINCT run FROM g) r CROSS JOIN n LEFT JOIN g ON g.run = r.run AND g.gate = n.gate) SELECT run, CASE WHEN bool_or(state NOT IN ('pass', 'alert')) THEN 'rejected' WHEN bool_or(state = 'alert') THEN 'review' ELSE 'accepted' END AS disposition FROM j GROUP BY 1")
def gates(spark, sf):
    top = F.max("k")
    found = log_events(spark, sf).groupBy(F.col("session_id").alias("run"), F.col("event").alias("gate")).agg(F.when(top > 97, "fail").when(top > 90, "alert").otherwise("pass").alias("state"))
    return G.gate_disposition(found, ["view", "click", "error"])


_NESTED = [
    '{"token": 1, "a": {"token": {"x": 2}}}',
    '{"a": {"b": {"secret": [1]}, "c": 1}}',
    '{"a": [{"token": 1}, [{"Secret": {"token": null}}]], "b.c": {"TOKEN": "x"}}',
    '{"a": {"b": {"c": {"d": {"e": {"f": {"g": {"token": "a } b"}}}}}}}, "tokens": "token"}',
    '[1, "token", {"é": {"secret": {}}}]',
    '{"token": ',
]


@query("ol11_forbidden_keys", f"{_L} SELECT record_id, t.fullkey AS path FROM (SELECT event_id AS record_id, [{', '.join(chr(39) + x + chr(39) for x in _NESTED)}][event_id % 6 + 1] AS json FROM logs), json_tree(CASE WHEN json_valid(json) THEN json END) t WHERE lower(t.key) IN ('token', 'secret')")
def forbidden(spark, sf):
    json = F.element_at(F.array(*map(F.lit, _NESTED)), (F.col("event_id") % 6 + 1).cast("int"))
    return G.forbidden_keys(log_events(spark, sf).select(F.col("event_id").alias("record_id"), json.alias("json")), "json", ["token", "secret"])


@query("ol12_call_estimate", "SELECT o_orderstatus AS status, CAST(sum(CASE WHEN d <= 240 THEN 1 WHEN c > 1 AND d - (c - 1) * 180 < 10 THEN c - 1 ELSE c END) AS BIGINT) AS calls FROM (SELECT o_orderstatus, 1 + o_custkey % 2000 AS d, (o_custkey % 2000 + 180) // 180 AS c FROM orders) GROUP BY 1")
def calls(spark, sf):
    from parlance.operators.live import chunk_plan

    visits = table(spark, sf, "orders").select("o_orderstatus", (1 + F.col("o_custkey") % 2000).cast("long").alias("d"))
    return visits.groupBy(F.col("o_orderstatus").alias("status")).agg(F.sum(F.size(chunk_plan(F.col("d"), 240, 180, 10))).alias("calls"))


@query("ol13_refreshed_catalog", "WITH o AS (SELECT c_custkey AS key, c_name AS value, c_custkey AS ord FROM customer WHERE c_custkey % 5 <> 4), n AS (SELECT c_custkey AS key, upper(c_mktsegment) AS value, c_custkey AS ord FROM customer WHERE c_custkey % 3 <> 0) SELECT coalesce(o.key, n.key) AS key, CASE WHEN n.key IS NOT NULL AND (o.key IS NULL OR o.key % 2 = 0) THEN n.value ELSE o.value END AS value, coalesce(o.ord, n.ord + 1000000000) AS ord FROM o FULL JOIN n ON o.key = n.key WHERE o.key IS NULL OR n.key IS NOT NULL OR o.key % 2 <> 0")
def catalog(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), "c_name", "c_mktsegment", F.col("c_custkey").alias("ord"))
    old, new = c.where("key % 5 <> 4").select("key", F.col("c_name").alias("value"), "ord"), c.where("key % 3 <> 0").select("key", F.upper("c_mktsegment").alias("value"), "ord")
    return G.refreshed(old, new, "key", F.col("key") % 2 == 0)


@query("ol14_selection", f"{_L}, a AS (SELECT DISTINCT session_id AS key, session_id * 2 AS ord FROM logs WHERE session_id % 3 <> 0), r AS (SELECT session_id AS key, count(*) AS n FROM logs WHERE event = 'error' AND k > 60 GROUP BY 1) SELECT coalesce(a.key, r.key) AS key, ord, CASE WHEN ord IS NULL THEN 'unknown' WHEN n IS NULL THEN 'left_out' WHEN n > 1 THEN 'duplicate' ELSE 'chosen' END AS state FROM a FULL JOIN r ON a.key = r.key")
def selected(spark, sf):
    logs = log_events(spark, sf)
    approved = logs.where("session_id % 3 <> 0").select(F.col("session_id").alias("key"), (F.col("session_id") * 2).alias("ord")).distinct()
    return G.selection(logs.where("event = 'error' and k > 60").select(F.col("session_id").alias("key")), approved, "key")


@query("ox_op8_duplicate_report", f"WITH {_R}, w AS (SELECT session_id, array_to_string(regexp_extract_all(lower(text), '[a-z'']+'), ' ') AS w, count(*) AS c, sum(len(regexp_extract_all(lower(text), '[a-z'']+'))) AS n FROM rows GROUP BY 1, 2) SELECT session_id, CAST(sum(c) AS BIGINT) AS \"rows\", CAST(sum(n) AS BIGINT) AS words, CAST(sum(CASE WHEN w <> '' THEN c - 1 ELSE 0 END) AS BIGINT) AS repeated_rows FROM w GROUP BY ROLLUP (session_id)")
def duplicate_report(spark, sf):
    return G.duplicate_report(transcript(spark, sf))


@query("ox_op12_evidence_counts", f"WITH {_R} SELECT session_id, count(*) FILTER (end_ms > start_ms) AS timed, count(*) FILTER (position * 37 % 100 >= 78) AS confident FROM rows GROUP BY 1")
def evidence_counts(spark, sf):
    return transcript(spark, sf).groupBy("session_id").agg(F.count_if(F.expr("end_ms > start_ms")).alias("timed"), F.count_if(F.expr("position * 37 % 100 >= 78")).alias("confident"))


@query("ox_op13_stable_sources", f"WITH {_R} SELECT segment_id, position % 4 <> 3 AND position % 5 <> 2 AND (position % 6 <> 1 OR text = upper(text)) AS stable FROM rows WHERE position % 4 <> 3 OR position % 5 <> 2")
def stable_sources(spark, sf):
    rows = transcript(spark, sf)
    before = rows.where("position % 4 <> 3").select("segment_id", F.sha2("text", 256).alias("digest"))
    after = rows.where("position % 5 <> 2").select("segment_id", F.sha2(F.when(F.col("position") % 6 == 1, F.upper("text")).otherwise(F.col("text")), 256).alias("digest"))
    return G.stable_sources(before, after, "segment_id", "digest")


@query("ox_op14_confidence_summary", f"{_L}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_id) AS n FROM logs WHERE k IS NOT NULL) SELECT session_id, count(*) AS \"count\", min(k) AS \"min\", max(k) AS \"max\", round(avg(k), 6) AS mean, round(count(*) FILTER (k = 1) / count(*), 6) AS ones, string_agg(CAST(k AS VARCHAR), ',' ORDER BY n) FILTER (n <= 12) AS first FROM n GROUP BY 1")
def confidences(spark, sf):
    return G.confidence_summary(log_events(spark, sf), ["session_id"], "k", ["event_id"])


@query("ox_op15_scraped_metrics", f"{_L} SELECT event_id, CASE WHEN k % 2 = 0 THEN CAST(k AS DOUBLE) / 10 END AS wer FROM logs")
def scraped(spark, sf):
    report = F.concat(F.lit("accuracy: 1\n"), F.when(F.col("k") % 2 == 0, "WER").otherwise("other"), F.lit(": "), (F.col("k") / 10).cast("string"))
    return log_events(spark, sf).select("event_id", G.scraped_metric(report, "WER").alias("wer"))


@query("ox_op16_uuid5_ids")
def uuids(spark, sf):
    return table(spark, sf, "pages").select("page_id", G.uuid5(uuid.NAMESPACE_URL, F.col("url")).alias("id"))


@query("ox_op17_arm_comparison", f"WITH {_R}, a AS (SELECT segment_id, position % 3 AS rank, position % 3 = 0 AS wrong FROM rows), b AS (SELECT segment_id, position % 4 AS rank, position % 4 = 0 AS wrong FROM rows), j AS (SELECT coalesce(b.rank < a.rank, true) AS w, coalesce(b.wrong AND NOT a.wrong, false) AS n FROM a FULL JOIN b USING (segment_id)) SELECT count(*) AS \"rows\", count(*) FILTER (w) AS worsened, count(*) FILTER (n) AS newly_wrong, CASE WHEN count(*) FILTER (w OR n) > 0 THEN 'fail' ELSE 'pass' END AS verdict FROM j")
def arms(spark, sf):
    arm = lambda n: transcript(spark, sf).select("segment_id", (F.col("position") % n).alias("rank"), (F.col("position") % n == 0).alias("wrong"))
    return G.arm_comparison(arm(3), arm(4), "segment_id")


@query("ox_op19_key_values", f"{_L} SELECT session_id AS file, event AS key, min(k || '=' || event_id) AS value, count(*) > 1 AS repeated FROM logs GROUP BY 1, 2")
def key_values(spark, sf):
    line = F.concat(F.lit(" "), F.col("event"), F.lit(" = "), F.col("k"), F.lit("="), F.col("event_id"))
    lines = log_events(spark, sf).select(F.col("session_id").alias("file"), line.alias("line"))
    return G.key_values(lines.unionByName(lines.limit(1).withColumn("line", F.lit("no pair"))), "line")


@query("ox_op20_variant_owners", "WITH l AS (SELECT n_name AS canonical, unnest([left(n_name, 1), right(n_name, 2)]) AS variant FROM nation) SELECT lower(variant) AS variant, count(DISTINCT canonical) AS owners FROM l GROUP BY 1 HAVING count(DISTINCT canonical) > 1")
def owners(spark, sf):
    names = table(spark, sf, "nation").select(F.col("n_name").alias("canonical"), F.explode(F.array(F.left("n_name", F.lit(1)), F.right("n_name", F.lit(2)))).alias("variant"))
    return G.variant_owners(names)


@query("ox_op25_valid_claims", f"WITH {_R}, {_CITES}, f AS (SELECT c.claim_id, c.cited, min(c.ord) AS o FROM cites c JOIN rows r ON r.session_id = c.session_id AND r.segment_id = c.cited GROUP BY 1, 2), u AS (SELECT claim_id, string_agg(cited, ',' ORDER BY o) AS units FROM f GROUP BY 1) SELECT r.segment_id AS claim_id, coalesce(units, '') AS units, CASE WHEN units IS NULL THEN 'none' ELSE 'source_unit' END AS basis FROM rows r LEFT JOIN u ON u.claim_id = r.segment_id WHERE r.role = 'DOCTOR'")
def valid_claims(spark, sf):
    rows = transcript(spark, sf)
    cited = F.transform(F.array_sort(F.collect_list(F.struct("ord", "cited"))), lambda x: x["cited"])
    return G.valid_claims(_cites(rows).groupBy("session_id", "claim_id").agg(cited.alias("cited")), rows)


@query("ox_op26_source_lines", f"WITH {_R} SELECT segment_id, '[' || row_number() OVER (PARTITION BY session_id ORDER BY position) || '] ' || role || ': ' || text AS line FROM rows")
def source_lines(spark, sf):
    return G.source_lines(transcript(spark, sf))


@query("ox_op28_source_states", f"{_L}, s AS (SELECT session_id, count(*) FILTER (event = 'purchase') AS n, max(k) FILTER (event = 'purchase') AS c, max(k) FILTER (event = 'view') AS l, max(k) FILTER (event = 'click') AS w FROM logs GROUP BY 1) SELECT session_id, CASE WHEN n > 0 AND c IS NOT NULL AND session_id % 2 = 0 THEN 'corrected' WHEN w IS NULL THEN 'pending' WHEN l IS NOT DISTINCT FROM w THEN 'live_fallback' ELSE 'stale' END AS state FROM s")
def source_states(spark, sf):
    top = lambda e: F.max(F.when(F.col("event") == e, F.col("k")))
    found = log_events(spark, sf).groupBy("session_id").agg(F.count_if(F.col("event") == "purchase").alias("n"), top("purchase").alias("c"), top("view").alias("l"), top("click").alias("w"))
    kept = F.when(F.col("session_id") % 2 == 0, F.col("c"))
    return found.select("session_id", G.source_state(F.col("n"), kept, F.col("l"), F.col("w")).alias("state"))


@query("ox_op29_orphan_state", f"WITH {_R}, {LOGS_SQL} SELECT DISTINCT session_id FROM logs WHERE session_id NOT IN (SELECT session_id FROM rows)")
def orphan_state(spark, sf):
    return log_events(spark, sf).select("session_id").distinct().join(transcript(spark, sf).select("session_id").distinct(), "session_id", "left_anti")


@query("ox_op30_guarded_mapping", f"WITH {_R}, m AS (SELECT session_id, position, {_MAPS} FROM rows) SELECT session_id, position, CASE WHEN position % 6 = 5 THEN 'hint' WHEN r0 = 'PATIENT' AND r1 = 'DOCTOR' AND position % 2 = 0 THEN 'hint' ELSE 'model' END AS source FROM m")
def guarded(spark, sf):
    r0, r1 = (e.split(" AS r")[0] for e in _MAPS.split(", CASE WHEN position"))
    model = F.create_map(F.lit("spk_0"), F.expr(r0), F.lit("spk_1"), F.expr("CASE WHEN position" + r1))
    hint = F.create_map(F.lit("spk_0"), F.lit("DOCTOR"), F.lit("spk_1"), F.lit("PATIENT"))
    named = G.guarded_mapping(F.lit("hint"), F.when(F.col("position") % 6 != 5, "model"), notes.exact_inverse(model, hint), F.col("position") % 2 == 1)
    return transcript(spark, sf).select("session_id", "position", named.alias("source"))
