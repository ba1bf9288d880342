"""Queries of live transcripts: windowed emission, release, revision, speaker continuity and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import live
from parlance.operators import release as R
from parlance.plans.registry import query
from parlance.sources.adapt import LOGS_SQL, ROWS_SQL, WORDS_SQL, log_events, table, timed_words, transcript

_R, _L = ROWS_SQL, f"WITH {LOGS_SQL}"
_CONF = "(position * 37 + session_id * 11) % 100"


@query(
    "od1_od2_reread_emissions",
    f"""WITH RECURSIVE {_R}, o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY end_ms, position) AS i, (end_ms + 10999) // 10000 AS k FROM rows),
s AS (SELECT session_id, segment_id, i, k, CAST(0 AS BIGINT) AS mark, start_ms, end_ms > 300 AS shown, CASE WHEN end_ms > 300 THEN end_ms ELSE 0 END AS top FROM o WHERE i = 1
UNION ALL SELECT session_id, segment_id, i, k, mark, start_ms, end_ms > mark + 300, CASE WHEN end_ms > mark + 300 THEN greatest(top, end_ms) ELSE top END
  FROM (SELECT o.*, s.top, CASE WHEN o.k <> s.k THEN greatest(s.mark, s.top) ELSE s.mark END AS mark FROM s JOIN o ON o.session_id = s.session_id AND o.i = s.i + 1))
SELECT session_id, segment_id, k AS "window", mark AS mark_ms, greatest(start_ms, mark - 500) AS start_ms FROM s WHERE shown""",
)
def reread(spark, sf):
    return live.reread_emissions(transcript(spark, sf))


@query("od3_trimmed_buffer", f"WITH {_R}, b AS (SELECT session_id, end_ms - start_ms AS len, sum(end_ms - start_ms) OVER (PARTITION BY session_id) - coalesce(sum(end_ms - start_ms) OVER (PARTITION BY session_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM rows) SELECT session_id, count(*) FILTER (rest <= 60000) AS kept, count(*) FILTER (rest > 60000) AS dropped, CAST(coalesce(sum(len) FILTER (rest > 60000), 0) AS BIGINT) AS offset_ms FROM b GROUP BY 1")
def trimmed(spark, sf):
    return live.trimmed_buffer(transcript(spark, sf), F.expr("end_ms - start_ms"), 60_000)


@query(
    "od4_stable_rows",
    f"""WITH {_R}, {WORDS_SQL}, a AS (SELECT *, row_number() OVER s AS at_, count(*) OVER (PARTITION BY session_id, speaker_id) AS all_, max(w_end) OVER (PARTITION BY session_id) - max(w_end) OVER (PARTITION BY session_id, speaker_id) AS quiet, lag(w_end) OVER s AS prev_ FROM words WINDOW s AS (PARTITION BY session_id, speaker_id ORDER BY w_start, position, i)),
k AS (SELECT * FROM a WHERE at_ <= all_ - CASE WHEN quiet > 25000 THEN 0 WHEN quiet > 12000 THEN 3 ELSE 10 END),
g AS (SELECT *, sum(CASE WHEN w_start - prev_ > 1500 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, speaker_id ORDER BY at_) AS run FROM k)
SELECT session_id, speaker_id, CAST(run AS BIGINT) AS run, min(w_start) AS start_ms, max(w_end) AS end_ms, count(*) AS n_words, string_agg(word, ' ' ORDER BY at_) AS text FROM g GROUP BY ALL""",
)
def stable(spark, sf):
    return live.stable_rows(timed_words(transcript(spark, sf)))


_SNAPS = """snaps AS (SELECT session_id, position, end_ms, clock_ms, max(least(clock_ms, coalesce(frontier, clock_ms))) OVER (PARTITION BY session_id ORDER BY position) AS horizon_ms FROM
  (SELECT session_id, position, end_ms, max(end_ms) OVER w - 5000 AS clock_ms, min(CASE WHEN role = 'UNKNOWN' THEN start_ms END) OVER w AS frontier FROM rows WINDOW w AS (PARTITION BY session_id ORDER BY position ROWS UNBOUNDED PRECEDING))),
timed AS (SELECT session_id, position, (SELECT min(s.position) FROM snaps s WHERE s.session_id = r.session_id AND s.position >= r.position AND s.clock_ms >= r.end_ms) AS ready_at,
  (SELECT min(s.position) FROM snaps s WHERE s.session_id = r.session_id AND s.position >= r.position AND s.horizon_ms >= r.end_ms) AS released_at FROM snaps r)"""


@query("od5_release_horizon", f"WITH {_R}, {_SNAPS} SELECT s.session_id, s.position, s.clock_ms, s.horizon_ms, t.released_at FROM snaps s JOIN timed t USING (session_id, position)")
def horizon(spark, sf):
    snaps, timed = live.release(transcript(spark, sf), F.col("role") != "UNKNOWN")
    return snaps.join(timed.drop("ready_at"), ["session_id", "position"])


@query(
    "od6_release_labels",
    f"""WITH {_R}, {_SNAPS}, c AS (SELECT session_id, position, (SELECT count(*) FROM timed t WHERE t.session_id = s.session_id AND t.released_at = s.position) AS released,
  (SELECT count(*) FROM timed t WHERE t.session_id = s.session_id AND t.ready_at <= s.position AND (t.released_at IS NULL OR t.released_at >= s.position)) AS ready FROM snaps s)
SELECT session_id, position, ready, released, CASE WHEN released > 0 AND released < ready THEN 'release_limited_by_stability_frontier' WHEN released > 0 THEN 'release_ready_rows' WHEN ready > 0 THEN 'hold_stability_frontier' ELSE 'hold_clock_lookback' END AS label FROM c""",
)
def labels(spark, sf):
    return live.release_labels(*live.release(transcript(spark, sf), F.col("role") != "UNKNOWN"))


@query("od7_hypothesis_revisions", f"WITH {_R}, h AS (SELECT session_id, position, regexp_extract_all(lower(text), '[a-z'']+') AS now_, lag(regexp_extract_all(lower(text), '[a-z'']+')) OVER (PARTITION BY session_id ORDER BY position) AS was FROM rows), p AS (SELECT *, least(len(was), len(now_)) AS n, greatest(len(was) - 10, 0) AS shown FROM h WHERE was IS NOT NULL) SELECT session_id, position, len(list_filter(range(1, n + 1), lambda j: was[j] <> now_[j])) AS revised, len(list_filter(range(1, least(n, shown) + 1), lambda j: was[j] <> now_[j])) AS late, greatest(len(was) - greatest(len(now_), shown), 0) AS truncated FROM p")
def revised(spark, sf):
    from pyspark.sql import Window

    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z']+"), F.lit(0))
    rows = transcript(spark, sf).select("session_id", "position", words.alias("now"))
    rows = rows.withColumn("was", F.lag("now").over(Window.partitionBy("session_id").orderBy("position"))).where("was is not null")
    return rows.select("session_id", "position", live.revisions(F.col("was"), F.col("now"), live.MUTABLE_WORDS).alias("r")).select("session_id", "position", "r.*")


@query("od5_live_release")
def live_release(spark, sf):
    """Each row is a step of its speaker's slot: its words, and the last two before them in other words; a step's clock is the row's end."""
    from pyspark.sql import Window

    words = timed_words(transcript(spark, sf)).groupBy("session_id", "position", F.col("speaker_id").alias("slot")).agg(F.array_sort(F.collect_list(F.struct("i", "word", "w_start", "w_end"))).alias("w"))
    slot, session = Window.partitionBy("session_id", "slot").orderBy("position"), Window.partitionBy("session_id")
    none = F.array().cast(words.schema["w"].dataType)
    heard = words.withColumns({"before": F.coalesce(F.sum(F.size("w")).over(slot.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "was": F.coalesce(F.lag("w").over(slot), none), "last": F.max("position").over(session)})
    heard = heard.withColumn("was", F.when(F.size("was") >= 2, F.slice("was", -2, 2)).otherwise(none))
    word = lambda text, w: F.struct(text.alias("text"), w["w_start"].alias("start_ms"), w["w_end"].alias("end_ms"), (w["i"] % 10 / 10).alias("confidence"))
    spoken = F.concat(F.transform("was", lambda w: word(F.concat(w["word"], F.lit("s")), w)), F.transform("w", lambda w: word(w["word"], w)))
    clock = F.array_max(F.transform("w", lambda w: w["w_end"]))
    steps = heard.select("session_id", "position", clock.alias("clock_ms"), "slot", (F.col("before") - F.size("was")).cast("int").alias("first"), spoken.alias("words"), (F.col("position") == F.col("last")).alias("final"))
    return R.released(steps, max_hold=30_000)


@query("od8_wall_clock", f"WITH {_R}, v AS (SELECT session_id, start_ms, end_ms - start_ms AS len, CAST(coalesce(sum(end_ms - start_ms) OVER (PARTITION BY session_id ORDER BY start_ms, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS low FROM rows WHERE end_ms > start_ms), t AS (SELECT *, unnest(range((low + 799) // 800, (low + len + 799) // 800 + 1)) * 800 AS voiced_ms FROM v) SELECT session_id, voiced_ms, start_ms + voiced_ms - low AS at_ms FROM t WHERE voiced_ms < low + len")
def wall(spark, sf):
    return live.wall_clock(transcript(spark, sf), 800)


@query("od9_coactivity", f"WITH {_R}, t AS (SELECT DISTINCT session_id, speaker_id, unnest(range(start_ms // 1000, (end_ms - 1) // 1000 + 1)) AS step FROM rows WHERE end_ms > start_ms) SELECT x.session_id, x.speaker_id AS a, y.speaker_id AS b, count(*) AS steps FROM t x JOIN t y ON x.session_id = y.session_id AND x.step = y.step AND x.speaker_id < y.speaker_id GROUP BY ALL")
def together(spark, sf):
    return live.coactivity(transcript(spark, sf), 1000)


_VOTES = "votes AS (SELECT a.session_id, 'w' || ((a.position + 1) % 3) AS window_speaker, b.speaker_id AS known_speaker, CAST(sum(least(a.end_ms + 400, b.end_ms) - greatest(a.start_ms + 400, b.start_ms)) AS BIGINT) AS overlap_ms FROM rows a JOIN rows b ON a.session_id = b.session_id AND a.start_ms + 400 < b.end_ms AND b.start_ms < a.end_ms + 400 GROUP BY ALL)"


@query(
    "od10_speaker_continuity",
    f"""WITH RECURSIVE {_R}, {_VOTES}, o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY overlap_ms DESC, window_speaker DESC, known_speaker DESC) AS i FROM votes),
g AS (SELECT session_id, i, window_speaker, known_speaker, overlap_ms, true AS taken, [window_speaker] AS ws, [known_speaker] AS ks FROM o WHERE i = 1
UNION ALL SELECT session_id, i, window_speaker, known_speaker, overlap_ms, taken, CASE WHEN taken THEN list_append(ws, window_speaker) ELSE ws END, CASE WHEN taken THEN list_append(ks, known_speaker) ELSE ks END
  FROM (SELECT o.*, g.ws, g.ks, NOT list_contains(g.ws, o.window_speaker) AND NOT list_contains(g.ks, o.known_speaker) AS taken FROM g JOIN o ON o.session_id = g.session_id AND o.i = g.i + 1))
SELECT session_id, window_speaker, known_speaker, overlap_ms FROM g WHERE taken""",
)
def continuity(spark, sf):
    from parlance.operators.intervals import overlap_join

    rows = transcript(spark, sf)
    window = rows.select("session_id", F.col("segment_id"), F.concat(F.lit("w"), (F.col("position") + 1) % 3).alias("window_speaker"), (F.col("start_ms") + 400).alias("start_ms"), (F.col("end_ms") + 400).alias("end_ms"))
    known = rows.select("session_id", F.col("speaker_id").alias("known_speaker"), F.col("position").alias("ordinal"), F.col("start_ms").alias("ref_start"), F.col("end_ms").alias("ref_end"))
    pairs = overlap_join(window, known, ["session_id"], "start_ms", "end_ms", "ref_start", "ref_end")
    votes = pairs.groupBy("session_id", "window_speaker", "known_speaker").agg(F.sum(F.expr("least(end_ms, ref_end) - greatest(start_ms, ref_start)")).alias("overlap_ms"))
    return live.continuity(votes)


@query("od11_two_speaker_swap", f"WITH {_R}, s AS (SELECT session_id, list_sort(list(DISTINCT speaker_id)) AS ids FROM rows WHERE speaker_id <> 'spk_2' GROUP BY 1) SELECT session_id, CASE WHEN len(ids) = 2 THEN 'spk_0=spk_1,spk_1=spk_0' ELSE 'spk_0=spk_1' END AS mapping FROM s")
def swap(spark, sf):
    ids = transcript(spark, sf).where("speaker_id <> 'spk_2'").groupBy("session_id").agg(F.array_sort(F.collect_set("speaker_id")).alias("ids"))
    mapping = live.completed_swap(F.create_map(F.lit("spk_0"), F.lit("spk_1")), F.col("ids"), F.col("ids"))
    line = F.array_join(F.array_sort(F.transform(F.map_entries(mapping), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return ids.select("session_id", line.alias("mapping"))


@query(
    "od12_capped_speakers",
    f"""WITH {_R}, t AS (SELECT session_id, speaker_id, row_number() OVER (PARTITION BY session_id ORDER BY sum(end_ms - start_ms) DESC, speaker_id) <= 2 AS top FROM rows GROUP BY 1, 2),
b AS (SELECT r.*, top, CASE WHEN top THEN {{'e': end_ms, 'p': position, 's': r.speaker_id}} END AS ended, CASE WHEN top THEN {{'e': start_ms, 'p': position, 's': r.speaker_id}} END AS starts FROM rows r JOIN t USING (session_id, speaker_id)),
w AS (SELECT *, max(ended) OVER (PARTITION BY session_id ORDER BY start_ms, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_, min(starts) OVER (PARTITION BY session_id ORDER BY start_ms, position ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_ FROM b)
SELECT session_id, segment_id, speaker_id, CASE WHEN top THEN speaker_id WHEN next_ IS NULL THEN prev_.s WHEN prev_ IS NOT NULL AND greatest(start_ms - prev_.e, 0) <= greatest(next_.e - end_ms, 0) THEN prev_.s ELSE next_.s END AS canonical FROM w""",
)
def capped(spark, sf):
    return live.capped_speakers(transcript(spark, sf))


@query("od13_folded_slots", f"WITH {_R}, t AS (SELECT session_id, speaker_id, CAST(sum(end_ms - start_ms) AS BIGINT) AS ms FROM rows GROUP BY 1, 2), a AS (SELECT *, sum(ms) OVER (PARTITION BY session_id) AS total, first_value(speaker_id) OVER (PARTITION BY session_id ORDER BY ms DESC, speaker_id DESC) AS main FROM t) SELECT session_id, speaker_id, ms, round(ms / nullif(total, 0), 4) AS share, CASE WHEN ms < greatest(1500, 0.05 * total) AND NOT (ms // 80 >= 50 AND ms >= 0.015 * total) THEN main ELSE speaker_id END AS visible FROM a")
def folded(spark, sf):
    return live.folded_slots(transcript(spark, sf))


@query("od14_slot_shares", f"WITH {_R}, t AS (SELECT session_id, position // 2 AS w, speaker_id, sum(end_ms - start_ms) AS d FROM rows GROUP BY ALL), c AS (SELECT *, sum(d) OVER (PARTITION BY session_id, speaker_id ORDER BY w) AS total, sum(d) OVER (PARTITION BY session_id ORDER BY w) AS all_ FROM t) SELECT session_id, w AS \"window\", speaker_id, CAST(d AS BIGINT) AS delta_ms, CAST(total AS BIGINT) AS total_ms, round(total / nullif(all_, 0), 4) AS share FROM c")
def shares(spark, sf):
    return live.slot_shares(transcript(spark, sf), F.expr("position div 2"))


@query("od15_evictions", f"{_L}, s AS (SELECT session_id, max(ts) AS last_seen FROM logs GROUP BY 1), e AS (SELECT *, epoch_us((SELECT max(ts) FROM logs)) - epoch_us(last_seen) > 7200000000 AS expired FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY expired ORDER BY last_seen DESC, session_id) AS n FROM e) SELECT session_id, CASE WHEN expired THEN 'expired' WHEN n <= 100 THEN 'kept' ELSE 'evicted' END AS state FROM r")
def evicted(spark, sf):
    logs = log_events(spark, sf)
    now = logs.agg(F.max("ts").alias("now"))  # one row
    return live.evictions(logs.groupBy("session_id").agg(F.max("ts").alias("last_seen")).crossJoin(F.broadcast(now)), F.col("now"), 7200, 100)


@query("od16_reconnect_sessions", f"{_L}, g AS (SELECT session_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM logs WINDOW w AS (PARTITION BY session_id ORDER BY ts)), i AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g) SELECT session_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS events FROM i GROUP BY session_id, k")
def reconnects(spark, sf):
    grace = F.session_window("ts", "30 minutes")
    found = log_events(spark, sf).groupBy("session_id", grace).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("events"))
    return found.select("session_id", F.unix_micros(F.col("first").cast("timestamp")).alias("first_us"), F.unix_micros(F.col("last").cast("timestamp")).alias("last_us"), "events")


@query("od17_coalesced_batches", f"{_L}, q AS (SELECT *, row_number() OVER (PARTITION BY event, epoch_us(ts) // 3600000000 ORDER BY event_id) AS n FROM logs) SELECT event, epoch_us(ts) // 3600000000 AS batch, count(*) FILTER (n <= 50) AS taken, count(*) FILTER (n > 50) AS dropped FROM q GROUP BY ALL")
def coalesced(spark, sf):
    hour = F.expr("unix_micros(cast(ts as timestamp)) div 3600000000")
    counts = log_events(spark, sf).groupBy("event", hour.alias("batch")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("event", "batch", F.least("n", F.lit(50).cast("long")).alias("taken"), F.greatest(F.col("n") - 50, F.lit(0).cast("long")).alias("dropped"))


_PROPOSED = "CASE WHEN (position * 5 + session_id) % 3 = 0 THEN 'BA' ELSE 'AB' END"


@query(
    "od18_debounced_flips",
    f"""WITH RECURSIVE {_R}, o AS (SELECT session_id, position, {_PROPOSED} AS proposed, CAST({_CONF} AS BIGINT) AS confidence, row_number() OVER (PARTITION BY session_id ORDER BY position) AS i FROM rows),
s AS (SELECT session_id, position, proposed, confidence, i, proposed AS shown, false AS suppressed, [confidence] AS last_, CAST(NULL AS VARCHAR) AS pending, 0 AS times FROM o WHERE i = 1
UNION ALL SELECT session_id, position, proposed, confidence, i, CASE WHEN wait THEN was ELSE proposed END, wait, CASE WHEN wait THEN last_ ELSE list_slice(list_append(last_, confidence), -5, -1) END, CASE WHEN wait THEN proposed END, CASE WHEN wait THEN t ELSE 0 END
  FROM (SELECT *, proposed <> was AND t < 2 AND confidence - list_avg(last_) < 9 AS wait FROM (SELECT o.*, s.shown AS was, s.last_, CASE WHEN s.pending = o.proposed THEN s.times + 1 ELSE 1 END AS t FROM s JOIN o ON o.session_id = s.session_id AND o.i = s.i + 1)))
SELECT session_id, position, proposed, confidence, shown, suppressed FROM s""",
)
def debounced(spark, sf):
    return live.debounced(transcript(spark, sf).select("session_id", F.col("position").cast("long").alias("position"), F.expr(_PROPOSED).alias("proposed"), F.expr(_CONF).cast("long").alias("confidence")))


@query("od19_running_confidence", f"WITH {_R} SELECT session_id, position, round(avg({_CONF}) OVER (PARTITION BY session_id ORDER BY position ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS running FROM rows")
def running(spark, sf):
    return transcript(spark, sf).select("session_id", "position", live.running_confidence(F.expr(_CONF), "session_id", "position").alias("running"))


@query("od20_late_tail", f"{_L}, f AS (SELECT session_id, min(ts) FILTER (event = 'purchase') AS done FROM logs GROUP BY 1), t AS (SELECT session_id, count(*) FILTER (event = 'view') AS views, count(*) FILTER (event = 'click') AS clicks FROM logs JOIN f USING (session_id) WHERE ts > done GROUP BY 1) SELECT * FROM t WHERE views > 0 OR clicks > 0")
def tail(spark, sf):
    logs = log_events(spark, sf)
    done = logs.groupBy("session_id").agg(F.min(F.when(F.col("event") == "purchase", F.col("ts"))).alias("done")).where("done is not null")
    counts = lambda rows: rows.groupBy("session_id").agg(F.count_if(F.col("event") == "view").alias("views"), F.count_if(F.col("event") == "click").alias("clicks"))
    return live.late_tail(counts(logs.join(done, "session_id").where("ts <= done")), counts(logs), ["views", "clicks"])


@query("od21_stability_badge", f"{_L} SELECT session_id, CASE WHEN count(*) FILTER (k % 7 = 0) > 0.2 * count(*) OR count(*) FILTER (k = 3) > 0 OR arg_max(event, event_id) = 'error' THEN 'unstable' ELSE 'stable' END AS badge FROM logs GROUP BY 1")
def badge(spark, sf):
    found = log_events(spark, sf).groupBy("session_id").agg(F.count_if(F.col("k") % 7 == 0).alias("remaps"), F.count(F.lit(1)).alias("updates"), F.count_if(F.col("k") == 3).alias("merges"), (F.max_by("event", "event_id") == "error").alias("pending"))
    return found.select("session_id", live.stability(F.col("remaps"), F.col("updates"), F.col("merges"), F.col("pending")).alias("badge"))


@query("od22_terminal_watermark", f"WITH {_R} SELECT session_id, count(*) AS n_rows, max(end_ms) AS last_ms, sha256(string_agg(sha256(role || '|' || text), '' ORDER BY position)) AS identity FROM rows GROUP BY 1")
def watermark(spark, sf):
    return live.watermark(transcript(spark, sf))


@query("od23_settlement", f"{_L}, q AS (SELECT session_id, count(*) FILTER (event = 'view') AS queued, count(*) FILTER (event = 'click') AS done, max(k) AS waited FROM logs GROUP BY 1) SELECT session_id, CASE WHEN done >= queued THEN 'drained' WHEN waited >= 90 THEN 'frozen' ELSE 'waiting' END AS state FROM q")
def settled(spark, sf):
    found = log_events(spark, sf).groupBy("session_id").agg(F.count_if(F.col("event") == "view").alias("queued"), F.count_if(F.col("event") == "click").alias("done"), F.max("k").alias("waited"))
    return found.select("session_id", F.when(F.col("done") >= F.col("queued"), "drained").when(F.col("waited") >= 90, "frozen").otherwise("waiting").alias("state"))


@query("od24_chunk_plan", "SELECT o_orderkey AS visit, CAST(u.start_ AS BIGINT) AS start, CAST(u.end_ AS BIGINT) AS \"end\" FROM (SELECT o_orderkey, d, unnest(list_transform(range(0, n), lambda i: {'start_': i * 180, 'end_': CASE WHEN i = n - 1 THEN d ELSE (i + 1) * 180 END})) AS u FROM (SELECT o_orderkey, d, CASE WHEN d <= 240 THEN 1 WHEN c > 1 AND d - (c - 1) * 180 < 10 THEN c - 1 ELSE c END AS n FROM (SELECT o_orderkey, 1 + o_custkey % 2000 AS d, (o_custkey % 2000 + 180) // 180 AS c FROM orders)))")
def chunks(spark, sf):
    visits = table(spark, sf, "orders").select(F.col("o_orderkey").alias("visit"), (1 + F.col("o_custkey") % 2000).cast("long").alias("d"))
    return visits.select("visit", F.explode(live.chunk_plan(F.col("d"), 240, 180, 10)).alias("c")).select("visit", F.col("c.start").alias("start"), F.col("c.end").alias("end"))


@query("od25_recombined_chunks", f"WITH {_R}, {WORDS_SQL}, c AS (SELECT session_id, position AS chunk, start_ms AS offset_ms FROM rows) SELECT w.session_id, position AS chunk, i, word, w_start - offset_ms + offset_ms AS at_ms, row_number() OVER (PARTITION BY w.session_id ORDER BY position, i) - 1 AS visit_index, i = 0 AND position > 0 AS seam FROM words w JOIN c ON c.session_id = w.session_id AND c.chunk = w.position")
def recombined(spark, sf):
    rows = transcript(spark, sf)
    chunked = rows.select("session_id", F.col("position").alias("chunk"), F.col("start_ms").alias("offset_ms"))
    words = timed_words(rows, "start_ms").select("session_id", F.col("position").alias("chunk"), "i", "word", (F.col("w_start") - F.col("start_ms")).alias("rel_ms"))
    return live.recombined(words, chunked)
