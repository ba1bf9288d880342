"""Queries over texts and stored rows: relabelling, bags, shingles and alignments."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import relabel, sequences
from parlance.plans.registry import query
from parlance.sources.adapt import ROWS_SQL, reference, table, transcript

_TOK = "regexp_extract_all(lower({}), '[a-z'']+')"
_WORDS = f"hyp AS (SELECT session_id, unnest({_TOK.format('text')}) AS word FROM rows WHERE position % 2 = 0), ref AS (SELECT session_id, unnest({_TOK.format('text')}) AS word FROM rows WHERE position % 2 = 1 OR position % 4 = 0)"
_BAGS = f"{_WORDS}, hb AS (SELECT session_id, word, count(*) AS n FROM hyp GROUP BY ALL), rb AS (SELECT session_id, word, count(*) AS n FROM ref GROUP BY ALL)"


def _bags(spark, sf):
    rows = transcript(spark, sf)
    each = lambda df: df.select("session_id", F.explode(T.score_tokens(F.col("text"))).alias("word"))
    return each(rows.where("position % 2 = 1 or position % 4 = 0")), each(rows.where("position % 2 = 0"))


@query("oc1_cleaned_rows", f"WITH {ROWS_SQL} SELECT session_id, segment_id, row_number() OVER (PARTITION BY session_id ORDER BY start_ms, end_ms, segment_id) - 1 AS position, role, start_ms, end_ms FROM (SELECT session_id, segment_id, start_ms, greatest(start_ms, end_ms - CASE WHEN position % 3 = 0 THEN 100000 ELSE 0 END) AS end_ms, coalesce(CASE WHEN position % 4 <> 1 THEN role END, 'UNKNOWN') AS role, text FROM rows) WHERE trim(text) <> ''")
def cleaned_rows(spark, sf):
    rows = transcript(spark, sf)
    rows = rows.withColumn("end_ms", F.col("end_ms") - F.when(F.col("position") % 3 == 0, 100000).otherwise(0)).withColumn("role", F.when(F.col("position") % 4 != 1, F.col("role")))
    return relabel.cleaned(rows).select("session_id", "segment_id", "position", "role", "start_ms", "end_ms")


@query("oc2_shifted_rows", f"WITH {ROWS_SQL} SELECT segment_id, start_ms + 180000 * (position // 3) AS start_ms, end_ms + 180000 * (position // 3) AS end_ms FROM rows")
def shifted(spark, sf):
    by = F.floor(F.col("position") / 3) * 180000
    return transcript(spark, sf).select("segment_id", (F.col("start_ms") + by).alias("start_ms"), (F.col("end_ms") + by).alias("end_ms"))


@query("oc3_session_upsert", "WITH s AS (SELECT user_id AS session_id, min(ts) AS created_at, max(ts) AS last_accessed_at FROM events WHERE event_id % 2 = 0 GROUP BY 1), v AS (SELECT user_id AS session_id, min(ts) AS first_at, max(ts) AS last_at FROM events WHERE event_id % 2 = 1 GROUP BY 1) SELECT coalesce(s.session_id, v.session_id) AS session_id, CAST(epoch_us(coalesce(created_at, first_at)) AS BIGINT) AS created_us, CAST(epoch_us(greatest(coalesce(last_accessed_at, last_at), coalesce(last_at, last_accessed_at))) AS BIGINT) AS last_us FROM s FULL JOIN v ON s.session_id = v.session_id")
def session_upsert(spark, sf):
    log = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("at"), "event_id")
    old = log.where("event_id % 2 = 0").groupBy("session_id").agg(F.min("at").alias("created_at"), F.max("at").alias("last_accessed_at"))
    done = relabel.upsert_sessions(old, log.where("event_id % 2 = 1"))
    return done.select("session_id", F.unix_micros("created_at").alias("created_us"), F.unix_micros("last_accessed_at").alias("last_us"))


_CLAIMED = "CASE WHEN position % 3 = 0 THEN 'user' END AS role_source"


@query("oc4_merged_roles", f"WITH {ROWS_SQL} SELECT segment_id, CASE WHEN position % 3 <> 0 AND position % 2 = 0 THEN 'DOCTOR' ELSE role END AS role, position % 2 = 0 AS matched FROM rows")
def merged_roles(spark, sf):
    rows = transcript(spark, sf).withColumn("role_source", F.when(F.col("position") % 3 == 0, "user"))
    return relabel.merge_roles(rows, rows.where("position % 2 = 0").withColumn("role", F.lit("DOCTOR"))).select("segment_id", "role", "matched")


@query("oc5_speaker_map_applied", f"WITH {ROWS_SQL} SELECT segment_id, CASE WHEN speaker_id = 'spk_1' THEN 'PATIENT' ELSE role END AS role, CASE WHEN speaker_id <> 'spk_1' AND position % 3 = 0 THEN 'user' END AS role_source FROM rows")
def speaker_map(spark, sf):
    rows = transcript(spark, sf).withColumn("role_source", F.when(F.col("position") % 3 == 0, "user"))
    mapping = rows.where("speaker_id = 'spk_1'").select("session_id", "speaker_id").distinct().withColumn("role", F.lit("PATIENT"))
    return relabel.apply_speaker_map(rows, mapping).select("segment_id", "role", "role_source")


@query("oc6_row_exceptions_applied", f"WITH {ROWS_SQL} SELECT segment_id, CASE WHEN text LIKE '%?%' OR position % 5 = 0 THEN 'UNKNOWN' ELSE role END AS role, CASE WHEN text LIKE '%?%' OR position % 5 = 0 THEN 'auto_row' END AS role_source FROM rows")
def row_exceptions(spark, sf):
    rows = transcript(spark, sf).withColumn("role_source", F.lit(None).cast("string"))
    odd = rows.where(F.col("text").contains("?") | (F.col("position") % 5 == 0)).select("segment_id", F.lit("UNKNOWN").alias("role"))
    return relabel.apply_exceptions(rows, odd).select("segment_id", "role", "role_source")


@query("oc7_oc8_oc9_map_precedence", f"WITH {ROWS_SQL}, s AS (SELECT session_id, speaker_id, CASE WHEN max(position) % 2 = 0 THEN 'DOCTOR' ELSE 'PATIENT' END AS inferred FROM rows GROUP BY ALL) SELECT session_id, speaker_id, CASE WHEN speaker_id = 'spk_0' THEN 'PATIENT' WHEN speaker_id = 'spk_2' THEN 'UNKNOWN' ELSE inferred END AS role FROM s")
def map_precedence(spark, sf):
    by = transcript(spark, sf).groupBy("session_id", "speaker_id").agg(F.when(F.max("position") % 2 == 0, "DOCTOR").otherwise("PATIENT").alias("role"))
    maps = by.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("speaker_id", "role"))).alias("m"))
    confirmed = F.map_filter("m", lambda k, _: k == "spk_0")
    kept = F.map_filter("m", lambda k, _: k != "spk_2")
    final = relabel.withdraw_omitted(F.col("m"), relabel.confirmed_over_inferred(kept, F.transform_values(confirmed, lambda _k, _v: F.lit("PATIENT"))))
    return maps.select("session_id", F.explode(final).alias("speaker_id", "role"))


@query("oc10_tidied_text", r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '([.!?])([A-Z])', '\1 \2', 'g'), '\s+([,.!?;:])', '\1', 'g'), '\s+', ' ', 'g')) AS tidy FROM documents")
def tidied(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.tidy_joined(F.col("text")).alias("tidy"))


@query("oc11_head_and_tail", "SELECT doc_id, CASE WHEN length(text) <= 2000 THEN text ELSE left(text, 500) || chr(10) || '...' || chr(10) || right(text, 1495) END AS short FROM documents")
def head_tail(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.head_and_tail(F.col("text"), 2000).alias("short"))


@query("oc12_attributed_text", f"WITH {ROWS_SQL} SELECT session_id, string_agg('[' || role || '] ' || text, chr(10) ORDER BY position) AS transcript FROM rows GROUP BY 1")
def attributed(spark, sf):
    return relabel.attributed_text(transcript(spark, sf))


@query("oc13_rows_within_budget", f"WITH {ROWS_SQL}, s AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY session_id ORDER BY position) AS fore, sum(length(text) + 1) OVER (PARTITION BY session_id ORDER BY position DESC) AS back, sum(length(text) + 1) OVER (PARTITION BY session_id) AS total FROM rows), h AS (SELECT *, coalesce(sum(CASE WHEN fore <= 500 THEN length(text) + 1 END) OVER (PARTITION BY session_id), 0) AS head FROM s) SELECT session_id, segment_id, position FROM h WHERE total <= 2000 OR fore <= 500 OR back + head <= 2000")
def budget(spark, sf):
    return relabel.within_budget(transcript(spark, sf), 2000).select("session_id", "segment_id", "position")


@query("oc15_trimmed_utterance", r"SELECT conv_id, turn, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 120) AS short FROM conversations")
def utterances(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.trimmed_utterance(F.col("text")).alias("short"))


@query("oc16_channel_union", f"WITH {ROWS_SQL}, u AS (SELECT session_id, segment_id, 'doctor_' || speaker_id AS speaker_id, 'DOCTOR' AS role, start_ms, end_ms FROM rows WHERE role = 'DOCTOR' UNION ALL SELECT session_id, segment_id, 'patient_' || speaker_id, 'PATIENT', start_ms, end_ms FROM rows WHERE role = 'PATIENT') SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY start_ms, end_ms, role, segment_id) - 1 AS position FROM u")
def channels(spark, sf):
    rows = transcript(spark, sf)
    both = relabel.channel_union(*((r, rows.where(F.col("role") == r)) for r in ("DOCTOR", "PATIENT")))
    return both.select("session_id", "segment_id", "speaker_id", "role", "start_ms", "end_ms", "position")


@query("oc17_word_chunks", r"WITH w AS (SELECT doc_id, i - 1 AS i, ws[i] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '\S+') AS ws FROM documents))) SELECT doc_id, i // 18 AS chunk, string_agg(word, ' ' ORDER BY i) AS text, CAST(i // 18 * 1000 AS BIGINT) AS start_ms, CAST((i // 18 + 1) * 1000 AS BIGINT) AS end_ms FROM w GROUP BY ALL")
def word_chunks(spark, sf):
    return relabel.chunked_words(table(spark, sf, "documents"), "doc_id", T.display_words(F.col("text")))


@query("oc18_word_shares", f"WITH {ROWS_SQL}, w AS (SELECT session_id, sum(len({_TOK.format('text')})) AS n FROM rows GROUP BY 1), s AS (SELECT r.session_id, position AS span, end_ms - start_ms AS d, n FROM rows r JOIN w USING (session_id)), c AS (SELECT *, coalesce(greatest(1, CAST(round_even(n * d / nullif(sum(d) OVER (PARTITION BY session_id), 0), 0) AS BIGINT)), 1) AS share, max(span) OVER (PARTITION BY session_id) AS final FROM s), t AS (SELECT *, CASE WHEN span = final THEN n ELSE least(sum(share) OVER (PARTITION BY session_id ORDER BY span), n) END AS upto FROM c) SELECT session_id, span, CAST(coalesce(lag(upto) OVER (PARTITION BY session_id ORDER BY span), 0) AS BIGINT) AS from_word, CAST(upto AS BIGINT) AS to_word FROM t")
def shares(spark, sf):
    rows = transcript(spark, sf)
    words = rows.groupBy("session_id").agg(F.sum(F.size(T.score_tokens(F.col("text")))).alias("n_words"))
    return relabel.word_shares(rows.select("session_id", F.col("position").alias("span"), (F.col("end_ms") - F.col("start_ms")).alias("duration_ms")), words)


@query("oc20_low_confidence_flag", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN value / 20 < 0.76 ELSE value / 20 < 0.78 END AS flagged FROM events")
def flagged(spark, sf):
    lane = F.when(F.col("event_id") % 2 == 0, "live").otherwise("corrected")
    return table(spark, sf, "events").select("event_id", relabel.low_confidence(lane, F.col("value") / 20).alias("flagged"))


@query("og6_row_words", f"WITH {ROWS_SQL} SELECT session_id, segment_id, i - 1 AS word_index, ws[i] AS word, abs(end_ms - start_ms - 50) < 1 AS floor_span FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT *, {_TOK.format('text')} AS ws FROM rows))")
def row_words(spark, sf):
    return transcript(spark, sf).select("session_id", "segment_id", F.posexplode(T.score_tokens(F.col("text"))).alias("word_index", "word"), (F.abs(F.col("end_ms") - F.col("start_ms") - 50) < 1).alias("floor_span"))


@query("og5_reference_corpus_order", f"WITH {ROWS_SQL} SELECT session_id, ordinal, row_number() OVER (PARTITION BY session_id ORDER BY ref_start, ref_end, ref_role, ordinal) - 1 AS place, EXISTS (SELECT 1 FROM refs o WHERE o.session_id = r.session_id AND o.ref_role <> r.ref_role AND o.ref_start < r.ref_end AND r.ref_start < o.ref_end) AS ambiguous FROM refs r")
def corpus_order(spark, sf):
    from pyspark.sql import Window

    from parlance.operators.intervals import overlap_join

    refs = reference(spark, sf)
    other = refs.select("session_id", F.col("ordinal").alias("o2"), F.col("ref_role").alias("r2"), F.col("ref_start").alias("s2"), F.col("ref_end").alias("e2"))
    hit = overlap_join(refs, other, ["session_id"], "ref_start", "ref_end", "s2", "e2").where("ref_role <> r2").select("session_id", "ordinal").distinct().withColumn("ambiguous", F.lit(True))
    w = Window.partitionBy("session_id").orderBy("ref_start", "ref_end", "ref_role", "ordinal")
    return refs.withColumn("place", F.row_number().over(w) - 1).join(hit, ["session_id", "ordinal"], "left").select("session_id", "ordinal", "place", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


@query("og1_word_errors", None)
def word_errors(spark, sf):
    rows = transcript(spark, sf).withColumn("w", T.score_tokens(F.col("text")))
    side = lambda name, cond: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("position", "w")))), lambda x: x["w"])).alias(name)
    by = rows.groupBy("session_id").agg(side("ref", F.col("position") % 2 == 1), side("hyp", F.col("position") % 2 == 0))
    return sequences.word_errors(by, "session_id", "ref", "hyp").withColumnRenamed("key", "session_id")


@query("og8_variant_pairs", None)
def variants(spark, sf):
    rows = transcript(spark, sf).select("session_id", "position", "segment_id", T.score_tokens(F.col("text")).alias("a"))
    after = rows.select("session_id", (F.col("position") - 2).alias("position"), F.col("segment_id").alias("other_id"), F.col("a").alias("b"))
    return sequences.variant_pairs(rows.join(after, ["session_id", "position"]), "a", "b").select("segment_id", "other_id", "lcs_ratio", "variant")


@query("og11_allocation_accounting", f"WITH {ROWS_SQL}, n AS (SELECT session_id, CAST(max(position) + 3 AS BIGINT) AS n FROM rows GROUP BY 1), u AS (SELECT session_id, unnest(range(position, position + 1 + position % 2)) AS i FROM rows), c AS (SELECT session_id, i, count(*) AS k FROM u GROUP BY ALL), b AS (SELECT session_id, count(*) FILTER (k > 1) AS dup, count(*) AS used FROM c GROUP BY 1) SELECT session_id, coalesce(dup, 0) AS duplicated, n - coalesce(used, 0) AS unallocated, coalesce(dup, 0) = 0 AND n = coalesce(used, 0) AS complete FROM n LEFT JOIN b USING (session_id)")
def allocation(spark, sf):
    rows = transcript(spark, sf)
    runs = rows.select("session_id", F.col("position").alias("a"), (F.col("position") + 1 + F.col("position") % 2).alias("b"))
    return sequences.allocation_check(runs, rows.groupBy("session_id").agg((F.max("position") + 3).alias("n")))


@query("og12_phrase_location", f"WITH {ROWS_SQL}, w AS (SELECT segment_id, {_TOK.format('text')} AS ws FROM rows), n AS (SELECT segment_id, ws, ws[3:5] AS needle FROM w) SELECT segment_id, CAST(CASE WHEN len(ws) >= len(needle) AND len(needle) > 0 THEN coalesce(list_position([ws[i:i + len(needle) - 1] = needle FOR i IN range(1, len(ws) - len(needle) + 2)], true), 0) - 1 ELSE -1 END AS BIGINT) AS place FROM n")
def location(spark, sf):
    words = T.score_tokens(F.col("text"))
    rows = transcript(spark, sf).select("segment_id", words.alias("ws")).withColumn("needle", F.slice("ws", 3, 3))
    return rows.select("segment_id", sequences.locate(F.col("needle"), F.col("ws")).cast("long").alias("place"))


@query("og14_token_times", f"WITH {ROWS_SQL}, w AS (SELECT *, {_TOK.format('text')} AS ws FROM rows) SELECT segment_id, i - 1 AS word_index, ws[i] AS word, CAST(start_ms + floor((end_ms - start_ms) * (i - 1) / len(ws)) AS BIGINT) AS start, CAST(start_ms + floor((end_ms - start_ms) * i / len(ws)) AS BIGINT) AS \"end\" FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM w)")
def times(spark, sf):
    timed = sequences.token_times(T.score_tokens(F.col("text")), F.col("start_ms"), F.col("end_ms"))
    return transcript(spark, sf).select("segment_id", F.posexplode(timed).alias("word_index", "t")).select("segment_id", "word_index", "t.word", "t.start", "t.end")


@query("oh1_shingle_duplication", f"WITH w AS (SELECT doc_id, unnest({_TOK.format('text')}) AS word, generate_subscripts({_TOK.format('text')}, 1) AS i FROM documents), g AS (SELECT doc_id, word || ' ' || lead(word, 1) OVER w || ' ' || lead(word, 2) OVER w || ' ' || lead(word, 3) OVER w AS gram FROM w WINDOW w AS (PARTITION BY doc_id ORDER BY i)) SELECT d.doc_id, coalesce(round(1 - count(DISTINCT gram) / nullif(count(gram), 0), 6), 0.0) AS duplication FROM documents d LEFT JOIN g USING (doc_id) GROUP BY 1")
def duplication(spark, sf):
    return sequences.duplication_share(table(spark, sf, "documents"), "doc_id", T.score_tokens(F.col("text")))


@query("oh2_seam_rereads", f"WITH {ROWS_SQL}, w AS (SELECT session_id, position, start_ms, {_TOK.format('text')} AS ws FROM rows), g AS (SELECT session_id, position, start_ms, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT *, unnest(range(1, len(ws) - 1)) AS i FROM w)) SELECT s.session_id, count(h.i) AS rereads FROM (SELECT DISTINCT session_id FROM rows) s LEFT JOIN (SELECT DISTINCT a.session_id, a.position, a.i FROM g a JOIN g b ON a.session_id = b.session_id AND a.gram = b.gram AND (b.start_ms < a.start_ms OR b.start_ms = a.start_ms AND b.position < a.position) AND a.start_ms - b.start_ms <= 60000) h ON h.session_id = s.session_id GROUP BY 1")
def rereads(spark, sf):
    return sequences.seam_rereads(transcript(spark, sf), T.score_tokens(F.col("text")), reach_ms=60000)


@query("oh3_missing_words", f"WITH {ROWS_SQL}, {_BAGS} SELECT session_id, word, rb.n - coalesce(hb.n, 0) AS n FROM rb LEFT JOIN hb USING (session_id, word) WHERE rb.n > coalesce(hb.n, 0)")
def missing(spark, sf):
    ref, hyp = _bags(spark, sf)
    return sequences.bag_difference(ref, hyp, ["session_id"])


@query("oh4_surplus_words", f"WITH {ROWS_SQL}, {_BAGS} SELECT session_id, word, hb.n - coalesce(rb.n, 0) AS n FROM hb LEFT JOIN rb USING (session_id, word) WHERE hb.n > coalesce(rb.n, 0)")
def surplus(spark, sf):
    ref, hyp = _bags(spark, sf)
    return sequences.bag_difference(hyp, ref, ["session_id"])


@query("oh5_surplus_classes", f"WITH {ROWS_SQL}, {_BAGS}, k AS (SELECT coalesce(h.session_id, r.session_id) AS session_id, coalesce(r.n, 0) AS rn, coalesce(h.n, 0) AS hn FROM hb h FULL JOIN rb r ON h.session_id = r.session_id AND h.word = r.word), t AS (SELECT session_id, CAST(sum(rn) AS BIGINT) AS reference_words, CAST(sum(hn) AS BIGINT) AS hypothesis_words, CAST(sum(greatest(rn - hn, 0)) AS BIGINT) AS missing, CAST(coalesce(sum(hn - rn) FILTER (hn > rn AND rn > 0), 0) AS BIGINT) AS duplicates, CAST(coalesce(sum(hn) FILTER (rn = 0), 0) AS BIGINT) AS other FROM k GROUP BY 1) SELECT session_id, reference_words, hypothesis_words, missing, duplicates, CASE WHEN missing > 0 THEN other ELSE 0 END AS garbled, CASE WHEN missing > 0 THEN 0 ELSE other END AS insertions, round(CASE WHEN missing > 0 THEN 0 ELSE other END / nullif(reference_words, 0), 6) AS insertion_rate, round(missing / nullif(reference_words, 0), 6) AS omission_rate, round(duplicates / nullif(hypothesis_words, 0), 6) AS duplicate_rate FROM t")
def classes(spark, sf):
    ref, hyp = _bags(spark, sf)
    return sequences.surplus_classes(ref, hyp, ["session_id"])


@query("oh6_vocabulary_recall", f"WITH {ROWS_SQL}, {_WORDS} SELECT r.session_id, round((SELECT count(DISTINCT h.word) FROM hyp h WHERE h.session_id = r.session_id AND h.word IN (SELECT word FROM ref q WHERE q.session_id = r.session_id)) / nullif(count(DISTINCT r.word), 0), 6) AS recall, round((SELECT count(*) FROM hyp h WHERE h.session_id = r.session_id) / nullif(count(*), 0), 6) AS length_ratio FROM ref r GROUP BY r.session_id")
def recall(spark, sf):
    ref, hyp = _bags(spark, sf)
    a = ref.groupBy("session_id").agg(F.collect_set("word").alias("r"), F.count(F.lit(1)).alias("n"))
    b = hyp.groupBy("session_id").agg(F.collect_set("word").alias("h"), F.count(F.lit(1)).alias("m"))
    none = F.array().cast("array<string>")
    return a.join(b, "session_id", "left").select("session_id", T.rate(F.size(F.array_intersect("r", F.coalesce("h", none))), F.size("r")).alias("recall"), T.rate(F.coalesce("m", F.lit(0)), F.col("n")).alias("length_ratio"))


@query("oh7_surplus_turns", f"WITH {ROWS_SQL}, s AS (SELECT session_id, role, array_to_string({_TOK.format('text')}, ' ') AS norm, count(*) AS n FROM rows GROUP BY ALL), r AS (SELECT session_id, ref_role AS role, array_to_string({_TOK.format('ref_text')}, ' ') AS norm, count(*) AS m FROM refs GROUP BY ALL) SELECT session_id, norm, n - greatest(coalesce(m, 0), 1) AS surplus FROM s LEFT JOIN r USING (session_id, role, norm) WHERE n > greatest(coalesce(m, 0), 1)")
def turns(spark, sf):
    wording = lambda c: F.array_join(T.score_tokens(F.col(c)), " ")
    return sequences.surplus_turns(transcript(spark, sf), reference(spark, sf), wording("text"), wording("ref_text"))


@query("oh8_turn_coherence", f"WITH {ROWS_SQL}, n AS (SELECT *, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS norm, FROM rows) SELECT session_id, segment_id, concat_ws(',', CASE WHEN lag(speaker_id) OVER w = speaker_id AND lag(role) OVER w <> role THEN 'identity' END, CASE WHEN lag(start_ms) OVER w > start_ms THEN 'chronology' END, CASE WHEN lag(norm) OVER w = norm AND norm <> '' THEN 'wording' END, CASE WHEN lag(role) OVER w = role THEN 'role' END) AS defects FROM n WINDOW w AS (PARTITION BY session_id ORDER BY position)")
def coherent(spark, sf):
    return sequences.coherence(transcript(spark, sf), T.norm_duplicate(F.col("text")))


@query("oh15_word_stream_fingerprint", f"WITH {ROWS_SQL} SELECT session_id, sha256(string_agg(array_to_string({_TOK.format('text')}, ' '), ' ' ORDER BY position)) AS fingerprint FROM rows GROUP BY 1")
def fingerprint(spark, sf):
    rows = transcript(spark, sf).withColumn("line", F.array_join(T.score_tokens(F.col("text")), " "))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"])
    return rows.groupBy("session_id").agg(F.sha2(F.array_join(lines, " "), 256).alias("fingerprint"))


@query("oh16_opaque_pair_id", f"WITH {ROWS_SQL} SELECT a.segment_id AS first_id, b.segment_id AS second_id, left(sha256('[\"' || a.segment_id || '\",\"' || b.segment_id || '\"]'), 16) AS pair_id FROM rows a JOIN rows b ON a.session_id = b.session_id AND b.position = a.position + 1")
def pair_id(spark, sf):
    rows = transcript(spark, sf)
    after = rows.select("session_id", (F.col("position") - 1).alias("position"), F.col("segment_id").alias("second_id"))
    pair = rows.join(after, ["session_id", "position"]).select(F.col("segment_id").alias("first_id"), "second_id")
    return pair.withColumn("pair_id", F.left(F.sha2(F.to_json(F.array("first_id", "second_id")), 256), F.lit(16)))


@query("ox_op40_slugs", "SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages")
def slugs(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


@query("ox_op31_op32_session_extent", f"WITH {ROWS_SQL} SELECT session_id, coalesce(max(end_ms), 0) AS duration_ms, count(DISTINCT nullif(speaker_id, '')) >= 2 AS two_speakers FROM rows GROUP BY 1")
def extent(spark, sf):
    return transcript(spark, sf).groupBy("session_id").agg(F.coalesce(F.max("end_ms"), F.lit(0)).alias("duration_ms"), (F.count_distinct(F.nullif(F.col("speaker_id"), F.lit(""))) >= 2).alias("two_speakers"))
