"""Queries of the validators, over events as reviewed pairs and probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import validators as V
from parlance.plans.registry import query
from parlance.sources.adapt import table

#: Columns of a pair made from event_id (i) and user_id (u), as SQL that both engines take.
_PAIR = {
    "status": "CASE WHEN event_id % 5 < 3 THEN 'active' WHEN event_id % 5 = 3 THEN 'disabled' WHEN event_id % 2 = 0 THEN 'paused' END",
    "category": "CASE event_id % 6 WHEN 0 THEN 'semantic_synonym' WHEN 1 THEN 'ambiguous_product' WHEN 2 THEN 'other' ELSE 'asr_variant' END",
    "review": "CASE WHEN event_id % 3 = 0 THEN 'pending' ELSE 'approved' END",
    "canonical": "concat(event_type, ' ', user_id)",
    "variant": "concat(event_type, ' of ', user_id)",
    "raw_text": "CASE WHEN event_id % 4 = 1 THEN event_type ELSE concat(event_type, ' of ', user_id) END",
    "visible_text": "CASE WHEN event_id % 7 = 1 THEN NULL ELSE concat(event_type, ' ', user_id) END",
    "evidence": "CASE WHEN event_id % 8 = 1 THEN 'generic' ELSE 'approved_synthetic_asr_fixture' END",
    "locale": "CASE WHEN event_id % 9 = 1 THEN 'en-GB' ELSE 'en-AU' END",
    "consumer": "CASE WHEN event_id % 10 = 1 THEN NULL ELSE 'live_post_asr_normalizer' END",
    "guard": "CASE WHEN event_id % 11 = 1 THEN NULL WHEN event_id % 11 = 2 THEN concat('never ', event_type, '  OF ', user_id, ', never') ELSE concat('say ', event_type) END",
    "rationale": "CASE WHEN event_id % 12 = 1 THEN ' ' WHEN event_id % 12 = 2 THEN 'ask a.b@example.org' WHEN event_id % 12 = 3 THEN 'call 0412 345 678' ELSE 'seen' END",
}
_FAILS = {
    "review.invalid_status": "status IS NULL OR status NOT IN ('active', 'disabled', 'rejected')",
    "review.invalid_category": "category = 'other'",
    "review.unapproved_active_pair": "status = 'active' AND review <> 'approved'",
    "review.active_semantic_synonym": "status = 'active' AND category = 'semantic_synonym'",
    "review.active_ambiguous_product": "status = 'active' AND category = 'ambiguous_product'",
    "review.active_text_mismatch": "status = 'active' AND (raw_text <> variant OR visible_text IS NULL OR visible_text <> canonical)",
    "review.generic_active_provenance": "status = 'active' AND evidence = 'generic'",
    "review.invalid_consumer": "locale <> 'en-AU' OR consumer IS NULL",
    "review.missing_hard_negative": "guard IS NULL",
    "review.hard_negative_collision": "status = 'active' AND contains(' ' || trim(regexp_replace(lower(guard), '[^a-z0-9'']+', ' ', 'g')) || ' ', ' ' || lower(variant) || ' ')",
    "review.missing_safety_rationale": "trim(rationale) = ''",
    "privacy.private_value": "regexp_matches(rationale, '@|0412')",
}
_SQL = f"""WITH p AS (SELECT event_id AS record_id, {", ".join(f"{v} AS {k}" for k, v in _PAIR.items())} FROM events),
f AS ({" UNION ALL ".join(f"SELECT record_id, '{code}' AS code FROM p WHERE {fails}" for code, fails in _FAILS.items())}
  UNION ALL SELECT record_id, 'review.duplicate_pair' FROM (SELECT record_id, count(*) OVER (PARTITION BY canonical, variant) AS n FROM p) WHERE n > 1)
SELECT record_id, code, left(sha256(code || '|' || record_id), 16) AS finding_id FROM f"""


@query("ox_op21_pair_findings", _SQL)
def pair_findings(spark, sf):
    pairs = table(spark, sf, "events").selectExpr("event_id AS record_id", *(f"{v} AS {k}" for k, v in _PAIR.items())).withColumn("hard_negatives", F.when(F.col("guard").isNotNull(), F.array("guard")))
    return V.findings(pairs, V.pair_rules()).unionByName(V.duplicate_pairs(pairs)).drop("asks")


@query("ox_op18_leaked_context", "SELECT event_id AS probe_id, CASE WHEN event_id % 4 = 0 THEN event_type ELSE '<prompt>' END AS entry_id FROM events WHERE event_id % 7 <> 5 AND event_id % 3 = 0 AND (event_id % 4 = 0 OR event_id % 5 = 0)")
def leaked(spark, sf):
    i, some = F.col("event_id"), lambda on: F.when(on, F.array("event_type"))
    probes = table(spark, sf, "events").select(i.alias("probe_id"), F.when(i % 7 != 5, i % 3 != 0).alias("context_enabled"), some(i % 4 == 0).alias("entry_ids"), some(i % 5 == 0).alias("snippets"))
    return V.leaked_context(probes)
