"""Audits of lists, gates and records: set differences, validators, one disposition from many checks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import rate, score_tokens


def mean_accuracy(events: DataFrame, by: list[str], value: Column) -> DataFrame:
    return events.groupBy(*by).agg(F.count(value).alias("evals"), F.round(F.avg(value), 6).alias("accuracy"))


def continuity_sums(windows: DataFrame) -> DataFrame:
    """Each session's windows, those with remaps, all remaps, and emitted and held rows."""
    return windows.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("windows"),
        F.count_if(F.col("remaps") > 0).alias("with_remaps"),
        F.sum("remaps").alias("remaps"),
        F.sum("emitted").alias("emitted"),
        F.sum("held").alias("held"),
    )


def tool_rates(calls: DataFrame, by: list[str], tool: str, ok: Column, most: int) -> DataFrame:
    """Calls and success rate of each key's `most` used tools; ties go to the first name."""
    each = calls.groupBy(*by, tool).agg(F.count(F.lit(1)).alias("calls"), F.count_if(ok).alias("succeeded"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("calls"), tool))
    return each.withColumn("_rank", rank).where(F.col("_rank") <= most).select(*by, tool, "calls", rate(F.col("succeeded"), F.col("calls")).alias("success_rate"))


def summary(value: Column) -> Column:
    """Struct of count, p50, p95 (interpolated) and max; all null but the count where nothing is measured."""
    return F.struct(F.count(value).alias("count"), F.round(F.percentile(value, F.lit(0.5)), 6).alias("p50"), F.round(F.percentile(value, F.lit(0.95)), 6).alias("p95"), F.max(value).alias("max"))


def quality_record(rows: DataFrame, events: DataFrame, flips: DataFrame) -> DataFrame:
    """One record for each session of `rows`: stored rows, duration, latency summary, errors and label flips."""
    kept = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("stored_segments"), F.max("end_ms").alias("duration_ms"))
    seen = events.groupBy("session_id").agg(summary(F.col("value")).alias("latency"), F.count_if(F.col("event") == "error").alias("error_count"))
    both = kept.join(seen, "session_id", "left").join(flips, "session_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return both.select("session_id", F.lit("finalized").alias("status"), "stored_segments", "duration_ms", zero(F.col("latency.count")).alias("latency_count"), "latency.p50", "latency.p95", F.col("latency.max").alias("latency_max"), zero(F.col("error_count")).alias("error_count"), zero(F.col("flips")).alias("role_flips_accepted"))


def expected_matches(expected: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """(session_id, speakers, matched, accuracy): a speaker that nobody mapped doesn't match."""
    both = expected.withColumnRenamed("role", "_want").join(actual.select(*key, "role"), key, "left")
    hit = F.count_if(F.col("role") == F.col("_want"))
    return both.groupBy("session_id").agg(F.count(F.lit(1)).alias("speakers"), hit.alias("matched"), rate(hit, F.count(F.lit(1))).alias("accuracy"))


def review_counters(notes: DataFrame, sentences: str) -> DataFrame:
    """(note_id, uncited, reason_flagged, wording): counts over an array of structs (cited, reason, wording)."""
    count = lambda f: F.size(F.filter(sentences, f))
    return notes.select("note_id", count(lambda x: x["cited"] == 0).alias("uncited"), count(lambda x: x["reason"].isNotNull()).alias("reason_flagged"), count(lambda x: x["wording"]).alias("wording"))


def keyword_collisions(keywords: DataFrame) -> DataFrame:
    """(short, long, kind) of keywords of different owners, equal or one within the other.

    Keywords meet through the longer one's parts between blanks and all runs of
    them, so the table isn't joined with itself row by row; a keyword within a
    word of another counts if it is at least three characters long.
    """
    each = keywords.select("owner", F.lower(F.trim("keyword")).alias("k")).distinct()
    n = F.length("k")
    starts = F.sequence(F.lit(1), n)
    parts = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda m: F.substring(F.col("k"), i, m))))
    inside = each.select(F.col("owner").alias("o"), F.col("k").alias("long"), F.explode(F.array_distinct(F.filter(parts, lambda p: F.length(p) >= 3))).alias("k"))
    hit = each.join(inside, "k").where("owner <> o")
    return hit.select(F.col("k").alias("short"), "long", F.when(F.col("k") == F.col("long"), "equal").otherwise("substring").alias("kind")).distinct()


def is_iso_date(text: Column) -> Column:
    return text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull()


def is_sha256(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{64}$")


def is_slug(text: Column) -> Column:
    return text.rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$")


def fired_negatives(negatives: DataFrame, keywords: list[str]) -> DataFrame:
    """(text_id, fired): texts that must not fire, with the keywords that do."""
    low = F.lower("text")
    fired = F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(low, k))
    return negatives.select("text_id", F.array_join(fired, ",").alias("fired")).where("fired <> ''")


def ledger_scores(ledger: DataFrame, rewritten: Column, original: Column, expected: Column, guard: Column) -> DataFrame:
    """Rows of a review ledger: fixed, missed, or for guards kept, broken."""
    verdict = F.when(guard, F.when(rewritten == original, "kept").otherwise("broken")).otherwise(F.when(rewritten == expected, "fixed").otherwise("missed"))
    return ledger.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("rows"))


def gate_disposition(gates: DataFrame, required: list[str]) -> DataFrame:
    """(run, disposition): fails closed; a required gate that is missing or unknown counts as failed."""
    found = gates.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("gate", "state"))).alias("m"))
    need = F.array(*map(F.lit, required))
    state = lambda g: F.coalesce(F.element_at("m", g), F.lit("missing"))
    bad = F.exists(need, lambda g: ~state(g).isin("pass", "alert"))
    return found.select("run", F.when(bad, "rejected").when(F.exists(need, lambda g: state(g) == "alert"), "review").otherwise("accepted").alias("disposition"))


def _nesting(json: Column) -> Column:
    """How deep brackets of a JSON text nest, strings left out."""
    bare = F.regexp_replace(json, r'"(?:\\.|[^"\\])*+"', "")
    steps = F.transform(F.regexp_extract_all(bare, F.lit(r"[\[\]{}]"), F.lit(0)), lambda c: F.when(c.isin("[", "{"), 1).otherwise(-1))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    after = lambda a, x: F.struct((a["now"] + x).alias("now"), F.greatest(a["most"], a["now"] + x).alias("most"))
    return F.aggregate(steps, start, after, lambda a: a["most"])


def forbidden_keys(records: DataFrame, json: str, forbidden: list[str]) -> DataFrame:
    """(record_id, path) of forbidden keys of JSON values: in objects and arrays, at any depth, in any case.

    Each level of nesting is a projection; how many there are is measured first.
    Keys that aren't plain words stand in quotes in a path. A text that isn't
    JSON, and null, have no keys.
    """
    spark = records.sparkSession
    level = records.select("record_id", F.lit("$").alias("path"), F.try_parse_json(json).alias("node")).where("node is not null")
    depth = records.agg(F.max(_nesting(F.col(json)))).first()[0] or 0
    found = spark.createDataFrame([], f"record_id {records.schema['record_id'].dataType.simpleString()}, path string")
    for _ in range(depth):
        each = spark.sql("SELECT record_id, path, e.pos, e.key, e.value FROM {level}, LATERAL variant_explode(node) AS e", level=level)
        name = F.when(F.col("key").rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.col("key")).otherwise(F.concat(F.lit('"'), F.replace(F.replace("key", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), name))
        each = each.select("record_id", F.concat("path", step).alias("path"), "key", F.col("value").alias("node"))
        found = found.unionByName(each.where(F.lower("key").isin([k.lower() for k in forbidden])).select("record_id", "path"))
        level = each.select("record_id", "path", "node")
    return found


def refreshed(old: DataFrame, new: DataFrame, key: str, selected: Column) -> DataFrame:
    """A catalog after a refresh: selected keys take the new row if there is one and go if not; other rows and the order stay, new keys come last."""
    a = old.withColumn("_old", F.lit(True)).withColumnRenamed("value", "_was")
    b = new.withColumn("_new", F.lit(True)).withColumnRenamed("ord", "_ord")
    both = a.join(b, key, "full").where(F.col("_old").isNull() | F.col("_new").isNotNull() | ~selected)
    value = F.when(F.col("_new").isNotNull() & (F.col("_old").isNull() | selected), F.col("value")).otherwise(F.col("_was"))
    return both.select(key, value.alias("value"), F.coalesce("ord", F.col("_ord") + 1_000_000_000).alias("ord"))


def selection(requested: DataFrame, approved: DataFrame, key: str) -> DataFrame:
    """(key, ord, state) of requested and approved entries: chosen in the frozen order, duplicate, unknown or left out."""
    asked = requested.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    both = approved.join(asked, key, "full")
    state = F.when(F.col("ord").isNull(), "unknown").when(F.col("n").isNull(), "left_out").when(F.col("n") > 1, "duplicate").otherwise("chosen")
    return both.select(key, "ord", state.alias("state"))


def confidence_summary(rows: DataFrame, by: list[str], value: str, order: list[str], head: int = 12) -> DataFrame:
    """count, min, max, mean, share of ones and the first `head` values; only those are gathered."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    v = F.col(value)
    first = F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") <= head, F.struct("_n", value)))), lambda x: x[value].cast("string"))
    return rows.where(v.isNotNull()).withColumn("_n", nth).groupBy(*by).agg(F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), F.round(F.avg(v), 6).alias("mean"), rate(F.count_if(v == 1), F.count(v)).alias("ones"), F.array_join(first, ",").alias("first"))


def scraped_metric(text: Column, label: str) -> Column:
    """The number after a label and a colon in a report; null without one."""
    return F.regexp_extract(text, rf"{label}:\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double")


def uuid5(space: uuid.UUID, name: Column) -> Column:
    """The name's version-5 UUID in a name space, from SHA-1 with built-in functions."""
    digest = F.sha1(F.concat(F.unhex(F.lit(space.hex)), F.encode(name, "UTF-8")))
    part = lambda a, n: F.substring(digest, a, n)
    variant = F.lower(F.hex((F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def arm_comparison(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(rows, worsened, newly_wrong, verdict) of two arms' rows (key, rank, wrong): any row that got worse fails the gate."""
    both = a.join(b.select(key, F.col("rank").alias("_rank"), F.col("wrong").alias("_wrong")), key, "full")
    worse = F.coalesce(F.col("_rank") < F.col("rank"), F.lit(True))
    fresh = F.coalesce(F.col("_wrong") & ~F.col("wrong"), F.lit(False))
    found = both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(worse).alias("worsened"), F.count_if(fresh).alias("newly_wrong"))
    return found.withColumn("verdict", F.when(F.col("worsened") + F.col("newly_wrong") > 0, "fail").otherwise("pass"))


def key_values(lines: DataFrame, line: str) -> DataFrame:
    """(file, key, value, repeated) of `key=value` lines; blanks around either go, other lines are left out."""
    parts = F.split(F.col(line), "=", 2)
    each = lines.where(F.contains(line, F.lit("="))).select("file", F.trim(parts[0]).alias("key"), F.trim(parts[1]).alias("value")).where("key <> ''")
    return each.groupBy("file", "key").agg(F.min("value").alias("value"), (F.count(F.lit(1)) > 1).alias("repeated"))


def variant_owners(lexicon: DataFrame) -> DataFrame:
    """(variant, owners) of variants that more than one canonical names."""
    return lexicon.groupBy(F.lower("variant").alias("variant")).agg(F.count_distinct("canonical").alias("owners")).where("owners > 1")


def stable_sources(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, stable): digests are equal and both are there."""
    both = before.select(key, F.col(digest).alias("_a")).join(after.select(key, F.col(digest).alias("_b")), key, "full")
    return both.select(key, F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).alias("stable"))


def source_state(corrected_rows: Column, corrected_hash: Column, live_hash: Column, seal_hash: Column) -> Column:
    """Which rows a note may use: corrected, live_fallback if the live rows are those sealed, stale if not, else pending."""
    return F.when((corrected_rows > 0) & corrected_hash.isNotNull(), "corrected").when(seal_hash.isNull(), "pending").when(live_hash.eqNullSafe(seal_hash), "live_fallback").otherwise("stale")


def source_lines(rows: DataFrame) -> DataFrame:
    """(segment_id, line): `[n] ROLE: text` with rows numbered from 1 in each session."""
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("position"))
    return rows.select("segment_id", F.concat(F.lit("["), n, F.lit("] "), "role", F.lit(": "), "text").alias("line"))


def guarded_mapping(hint: Column, model: Column, inverse: Column, confirmed: Column) -> Column:
    """The model's mapping, or the hint where the model has none or proposes the hint's exact inverse that nobody confirmed."""
    return F.when(model.isNull(), hint).when(inverse & hint.isNotNull() & ~confirmed, hint).otherwise(model)


def valid_claims(claims: DataFrame, units: DataFrame) -> DataFrame:
    """(claim_id, units, basis): known units once each; a claim left without a unit rests on nothing."""
    each = claims.select("claim_id", "session_id", F.posexplode("cited").alias("at", "segment_id")).join(units.select("session_id", "segment_id"), ["session_id", "segment_id"], "left_semi")
    first = each.groupBy("claim_id", "segment_id").agg(F.min("at").alias("at"))
    listed = first.groupBy("claim_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "segment_id"))), lambda x: x["segment_id"]), ",").alias("units"))
    return claims.select("claim_id").join(listed, "claim_id", "left").select("claim_id", F.coalesce("units", F.lit("")).alias("units"), F.when(F.col("units").isNull(), "none").otherwise("source_unit").alias("basis"))


def duplicate_report(rows: DataFrame) -> DataFrame:
    """(session_id, rows, words, repeated_rows) and, in a row without session, the totals."""
    words = F.array_join(score_tokens(F.col("text")), " ")
    each = rows.select("session_id", words.alias("w"), F.size(score_tokens(F.col("text"))).alias("n")).groupBy("session_id", "w").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"))
    more = F.sum(F.when(F.col("w") != "", F.col("c") - 1).otherwise(0))
    return each.rollup("session_id").agg(F.sum("c").alias("rows"), F.sum("n").alias("words"), more.alias("repeated_rows"))


def parity(runtime: DataFrame, review: DataFrame, key: str) -> DataFrame:
    """(key, finding) of runtime entries against reviewed ones (key, active): missing, extra, inactive_executable or duplicate."""
    a = runtime.groupBy(key).agg(F.count(F.lit(1)).alias("a"))
    b = review.groupBy(key).agg(F.count(F.lit(1)).alias("b"), F.bool_or("active").alias("active"))
    found = F.array_compact(F.array(F.when(F.col("a").isNull() & F.col("active"), "missing"), F.when(F.col("b").isNull(), "extra"), F.when(F.col("a").isNotNull() & ~F.col("active"), "inactive_executable"), F.when((F.col("a") > 1) | (F.col("b") > 1), "duplicate")))
    return a.join(b, key, "full").select(key, F.explode(found).alias("finding"))


def finding_counts(findings: DataFrame, identity: list[str], status: str) -> DataFrame:
    """(status, findings) of findings that are counted once for each identity, the least status standing for it."""
    return findings.groupBy(*identity).agg(F.min(status).alias(status)).groupBy(status).agg(F.count(F.lit(1)).alias("findings"))


def variant_counts(rows: DataFrame, lexicon: list[tuple[str, list[str]]]) -> DataFrame:
    """(canonical, variant, hits): whole words in any case, blanks of any width between a variant's words."""
    listed = [F.struct(F.lit(c).alias("canonical"), F.lit(v).alias("variant"), F.regexp_count("text", F.lit(r"(?i)\b" + r"\s+".join(v.split()) + r"\b")).alias("hits")) for c, vs in lexicon for v in vs]
    return rows.select(F.explode(F.array(*listed)).alias("x")).select("x.*").groupBy("canonical", "variant").agg(F.sum("hits").alias("hits"))


def strong_exception(own: Column, other: Column, strong: Column, n_words: Column) -> Column:
    """keep, UNKNOWN or flip: cues of both roles are unclear; five words with two cues or a strong one of the other role flip."""
    return F.when((other > 0) & (own > 0), "UNKNOWN").when((n_words >= 5) & ((other >= 2) | strong), "flip").otherwise("keep")
