"""Notes against transcripts: citations, grounding of claims, terms, roles by cues, and the rows that speak for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import rate, score_tokens
from parlance.operators.folds import fold

# Fixed values of the rules; times in milliseconds.
FRAGMENT_GAP, FRAGMENT_WORDS, FRAGMENT_MS, UNIT_CHARS = 400, 3, 1000, 700
LINKED_MS, LINKED_RATIO, SILENCE_MS, OVERLAP_MS, REVIEW_BELOW, CARDS = 3000, 2, 3000, 150, 78, 3
#: Words of one interjection that does not end what the other speaker says.
BRIDGE = 3


def padded(text: Column) -> Column:
    """The scored words of a text between single blanks, with one at either end."""
    return F.concat(F.lit(" "), F.array_join(score_tokens(text), " "), F.lit(" "))


def resolved_citations(citations: DataFrame, rows: DataFrame) -> DataFrame:
    """(session_id, claim_id, cited, ord) of citations of rows that are there, the first of repeated ones."""
    known = rows.select("session_id", F.col("segment_id").alias("cited"))
    return citations.groupBy("session_id", "claim_id", "cited").agg(F.min("ord").alias("ord")).join(known, ["session_id", "cited"], "left_semi")


def unresolved_citations(citations: DataFrame, rows: DataFrame) -> DataFrame:
    """session_id, citations, unresolved and their share."""
    known = rows.select("session_id", F.col("segment_id").alias("cited"), F.lit(1).alias("known"))
    each = citations.join(known, ["session_id", "cited"], "left")
    n, lost = F.count(F.lit(1)), F.count_if(F.col("known").isNull())
    return each.groupBy("session_id").agg(n.alias("citations"), lost.alias("unresolved"), rate(lost, n).alias("share"))


def aligned(findings: DataFrame, diagnostics: DataFrame, key: list[str], same: list[str]) -> DataFrame:
    """Findings with their diagnostics by key; fails where a column of `same` differs or is null on one side."""
    other = diagnostics.select(*key, *[F.col(c).alias(f"_{c}") for c in same], *[c for c in diagnostics.columns if c not in (*key, *same)])
    both = findings.join(other, key)
    for c in same:
        fits = F.col(c).eqNullSafe(F.col(f"_{c}"))
        both = both.withColumn(c, F.when(fits, F.col(c)).otherwise(F.raise_error(F.lit(f"rows are not aligned: {c}"))))
    return both.drop(*[f"_{c}" for c in same])


def linkage(pairs: DataFrame) -> DataFrame:
    """Each rebuilt voice's overlap with each live slot, from (session_id, voice, slot, overlap_ms)."""
    return pairs.groupBy("session_id", "voice", "slot").agg(F.sum("overlap_ms").alias("linked_ms"))


def span_decision(linked: DataFrame) -> DataFrame:
    """(session_id, voice, slot, linked_ms, decision): the slot linked most replaces the live one only if it is clear.

    Under LINKED_MS there is no evidence, under LINKED_RATIO times the second it
    is ambiguous, and a voice linked with its own slot changes nothing.
    """
    order = Window.partitionBy("session_id", "voice").orderBy(F.desc("linked_ms"), "slot")
    top = linked.withColumn("second", F.coalesce(F.lead("linked_ms").over(order), F.lit(0))).withColumn("rank", F.row_number().over(order)).where("rank = 1")
    decision = F.when(F.col("linked_ms") < LINKED_MS, "keep_live_weak_linkage").when(F.col("linked_ms") < LINKED_RATIO * F.col("second"), "keep_live_ambiguous_linkage").when(F.col("voice") == F.col("slot"), "keep_live_same_voice").otherwise("replace")
    return top.select("session_id", "voice", "slot", "linked_ms", decision.alias("decision"))


def card_hits(rows: DataFrame, cards: list[tuple[str, list[str]]]) -> DataFrame:
    """(session_id, card, ord, hits): how many of a card's keywords occur in any row; cards without one have no row."""
    words = F.array(*[F.struct(F.lit(c).alias("card"), F.lit(i).alias("ord"), F.lit(w).alias("word")) for i, (c, ws) in enumerate(cards) for w in ws])
    low = F.lower("text")
    each = rows.select("session_id", F.explode(F.filter(words, lambda x: F.contains(low, x["word"]))).alias("x")).select("session_id", "x.*").distinct()
    return each.groupBy("session_id", "card", "ord").agg(F.count(F.lit(1)).alias("hits"))


def top_cards(hits: DataFrame, k: int = CARDS) -> DataFrame:
    """The k cards of each session with most hits; ties go to the card listed first."""
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("hits"), "ord"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("session_id", "rank", "card", "hits")


def phrase_uses(rows: DataFrame, phrases: list[str]) -> DataFrame:
    """(phrase, uses, first): utterances that hold a phrase as whole words, and the first of them."""
    text = padded(F.col("text"))
    found = F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(text, F.concat(F.lit(" "), p, F.lit(" "))))
    return rows.select("segment_id", F.explode(found).alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("uses"), F.min("segment_id").alias("first"))


def fragment_step(state: dict | None, row: dict) -> tuple[dict, list[dict]]:
    """A row joins the one before if they share the speaker, lie close, and either is a fragment; what is joined is judged anew."""
    words = len(row["text"].split())
    if state:
        short = lambda n, a, z: n < FRAGMENT_WORDS or z - a < FRAGMENT_MS
        fits = state["speaker_id"] == row["speaker_id"] and state["n_words"] and words and row["start_ms"] - state["end_ms"] <= FRAGMENT_GAP
        if fits and (short(state["n_words"], state["start_ms"], state["end_ms"]) or short(words, row["start_ms"], row["end_ms"])):
            return {**state, "n_words": state["n_words"] + words, "end_ms": max(state["end_ms"], row["end_ms"])}, [{**row, "into": state["position"]}]
    return {**row, "n_words": words}, [{**row, "into": row["position"]}]


def merged_fragments(rows: DataFrame) -> DataFrame:
    """(session_id, position, n_rows, start_ms, end_ms, text): rows with the fragments of their speaker joined to them."""
    kind = "session_id long, position long, speaker_id string, text string, start_ms long, end_ms long, into long"
    each = fold(rows.select("session_id", F.col("position").cast("long").alias("position"), "speaker_id", "text", "start_ms", "end_ms"), ["session_id"], ["position"], fragment_step, kind)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), " ")
    return each.groupBy("session_id", "into").agg(F.count(F.lit(1)).alias("n_rows"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), text.alias("text")).withColumnRenamed("into", "position")


def unit_step(state: dict | None, row: dict) -> tuple[dict, list[dict]]:
    """A unit ends where the role changes, or after the sentence in which it passed UNIT_CHARS."""
    text = row["text"]
    if state is None:
        unit, chars = 0, 0
    elif state["role"] != row["role"] or (state["chars"] > UNIT_CHARS and state["ended"]):
        unit, chars = state["unit"] + 1, 0
    else:
        unit, chars = state["unit"], state["chars"]
    out = {"session_id": row["session_id"], "position": row["position"], "unit": unit}
    return {"role": row["role"], "unit": unit, "chars": chars + len(text), "ended": text.rstrip(" ").endswith((".", "!", "?"))}, [out]


def source_units(rows: DataFrame) -> DataFrame:
    """(session_id, position, unit): the source unit of each row."""
    rows = rows.select("session_id", F.col("position").cast("long").alias("position"), "role", "text")
    return fold(rows, ["session_id"], ["position"], unit_step, "session_id long, position long, unit long")


def grouped_assignments(words: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """(session_id, run, key, n_words, start_ms, end_ms, text): adjacent words with one key as a row."""
    w = Window.partitionBy("session_id").orderBy(*order)
    each = words.withColumn("key", key).withColumn("_at", F.row_number().over(w))
    fresh = (~F.col("key").eqNullSafe(F.lag("key").over(w))) | (F.col("_at") == 1)
    each = each.withColumn("_fresh", fresh.cast("int")).withColumn("run", F.sum("_fresh").over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "word"))), lambda x: x["word"]), " ")
    return each.groupBy("session_id", "run", "key").agg(F.count(F.lit(1)).alias("n_words"), F.min("w_start").alias("start_ms"), F.max("w_end").alias("end_ms"), text.alias("text"))


def row_diagnostics(judged: DataFrame, windows: DataFrame) -> DataFrame:
    """Expected role, correct, confidently wrong, and whether a row is the first of its emission window."""
    first = F.row_number().over(Window.partitionBy("session_id", "window_index").orderBy("position")) == 1
    both = judged.join(windows.select("segment_id", "window_index"), "segment_id", "left")
    correct = F.when(F.col("expected_role").isNotNull(), F.col("role") == F.col("expected_role"))
    wrong = F.coalesce(F.col("role").isin("DOCTOR", "PATIENT") & ~correct, F.lit(False))
    return both.select("segment_id", "expected_role", correct.alias("correct"), wrong.alias("confidently_wrong"), "window_index", (F.col("window_index").isNotNull() & first).alias("first_in_window"))


def duplicate_starts(rows: DataFrame, is_floor: Column) -> DataFrame:
    """Groups of rows of one speaker with equal starts: how many, their rows by kind, and what could be removed."""
    groups = rows.groupBy("session_id", "speaker_id", "start_ms").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_floor).alias("floor")).where("n > 1")
    return groups.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("n").alias("rows_in_groups"),
        F.sum("floor").alias("floor_rows"),
        F.sum(F.col("n") - F.col("floor")).alias("real_rows"),
        F.sum(F.col("n") - 1).alias("all_removable"),
        F.sum(F.greatest(F.col("floor") - 1, F.lit(0))).alias("floor_removable"),
    )


def fold_class(expected: Column, visible: Column) -> Column:
    """benign, harmful or unresolved, from the expected role and the roles that are visible."""
    unclear = expected.isNull() | (F.size(visible) == 0)
    return F.when(unclear, "unresolved_fold").when(F.array_contains(visible, expected), "benign_same_role_fold").otherwise("harmful_cross_speaker_fold")


def attribution_state(expected: Column, visible: Column) -> Column:
    return F.when(expected.isNull() | (F.size(visible) != 1), "unresolved").when(F.array_contains(visible, expected), "correct").otherwise("wrong")


def state_change(before: Column, after: Column) -> Column:
    rank = lambda s: F.when(s == "wrong", 0).when(s == "unresolved", 1).otherwise(2)
    return F.when(rank(after) > rank(before), "improved").when(rank(after) < rank(before), "worsened").otherwise(F.concat(F.lit("unchanged_"), after))


def flow(rows: DataFrame) -> DataFrame:
    """(segment_id, kind, ms): a gap of silence before a row, or its overlap with the row before, as far as both last."""
    w = Window.partitionBy("session_id").orderBy("position")
    before = F.lag("end_ms").over(w)
    silence = F.col("start_ms") - before
    kind = F.when(silence > SILENCE_MS, "gap").when(silence < -OVERLAP_MS, "overlap")
    both = F.greatest(F.least(before, F.coalesce("end_ms", before)) - F.col("start_ms"), F.lit(0))
    return rows.select("segment_id", kind.alias("kind"), F.when(kind == "gap", silence).when(kind == "overlap", both).otherwise(0).alias("ms"))


def label_flips(snapshots: DataFrame) -> DataFrame:
    """(session_id, flips) from (session_id, position, mapping): two or more speakers trade the same roles."""
    w = Window.partitionBy("session_id").orderBy("position")
    both = snapshots.withColumn("was", F.lag("mapping").over(w))
    changed = F.map_filter(F.col("mapping"), lambda k, v: F.map_contains_key("was", k) & (F.element_at("was", k) != v))
    old = F.array_distinct(F.transform(F.map_keys(changed), lambda k: F.element_at("was", k)))
    new = F.array_distinct(F.map_values(changed))
    flip = (F.size(F.map_keys(changed)) >= 2) & (F.array_sort(old) == F.array_sort(new))
    return both.withColumn("flip", F.coalesce(F.when(F.col("was").isNotNull(), flip), F.lit(False))).groupBy("session_id").agg(F.count_if("flip").alias("flips"))


def term_recall(reference: DataFrame, shown: DataFrame, terms: list[str]) -> DataFrame:
    """(session_id, terms, found, recall): the reference's terms that any shown row has."""
    listed = F.array(*map(F.lit, terms))
    each = lambda rows: rows.select("session_id", F.explode(F.array_intersect(listed, score_tokens(F.col("text")))).alias("term")).distinct()
    both = each(reference).join(each(shown).withColumn("hit", F.lit(1)), ["session_id", "term"], "left")
    return both.groupBy("session_id").agg(F.count(F.lit(1)).alias("terms"), F.count("hit").alias("found"), rate(F.count("hit"), F.count(F.lit(1))).alias("recall"))


def critical_terms(pairs: DataFrame, terms: list[str]) -> DataFrame:
    """(session_id, ordinal, term, outcome) of spans' terms: supported, wrong_speaker or omitted by the rows that overlap.

    `pairs` are spans (session_id, ordinal, ref_role, ref_text), each with its
    overlapping rows (role, text), which may be null.
    """
    listed = F.array(*map(F.lit, terms))
    each = pairs.withColumn("term", F.explode(F.array_intersect(listed, score_tokens(F.col("ref_text")))))
    said = F.coalesce(F.array_contains(score_tokens(F.col("text")), F.col("term")), F.lit(False))
    own = said & (F.col("role") == F.col("ref_role"))
    found = each.groupBy("session_id", "ordinal", "term").agg(F.bool_or(own).alias("own"), F.bool_or(said).alias("said"))
    return found.select("session_id", "ordinal", "term", F.when(F.col("own"), "supported").when(F.col("said"), "wrong_speaker").otherwise("omitted").alias("outcome"))


def representatives(rows: DataFrame, strength: Column, k: int = 2, recent: int = 3) -> DataFrame:
    """(session_id, speaker_id, segment_id, why): each speaker's k strongest utterances and last `recent` ones."""
    speaker = Window.partitionBy("session_id", "speaker_id")
    strong = F.row_number().over(speaker.orderBy(F.desc("_s"), F.desc("start_ms"), F.desc("position"))) <= k
    last = F.row_number().over(speaker.orderBy(F.desc("position"))) <= recent
    each = rows.withColumn("_s", strength).withColumn("a", strong).withColumn("b", last).where("a or b")
    why = F.array_join(F.array_compact(F.array(F.when(F.col("a"), "strong"), F.when(F.col("b"), "recent"))), "+")
    return each.select("session_id", "speaker_id", "segment_id", why.alias("why"))


def establishment_hint(rows: DataFrame, doctor: Column, patient: Column, opening: int = 3) -> DataFrame:
    """(session_id, doctor, patient): who is who by the cues of each speaker's first rows.

    Only for two speakers, one with more cues of a doctor and the other with more
    of a patient; ties go to the speaker heard first.
    """
    nth = F.row_number().over(Window.partitionBy("session_id", "speaker_id").orderBy("position"))
    first = rows.withColumn("_n", nth).where(F.col("_n") <= opening)
    margins = first.groupBy("session_id", "speaker_id").agg(F.sum(doctor - patient).alias("margin"), (-F.min("position")).alias("seen"))
    both = margins.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.struct("margin", "seen", "speaker_id")).alias("d"),
        F.max(F.struct((-F.col("margin")).alias("margin"), "seen", "speaker_id")).alias("p"),
    )
    clear = (F.col("n") == 2) & (F.col("d.margin") > 0) & (F.col("p.margin") > 0) & (F.col("d.speaker_id") != F.col("p.speaker_id"))
    return both.where(clear).select("session_id", F.col("d.speaker_id").alias("doctor"), F.col("p.speaker_id").alias("patient"))


def keyword_roles(rows: DataFrame, doctor: list[str], patient: list[str]) -> DataFrame:
    """(session_id, speaker_id, role): more of a role's keywords anywhere in a speaker's text decide; the rest fill up.

    Speakers without a decision become DOCTOR, then PATIENT, where nobody is yet,
    then UNKNOWN, in the order in which they are heard.
    """
    low = F.lower("text")
    hit = lambda words: F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    each = rows.select("session_id", "speaker_id", "position", hit(doctor).alias("d"), hit(patient).alias("p")).where("speaker_id <> ''")
    seen = each.groupBy("session_id", "speaker_id").agg(F.min("position").alias("first"), *[F.size(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in "dp"])
    seen = seen.withColumn("role", F.when(F.col("d") > F.col("p"), "DOCTOR").when(F.col("p") > F.col("d"), "PATIENT"))
    session = Window.partitionBy("session_id")
    has = lambda role: F.coalesce(F.bool_or(F.col("role") == role).over(session), F.lit(False))
    nth = F.row_number().over(Window.partitionBy("session_id", F.col("role").isNull()).orderBy("first"))
    free = F.array_compact(F.array(F.when(~has("DOCTOR"), "DOCTOR"), F.when(~has("PATIENT"), "PATIENT")))
    filled = seen.withColumn("_free", free).withColumn("_n", nth)
    return filled.select("session_id", "speaker_id", F.coalesce("role", F.try_element_at("_free", F.col("_n")), F.lit("UNKNOWN")).alias("role"))


def exact_inverse(proposed: Column, current: Column) -> Column:
    """Whether two maps have the same two speakers with their roles exchanged."""
    roles = lambda m: F.array_sort(F.map_values(m))
    same = F.array_sort(F.map_keys(proposed)) == F.array_sort(F.map_keys(current))
    other = F.forall(F.map_keys(proposed), lambda k: F.element_at(proposed, k) != F.element_at(current, k))
    return (F.size(proposed) == 2) & same & (roles(proposed) == roles(current)) & other


def disposition(findings: DataFrame) -> DataFrame:
    """(segment_id, disposition) of findings (correct, confidently_wrong) against the reference."""
    found = F.when(F.col("correct").isNull(), "reference_gap").when(F.col("correct"), "truth_aligned_heuristic_false_positive").when(F.col("confidently_wrong"), "baseline_confirmed_role_error").otherwise("unscored")
    return findings.select("segment_id", found.alias("disposition"))


def sentences(text: Column) -> Column:
    """Sentences of prose; one that ends inside a quotation goes on to the next."""
    parts = F.filter(F.transform(F.split(F.trim(text), r"""(?<=[.!?])\s+(?=[A-Z0-9"'‘“])"""), lambda x: F.trim(x)), lambda x: x != "")
    count = lambda s, c: F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))

    def is_open(s: Column) -> Column:
        singles = F.regexp_count(s, F.lit(r"(?:^|[\s(])'|'(?:[\s).,;:]|$)"))
        return (count(s, '"') % 2 == 1) | (count(s, "“") != count(s, "”")) | (singles % 2 == 1)

    def add(done: Column, part: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat_ws(" ", last, part)))
        return F.when((F.size(done) > 0) & is_open(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(""))), joined).otherwise(F.concat(done, F.array(part)))

    return F.aggregate(parts, F.array().cast("array<string>"), add)


def role_tokens(rows: DataFrame, bridge: int = BRIDGE) -> DataFrame:
    """(session_id, role, run, at, word): the words of each role's runs, in order.

    A run goes over rows of one role. One row of others with at most `bridge`
    words between two of them doesn't end it; more rows or words do. Rows without
    words neither join nor interrupt.
    """
    said = rows.withColumn("words", score_tokens(F.coalesce("text", F.lit("")))).withColumn("n", F.size("words").cast("long")).where("n > 0")
    session = Window.partitionBy("session_id").orderBy("position")
    said = said.withColumns({"row": F.row_number().over(session), "upto": F.sum("n").over(session)})
    own = Window.partitionBy("session_id", "role").orderBy("position")
    gap, between = F.col("row") - F.lag("row").over(own) - 1, F.col("upto") - F.col("n") - F.lag("upto").over(own)
    parted = F.when(gap.isNull(), 0).when((gap > 1) | ((gap == 1) & (between > bridge)), 1).otherwise(0)
    runs = said.withColumn("parted", parted).withColumn("run", F.sum("parted").over(own)).withColumn("first", F.sum("n").over(own) - F.col("n"))
    return runs.select("session_id", "role", "run", "first", F.posexplode("words").alias("i", "word")).select("session_id", "role", "run", (F.col("first") + F.col("i")).alias("at"), "word")


def quotes_found(quotes: DataFrame, rows: DataFrame, bridge: int = BRIDGE) -> DataFrame:
    """quotes (session_id, claim_id, role, quote) with `found`: the quote's words stand in a row in one of that role's runs.

    Runs (see role_tokens) may go over several rows. A quote meets the places of
    its first word, and each of its words then the place it must have, so a
    session's rows are not compared with all of its quotes. A quote without words
    is not found.
    """
    said = role_tokens(rows, bridge)
    asked = quotes.select("session_id", "claim_id", "role", score_tokens(F.col("quote")).alias("words")).where(F.size("words") > 0).distinct()
    start = asked.withColumn("word", F.col("words")[0]).join(said, ["session_id", "role", "word"]).select("session_id", "role", "claim_id", "words", "run", F.col("at").alias("start"))
    each = start.select("session_id", "role", "claim_id", "run", "start", F.size("words").alias("n"), F.posexplode("words").alias("i", "word")).withColumn("at", F.col("start") + F.col("i"))
    met = each.join(said, ["session_id", "role", "run", "at", "word"])
    hit = met.groupBy("session_id", "claim_id", "run", "start", "n").agg(F.count(F.lit(1)).alias("met")).where("met = n").select("session_id", "claim_id").distinct()
    return quotes.join(hit.withColumn("found", F.lit(True)), ["session_id", "claim_id"], "left").fillna(False, ["found"])


def low_confidence(claims: DataFrame, cited: DataFrame, least: int = 2) -> DataFrame:
    """(claim_id, measured, low, review): claims for review, most of whose relevant cited rows are below the threshold.

    A cited row is relevant if it shares `least` words with the claim; rows
    without a confidence are not measured.
    """
    words = lambda c: F.array_distinct(score_tokens(F.col(c)))
    both = claims.join(cited, "claim_id").where(F.col("confidence").isNotNull() & (F.size(F.array_intersect(words("claim"), words("text"))) >= least))
    found = both.groupBy("claim_id").agg(F.count(F.lit(1)).alias("measured"), F.count_if(F.col("confidence") < REVIEW_BELOW).alias("low"))
    return found.select("claim_id", "measured", "low", (2 * F.col("low") > F.col("measured")).alias("review"))


def review_reasons(claims: DataFrame, cited: DataFrame, variants: list[str], least: int = 2) -> DataFrame:
    """(claim_id, terms, segment_ids): claims for review (see low_confidence) that have a known variant of a term, and the rows to listen to.

    Rows to listen to are the relevant ones below the threshold, in order of
    their ids; a row that is cited twice counts once.
    """
    words = lambda c: F.array_distinct(score_tokens(F.col(c)))
    flagged = claims.join(low_confidence(claims, cited, least).where("review").select("claim_id"), "claim_id")
    flagged = flagged.withColumn("terms", F.array_sort(F.array_intersect(words("claim"), F.array(*map(F.lit, variants))))).where(F.size("terms") > 0)
    rows = flagged.join(cited, "claim_id").where((F.col("confidence") < REVIEW_BELOW) & (F.size(F.array_intersect(words("claim"), words("text"))) >= least))
    return rows.groupBy("claim_id", "terms").agg(F.array_sort(F.collect_set("cited")).alias("segment_ids"))


def grounding(claims: DataFrame, rows: DataFrame, citations: DataFrame) -> DataFrame:
    """(session_id, claim_id, outcome, unresolved): supported, miscited or unsupported claims (role, quote), and citations of nothing.

    A claim is supported by any row of its role that holds its phrase; miscited
    if none of those is cited.
    """
    first = F.try_element_at(score_tokens(F.col("quote")), F.lit(1))
    said = rows.select("session_id", "role", F.col("segment_id").alias("cited"), F.explode(F.array_distinct(score_tokens(F.col("text")))).alias("word"))
    texts = rows.select("session_id", F.col("segment_id").alias("cited"), "text")  # joined to the rows found by a word: no text goes along with each of its words
    support = claims.withColumn("word", first).where("word is not null").join(said, ["session_id", "role", "word"])
    support = support.join(texts, ["session_id", "cited"]).where(F.contains(padded(F.col("text")), padded(F.col("quote")))).select("session_id", "claim_id", "cited")
    marked = citations.select("session_id", "claim_id", "cited").distinct().withColumn("is_cited", F.lit(1))
    used = support.join(marked, ["session_id", "claim_id", "cited"], "left").groupBy("session_id", "claim_id").agg(F.count("is_cited").alias("hits"))
    known = rows.select("session_id", F.col("segment_id").alias("cited"))
    lost = citations.join(known, ["session_id", "cited"], "left_anti").groupBy("session_id", "claim_id").agg(F.count(F.lit(1)).alias("unresolved"))
    both = claims.select("session_id", "claim_id").join(used, ["session_id", "claim_id"], "left").join(lost, ["session_id", "claim_id"], "left")
    outcome = F.when(F.col("hits").isNull(), "unsupported").when(F.col("hits") == 0, "miscited").otherwise("supported")
    return both.select("session_id", "claim_id", outcome.alias("outcome"), F.coalesce("unresolved", F.lit(0)).cast("long").alias("unresolved"))


def best_draft(drafts: DataFrame) -> DataFrame:
    """Each session's draft with the fewest violations, then the fewest uncited claims, then the first."""
    return drafts.groupBy("session_id").agg(F.min_by("draft", F.struct("violations", "uncited", "draft")).alias("draft"))


def answered_uncertainty(rows: DataFrame, hedges: list[str]) -> DataFrame:
    """(segment_id, hedged) of questions: whether one of the next two rows holds a hedge as a word."""
    w = Window.partitionBy("session_id").orderBy("position")
    hedge = F.size(F.array_intersect(F.array(*map(F.lit, hedges)), score_tokens(F.col("text")))) > 0
    each = rows.withColumn("_h", hedge)
    near = F.coalesce(F.lead("_h", 1).over(w), F.lit(False)) | F.coalesce(F.lead("_h", 2).over(w), F.lit(False))
    return each.withColumn("hedged", near).where(F.endswith(F.trim("text"), F.lit("?"))).select("segment_id", "hedged")


def hedge_dropped(claims: DataFrame, cited: DataFrame, hedges: list[str]) -> DataFrame:
    """Claims (claim_id) that cite a hedged row and hedge nothing themselves."""
    hedged = lambda c: F.size(F.array_intersect(F.array(*map(F.lit, hedges)), score_tokens(F.col(c)))) > 0
    return claims.where(~hedged("claim")).join(cited.where(hedged("text")).select("claim_id").distinct(), "claim_id", "left_semi").select("claim_id")


def needs_exam(claims: DataFrame, rows: DataFrame, *, exam: str, performed: str, intent: str, absent: str, presupposed: str) -> DataFrame:
    """(session_id, claim_id, subtype) of claims with the language of an examination that no DOCTOR row of the session performs.

    The rules are regular expressions for lower-cased text. A claim that only
    plans an examination (`intent`) claims nothing. One that presupposes it is
    reported even where it says that nothing was found; other sentences of absence
    (`absent`) are honest. What remains is a claim if it matches `exam`.
    """
    says = lambda c, p: F.coalesce(F.lower(c).rlike(p), F.lit(False))
    done = rows.where((F.upper("role") == "DOCTOR") & says("text", performed)).select("session_id").distinct()
    kind = F.when(says("claim", intent), F.lit(None)).when(says("claim", presupposed), "exam-presupposed-without-performance").when(~says("claim", absent) & says("claim", exam), "exam-claim-without-performance")
    return claims.withColumn("subtype", kind).where("subtype is not null").join(done, "session_id", "left_anti").select("session_id", "claim_id", "subtype")


def preservation_defects(text: Column, role: Column, speaker: Column, source_text: Column, source_role: Column, source_speaker: Column) -> Column:
    """Array of what a unit changed against its source: wording, role, identity; a source that is null is not judged."""
    return F.array_compact(
        F.array(
            F.when(source_text.isNotNull() & (score_tokens(source_text) != score_tokens(text)), "lexical_rewrite"),
            F.when(source_role.isNotNull() & (F.upper(source_role) != F.upper(F.coalesce(role, F.lit("")))), "speaker_role_changed"),
            F.when(source_speaker.isNotNull() & (source_speaker != F.coalesce(speaker, F.lit(""))), "speaker_identity_changed"),
        )
    )


def misplaced_terms(rows: DataFrame, terms: list[str], role: str) -> DataFrame:
    """(session_id, term, rows) of terms shown in rows of another role."""
    found = F.array_intersect(F.array(*map(F.lit, terms)), score_tokens(F.col("text")))
    return rows.where(F.upper("role") != role).select("session_id", F.explode(found).alias("term")).groupBy("session_id", "term").agg(F.count(F.lit(1)).alias("rows"))
