"""Violations of notes: sentences that say more than the session's rows do, by six rules.

The rows of a session are indexed once, by what they say about each topic; every
sentence meets the index by its topics, and the rules that need no topic by
session. Patterns are regular expressions for lower-cased text, topics lists of
stems and synonyms; both are the caller's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators.notes import needs_exam, quotes_found

# Rows after a question that can answer it, rows of the doctor's that a short denial can answer, and words of a short answer.
ANSWER_ROWS, DENIAL_ROWS, SHORT_ANSWER = 2, 6, 3


@dataclass(frozen=True)
class Rules:
    """`topics`: stems by topic. `characteristics`: by name, the pattern of its question and that of the values a note may assert."""

    topics: dict[str, list[str]]
    characteristics: dict[str, tuple[str, str]]
    uncertain: str
    preserved: str
    denial: str
    denied: str
    equivocal: str
    states: dict[str, tuple[str, str]]
    exam: dict[str, str]
    doctor_quote: str
    quote: str = '"([^"]+)"'
    asserts: str = "(^| )(was|is|appears?|seemed?) "
    attributes: str = "(^| )described as "


def _says(text: Column | str, pattern: str) -> Column:
    return F.coalesce(F.lower(text).rlike(pattern), F.lit(False))


def stem_pattern(stems: list[str]) -> str:
    """A word that begins with one of the stems."""
    return "(^|[^a-z])(" + "|".join(stems) + ")"


def _by_topic(rows: DataFrame, text: str, topics: dict[str, list[str]]) -> DataFrame:
    """A row for each topic that the text names."""
    named = F.array_compact(F.array(*(F.when(_says(text, stem_pattern(stems)), name) for name, stems in topics.items())))
    return rows.withColumn("topic", F.explode(named))


def topic_index(rows: DataFrame, rules: Rules) -> DataFrame:
    """(session_id, topic, denied_at, hedged_at): the first rows in which a patient denies a topic, and denies it equivocally.

    A denial is a clause of the patient with the topic and a word of denial, or a
    short answer with one after a doctor named the topic within six rows. It is
    equivocal in a row that says so within two rows of a doctor's question.
    """
    w = Window.partitionBy("session_id").orderBy("position")
    asked = F.array_join(F.collect_list(F.when(F.upper("role") == "DOCTOR", F.col("text"))).over(w.rowsBetween(-DENIAL_ROWS, -1)), " ")
    question = F.coalesce(F.max(F.when((F.upper("role") == "DOCTOR") & F.contains("text", F.lit("?")), 1)).over(w.rowsBetween(-ANSWER_ROWS, -1)), F.lit(0)) == 1
    own = rows.withColumns({"asked": asked, "question": question}).where(F.upper("role") == "PATIENT")
    clauses = own.select("session_id", "position", F.explode(F.split("text", "[.!?;,]")).alias("clause"))
    direct = _by_topic(clauses.where(_says("clause", rules.denial)), "clause", rules.topics).select("session_id", "topic", F.col("position").alias("denied_at"), F.lit(None).cast("long").alias("hedged_at"))
    short = own.where((F.size(F.regexp_extract_all(F.lower("text"), F.lit("[a-z']+"), F.lit(0))) <= SHORT_ANSWER) & _says("text", rules.denial))
    answered = _by_topic(short, "asked", rules.topics).select("session_id", "topic", "position", F.lit(None).cast("long"))
    hedged = _by_topic(own.where(F.col("question") & _says("text", rules.equivocal)), "text", rules.topics).select("session_id", "topic", F.lit(None).cast("long"), "position")
    return direct.union(answered).union(hedged).groupBy("session_id", "topic").agg(F.min("denied_at").alias("denied_at"), F.min("hedged_at").alias("hedged_at"))


def unresolved(rows: DataFrame, rules: Rules) -> DataFrame:
    """(session_id, name, answered_at): characteristics that a doctor asked for and the patient was uncertain about within two rows."""
    w = Window.partitionBy("session_id").orderBy("position")
    unsure = F.when((F.upper("role") == "PATIENT") & _says("text", rules.uncertain), F.col("position"))
    each = rows.withColumn("answered_at", F.min(unsure).over(w.rowsBetween(1, ANSWER_ROWS))).where((F.upper("role") == "DOCTOR") & F.col("answered_at").isNotNull())
    asked = F.array_compact(F.array(*(F.when(_says("text", question), name) for name, (question, _) in rules.characteristics.items())))
    return each.select("session_id", F.explode(asked).alias("name"), "answered_at").groupBy("session_id", "name").agg(F.min("answered_at").alias("answered_at"))


def violations(sentences: DataFrame, rows: DataFrame, rules: Rules) -> DataFrame:
    """(session_id, location, ordinal, rule, subtype, row): what sentences (session_id, location, ordinal, sentence) claim without evidence in rows.

    - uncertainty-resolved: a characteristic that the patient was uncertain about is asserted, attributed, or told without a mark of doubt or the patient's own words.
    - negative-without-denial: a topic is said to be absent that no patient denied.
    - exam-not-performed: the language of an examination that no doctor's row performs.
    - patient-state-without-evidence: a state of the patient that no patient's row shows.
    - non-verbatim-quote: quoted words that are in none of the speaker's runs.
    - uncertainty-resolved, hedge-dropped: an equivocal denial told as a plain one, in sentences without another violation.

    `row` is the position of the row that the sentence resolves, null where
    evidence is missing. Sessions without rows are not judged. Null sentences,
    locations and texts of rows say nothing; repeated rows count as one.
    """
    known = rows.select("session_id").distinct()
    said = sentences.where("sentence is not null").join(known, "session_id", "left_semi")
    said = said.select("session_id", "location", "ordinal", "sentence", F.concat_ws("#", F.coalesce("location", F.lit("")), "ordinal").alias("claim_id"))
    key = ["session_id", "location", "ordinal"]
    row = lambda kind, subtype, at=None: [*key, F.lit(kind).alias("rule"), (F.lit(subtype) if isinstance(subtype, str) else subtype).alias("subtype"), (F.lit(None).cast("long") if at is None else F.col(at).cast("long")).alias("row")]

    quotes = said.select("session_id", "claim_id", F.when(_says("sentence", rules.doctor_quote), "DOCTOR").otherwise("PATIENT").alias("role"), F.explode(F.regexp_extract_all("sentence", F.lit(rules.quote), F.lit(1))).alias("quote"))
    quotes = quotes.withColumn("claim_id", F.to_json(F.struct("claim_id", "quote")))
    judged = quotes_found(quotes.distinct(), rows.withColumn("role", F.upper("role"))).withColumn("claim_id", F.get_json_object("claim_id", "$.claim_id"))
    judged = judged.groupBy("session_id", "claim_id", "role").agg(F.bool_and("found").alias("all_found"), F.bool_or("found").alias("any_found"))
    said = said.join(judged.select("session_id", "claim_id", "all_found", (F.col("any_found") & (F.col("role") == "PATIENT")).alias("in_own_words")), ["session_id", "claim_id"], "left").withColumn("in_own_words", F.coalesce("in_own_words", F.lit(False)))

    values = F.array_compact(F.array(*(F.when(_says("sentence", v), F.struct(F.lit(name).alias("name"), _says("sentence", rules.asserts + v.removeprefix("(^| )")).alias("asserted"), _says("sentence", rules.attributes + v.removeprefix("(^| )")).alias("attributed"))) for name, (_, v) in rules.characteristics.items())))
    told = said.select("*", F.explode(values).alias("v")).select("*", "v.*").join(unresolved(rows, rules), ["session_id", "name"])
    honest = _says("sentence", rules.preserved) | F.col("in_own_words")
    resolved = F.when(F.col("asserted"), "resolved-to-definitive").when(F.col("attributed"), "invented-attribution").when(~honest, "uncertainty-not-preserved")
    found = told.withColumn("subtype", resolved).where("subtype is not null").select(*row("uncertainty-resolved", F.col("subtype"), "answered_at"))

    index = topic_index(rows, rules)
    negative = _by_topic(said.where(_says("sentence", rules.denied)), "sentence", rules.topics).join(index, ["session_id", "topic"], "left")
    found = found.union(negative.where("denied_at is null and hedged_at is null").select(*row("negative-without-denial", F.col("topic"))))
    exams = needs_exam(said.withColumnRenamed("sentence", "claim"), rows, **rules.exam)
    found = found.union(said.join(exams, ["session_id", "claim_id"]).select(*row("exam-not-performed", F.col("subtype"))))
    own = rows.where(F.upper("role") == "PATIENT").groupBy("session_id").agg(*(F.bool_or(_says("text", shown)).alias(f"shows_{i}") for i, (_, shown) in enumerate(rules.states.values())))
    states = F.array_compact(F.array(*(F.when(_says("sentence", claim) & ~F.coalesce(F.col(f"shows_{i}"), F.lit(False)), name) for i, (name, (claim, _)) in enumerate(rules.states.items()))))
    found = found.union(said.join(own, "session_id", "left").withColumn("state", F.explode(states)).select(*row("patient-state-without-evidence", F.col("state"))))
    found = found.union(said.where("all_found = false").select(*row("non-verbatim-quote", "not-verbatim"))).distinct()

    hedges = negative.where(F.col("hedged_at").isNotNull() & ~_says("sentence", rules.preserved) & ~F.col("in_own_words"))
    hedges = hedges.groupBy(*key).agg(F.min("hedged_at").alias("hedged_at"))
    clean = [hedges[c].eqNullSafe(found[c]) for c in key]
    dropped = hedges.join(found, clean[0] & clean[1] & clean[2], "left_anti")
    return found.union(dropped.select(*row("uncertainty-resolved", "hedge-dropped", "hedged_at")))
