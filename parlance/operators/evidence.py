"""Evidence for claims in the rows of a session, and findings of rows by cues.

Claims are (session_id, claim_id, tokens). What rows say about a word is first
summed up by session and word, so claims meet one row for each of their words,
however often it is spoken. Cues and words are the caller's lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import score_tokens

# Fixed values of the rules.
QUESTION_ROWS, STATE_ROWS, SHORT_WORDS = 6, 2, 3
_UNITS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
#: Values of spoken numbers.
NUMBERS = {w: i for i, w in enumerate(_UNITS, 1)} | {w: 10 * i for i, w in enumerate(_TENS, 2)}
_QUANTITY = "([a-z0-9]+(?:[- ][a-z0-9]+)?)"
SPOKEN_RANGE = f"{_QUANTITY} to {_QUANTITY} (minute|hour|day|week)s?"


def holds(text: Column, words: list[str]) -> Column:
    """Whether the text has one of the words as a scored word."""
    return F.arrays_overlap(score_tokens(text), F.array(*map(F.lit, words)))


def around(before: int, after: int, text: Column | None = None) -> Column:
    """The text of a row joined with that of its neighbours in the session."""
    w = Window.partitionBy("session_id").orderBy("position").rowsBetween(-before, after)
    return F.array_join(F.collect_list(F.col("text") if text is None else text).over(w), " ")


def _said(rows: DataFrame, *facts: Column) -> DataFrame:
    """A row for each distinct scored word of each row, with facts of the row."""
    # facts stand below the explode, so that they are found once for each row and not for each word
    each = rows.select("session_id", "position", *facts, F.array_distinct(score_tokens(F.col("text"))).alias("token"))
    return each.withColumn("token", F.explode("token"))


def _asked(claims: DataFrame) -> DataFrame:
    return claims.select("session_id", "claim_id", F.explode(F.array_distinct("tokens")).alias("token"))


def superseded_states(claims: DataFrame, rows: DataFrame, negation: list[str], affirmation: list[str]) -> DataFrame:
    """(session_id, claim_id, absent_at, affirmed_at): claimed absences whose object a later row affirms.

    A row that has one of the claim's words denies or affirms it if it or two
    rows on either side have such a word.
    """
    near = rows.withColumn("near", around(STATE_ROWS, STATE_ROWS))
    said = _said(near, holds(F.col("near"), negation).alias("no"), holds(F.col("near"), affirmation).alias("yes"))
    said = said.groupBy("session_id", "token").agg(F.min(F.when(F.col("no"), F.col("position"))).alias("absent_at"), F.max(F.when(F.col("yes"), F.col("position"))).alias("affirmed_at"))
    found = _asked(claims).join(said, ["session_id", "token"]).groupBy("session_id", "claim_id")
    return found.agg(F.min("absent_at").alias("absent_at"), F.max("affirmed_at").alias("affirmed_at")).where("affirmed_at > absent_at")


def unconfirmed_actions(claims: DataFrame, rows: DataFrame, promised: list[str], done: list[str]) -> DataFrame:
    """(session_id, claim_id, promised_at): actions told as done that rows promise and none confirms."""
    near = rows.withColumn("near", around(1, 1))
    said = _said(near, holds(F.col("near"), promised).alias("promised"), holds(F.col("text"), done).alias("done"))
    said = said.groupBy("session_id", "token").agg(F.min(F.when(F.col("promised"), F.col("position"))).alias("promised_at"), F.bool_or("done").alias("done"))
    found = _asked(claims).join(said, ["session_id", "token"]).groupBy("session_id", "claim_id")
    return found.agg(F.min("promised_at").alias("promised_at"), F.bool_or("done").alias("done")).where("promised_at IS NOT NULL AND NOT done").drop("done")


def unspoken_content(claims: DataFrame, rows: DataFrame) -> DataFrame:
    """(session_id, claim_id, unspoken): a claim's words that no row of its session has, in order."""
    said = _said(rows).select("session_id", "token").distinct()
    return _asked(claims).join(said, ["session_id", "token"], "left_anti").groupBy("session_id", "claim_id").agg(F.array_sort(F.collect_set("token")).alias("unspoken"))


def undenied_topics(claims: DataFrame, rows: DataFrame, denial: list[str]) -> DataFrame:
    """(session_id, claim_id, undenied): topics, one word each, that a claim says the patient denied but that none denies.

    A patient denies a topic in a clause that has it and a word of denial, or by
    a short answer with such a word to a doctor who named it within six rows.
    """
    clauses = rows.where("role = 'PATIENT'").select("session_id", F.explode(F.split("text", "[.!?;]")).alias("clause"))
    direct = clauses.where(holds(F.col("clause"), denial)).select("session_id", F.explode(F.array_distinct(score_tokens(F.col("clause")))).alias("token"))
    asked = rows.withColumn("question", around(QUESTION_ROWS, -1, F.when(F.col("role") == "DOCTOR", F.col("text"))))
    short = (F.col("role") == "PATIENT") & (F.size(score_tokens(F.col("text"))) <= SHORT_WORDS) & holds(F.col("text"), denial)
    answered = asked.where(short).select("session_id", F.explode(F.array_distinct(score_tokens(F.col("question")))).alias("token"))
    denied = direct.unionByName(answered).distinct()
    return _asked(claims).join(denied, ["session_id", "token"], "left_anti").groupBy("session_id", "claim_id").agg(F.array_sort(F.collect_set("token")).alias("undenied"))


def states_without_evidence(claims: DataFrame, rows: DataFrame, state: list[str]) -> DataFrame:
    """(session_id, claim_id, missing): words of claims on the patient's state that no run of patient rows has beside a word of state."""
    w = Window.partitionBy("session_id").orderBy("position")
    own = (F.col("role") == "PATIENT").cast("int")
    runs = rows.withColumn("own", own).withColumn("run", F.sum(1 - F.col("own")).over(w)).where("own = 1").withColumn("state", holds(F.col("text"), state))
    runs = runs.withColumn("state", F.max("state").over(Window.partitionBy("session_id", "run")))
    proven = _said(runs.where("state")).select("session_id", "token").distinct()
    return _asked(claims).join(proven, ["session_id", "token"], "left_anti").groupBy("session_id", "claim_id").agg(F.array_sort(F.collect_set("token")).alias("missing"))


def number_of(quantity: Column) -> Column:
    """The value of a quantity of one or two parts, in digits or words; a first part that is no number is left out."""
    known = F.create_map(*[F.lit(x) for pair in NUMBERS.items() for x in pair])
    part = lambda p: F.coalesce(p.try_cast("int"), F.try_element_at(known, p))
    parts = F.split(quantity, "[- ]")
    last, first = part(F.element_at(parts, -1)), part(F.element_at(parts, 1))
    return F.when(F.size(parts) == 1, last).otherwise(last + F.coalesce(first, F.lit(0)))


def altered_ranges(claims: DataFrame, rows: DataFrame) -> DataFrame:
    """Claimed ranges (session_id, claim_id, low, high, unit) of a unit that the session has ranges of, none of them this one.

    Spoken ranges may run over two rows, so a row is read with its neighbours.
    """
    near = rows.select("session_id", F.lower(around(1, 1)).alias("near"))
    phrase = near.select("session_id", F.explode(F.regexp_extract_all("near", F.lit(SPOKEN_RANGE), F.lit(0))).alias("phrase"))
    group = lambda i: F.regexp_extract("phrase", SPOKEN_RANGE, i)
    spoken = phrase.select("session_id", number_of(group(1)).alias("low"), number_of(group(2)).alias("high"), group(3).alias("unit")).where("low IS NOT NULL AND high IS NOT NULL").distinct()
    return claims.join(spoken.select("session_id", "unit").distinct(), ["session_id", "unit"], "left_semi").join(spoken, ["session_id", "unit", "low", "high"], "left_anti")


def role_findings(rows: DataFrame, doctor: list[str], patient: list[str], acknowledgements: list[str]) -> DataFrame:
    """(session_id, position, role, codes, severity) of rows whose words contradict their role.

    Short acknowledgements after a doctor's question are a warning if nothing
    else speaks against the row; the rest are errors.
    """
    w = Window.partitionBy("session_id").orderBy("position")
    asks, tells, words = holds(F.col("text"), doctor), holds(F.col("text"), patient), score_tokens(F.col("text"))
    each = rows.where("role IS NOT NULL").select("session_id", "position", "role", asks.alias("asks"), tells.alias("tells"), F.array_join(words, " ").isin(acknowledgements).alias("short"))
    each = each.withColumn("asked", F.coalesce((F.lag("role").over(w) == "DOCTOR") & F.lag("asks").over(w), F.lit(False)))
    codes = F.array_compact(
        F.array(
            F.when((F.col("role") == "PATIENT") & F.col("asks"), "doctor_question_in_patient_row"),
            F.when((F.col("role") == "DOCTOR") & F.col("tells"), "patient_statement_in_doctor_row"),
            F.when(F.col("asks") & F.col("tells"), "mixed_role_cues"),
            F.when((F.col("role") == "DOCTOR") & F.col("short") & F.col("asked"), "patient_ack_after_doctor_question"),
        )
    )
    found = each.where(F.col("role").isin("DOCTOR", "PATIENT")).withColumn("codes", codes).where(F.size("codes") > 0)
    only = F.col("codes") == F.array(F.lit("patient_ack_after_doctor_question"))
    return found.select("session_id", "position", "role", "codes", F.when(only, "warning").otherwise("error").alias("severity"))


def finding_totals(findings: DataFrame) -> DataFrame:
    return findings.groupBy("session_id").agg(F.count(F.lit(1)).alias("findings"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))


def shared_cue_fragments(rows: DataFrame, cues: list[str]) -> DataFrame:
    """(session_id, position, before, after): rows of few words that share cue words with a neighbour."""
    w = Window.partitionBy("session_id").orderBy("position")
    words = score_tokens(F.col("text"))
    each = rows.select("session_id", "position", F.size(words).alias("n"), F.array_intersect(words, F.array(*map(F.lit, cues))).alias("own"))
    shares = lambda other: F.coalesce(F.arrays_overlap("own", other), F.lit(False))
    each = each.withColumn("before", shares(F.lag("own").over(w))).withColumn("after", shares(F.lead("own").over(w)))
    return each.where((F.col("n") <= SHORT_WORDS) & (F.col("before") | F.col("after"))).select("session_id", "position", "before", "after")


def missing_components(rows: DataFrame, notes: DataFrame, components: list[tuple[str, list[str], list[str]]]) -> DataFrame:
    """(session_id, missing): components that a doctor speaks of, alone or with a neighbour, and no text of the session's note has."""
    near = rows.select("session_id", "role", around(1, 1).alias("near")).where("role = 'DOCTOR'")
    spoken = near.groupBy("session_id").agg(*[F.bool_or(holds(F.col("near"), said)).alias(f"s{i}") for i, (_, said, _) in enumerate(components)])
    noted = notes.groupBy("session_id").agg(*[F.bool_or(holds(F.col("text"), wrote)).alias(f"n{i}") for i, (_, _, wrote) in enumerate(components)])
    gone = [F.when(F.col(f"s{i}") & ~F.coalesce(f"n{i}", F.lit(False)), name) for i, (name, _, _) in enumerate(components)]
    return spoken.join(noted, "session_id", "left").select("session_id", F.array_compact(F.array(*gone)).alias("missing")).where(F.size("missing") > 0)


def expectations(rows: DataFrame, rules: list[tuple[str, str, list[str]]]) -> DataFrame:
    """(session_id, rule, met) by rules (name, kind, words).

    all: each word is said; any: one is; none: none is; together: one row says them all.
    """
    words = score_tokens(F.col("text"))
    each = [F.bool_or(F.array_contains(words, w)).alias(f"w{i}_{j}") for i, (_, _, ws) in enumerate(rules) for j, w in enumerate(ws)]
    whole = [F.bool_or(F.size(F.array_except(F.array(*map(F.lit, ws)), words)) == 0).alias(f"t{i}") for i, (_, _, ws) in enumerate(rules)]
    seen = rows.groupBy("session_id").agg(*each, *whole)

    def met(i: int, kind: str, n: int) -> Column:
        flags = F.array(*[F.col(f"w{i}_{j}") for j in range(n)])
        some = F.exists(flags, lambda x: x)
        return {"all": F.forall(flags, lambda x: x), "any": some, "none": ~some, "together": F.col(f"t{i}")}[kind]

    found = F.array(*[F.struct(F.lit(name).alias("rule"), met(i, kind, len(ws)).alias("met")) for i, (name, kind, ws) in enumerate(rules)])
    return seen.select("session_id", F.explode(found).alias("x")).select("session_id", "x.*")


def verdicts(met: DataFrame, scorable: DataFrame) -> DataFrame:
    """(session_id, verdict, coverage): not_scorable_source without a scorable source, else fail or pass."""
    hit, n = F.count_if(F.col("met")), F.count(F.lit(1))
    each = met.groupBy("session_id").agg(hit.alias("hit"), n.alias("n")).join(scorable.select("session_id", F.lit(True).alias("ok")).distinct(), "session_id", "left")
    verdict = F.when(F.col("ok").isNull(), "not_scorable_source").when(F.col("hit") < F.col("n"), "fail").otherwise("pass")
    return each.select("session_id", verdict.alias("verdict"), F.round(F.col("hit") / F.col("n"), 6).alias("coverage"))
