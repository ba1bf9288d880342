"""Roles of corrected rows by what is said in them and beside them, one row after the other.

What a row may become depends on the role that the row before it has by then, and
on nothing else that changes. So all evidence is columns, a row is reduced to its
outcome for each role before it, and the fold that carries the role is a lookup.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import cue_words
from parlance.operators.folds import fold

#: Words of a row that may take its role from beside it, and strong changes that mark a session's roles as weak.
SHORT, WEAK_FROM = 3, 3


@dataclass(frozen=True)
class Cues:
    """Phrases of cue words. `weak` ones count only in sessions whose roles are weak."""

    doctor: tuple[str, ...]
    patient: tuple[str, ...]
    questions: tuple[str, ...]
    answers: tuple[str, ...]
    weak: tuple[str, ...] = ()
    starts: tuple[str, ...] = ()
    fillers: tuple[str, ...] = ()


# The cue phrases of consultations.
CONSULTATION = Cues(
    doctor=(
        "hello there its dr", "dr steed", "dr steve", "how can i help", "can i confirm your name", "im sorry to hear", "i can understand", "can you tell", "tell me", "age please",
        "whereabouts in your skin", "have you", "vomited at all", "bright lights", "is it affected", "it affected", "okay", "lets try", "you mentioned", "did the pain", "are you able",
    ),
    patient=(
        "and i", "ive", "ive had", "ive just", "i have", "i had", "i noticed", "i dont know", "my vision", "well you know", "just want you", "want you to do something", "need to vomit", "headache since",
        "my chest", "i vomited", "my hands", "my arms", "my name", "my names", "my friends mum", "im wearing", "im worried", "im concerned", "im 26", "like if i", "when i", "if i",
    ),
    questions=(
        "can you", "could you", "did you", "do you", "does it", "have you", "has it", "are you", "is that", "tell me", "describe",
        "whereabouts in your skin", "your neck", "bright lights", "vomited at all", "is it affected", "it affected",
    ),
    answers=("yeah", "yeah yeah", "yeah well", "yeah um", "yes", "yes well", "yep", "no", "nope", "um no", "uh no"),
    weak=("okay", "and i"),
    starts=("and", "are", "can", "did", "is", "okay", "was"),
    fillers=("ah", "oh", "um", "uh", "erm", "well"),
)

_BEFORE = {"doctor": "DOCTOR", "patient": "PATIENT", "other": None}


def _line(words: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def _list(phrases) -> Column:
    return F.array(*(F.lit(f" {p} ") for p in phrases)) if phrases else F.array().cast("array<string>")


def _first(line: str, phrases) -> Column:
    return F.array_min(F.filter(F.transform(_list(phrases), lambda p: F.instr(F.col(line), p)), lambda at: at > 0))


def _any(line: str, phrases) -> Column:
    return F.exists(_list(phrases), lambda p: F.contains(F.col(line), p))


def _role(line: str, cues: Cues) -> Column:
    d, p = _first(line, cues.doctor), _first(line, cues.patient)
    return F.when(d.isNull() & p.isNull(), F.lit(None)).when(p.isNull() | (d <= p), "DOCTOR").otherwise("PATIENT")


def _evidence(rows: DataFrame, cues: Cues) -> DataFrame:
    """Rows with what their own words and those joined to the rows beside them say."""
    w = Window.partitionBy("session_id").orderBy("position")
    text, beside = F.coalesce("text", F.lit("")), lambda f: F.coalesce(f("text").over(w), F.lit(""))
    rows = rows.withColumns({"own_words": cue_words(text), "words_before": cue_words(beside(F.lag)), "words_after": cue_words(beside(F.lead)), "role_after": F.lead("role").over(w)})
    rows = rows.withColumns({"own": _line(F.col("own_words")), "asked": _line(F.col("words_before")), "backward": _line(F.concat("words_before", "own_words")), "forward": _line(F.concat("own_words", "words_after"))})
    strong_d, strong_p = ([c for c in side if c not in cues.weak] for side in (cues.doctor, cues.patient))
    shares = lambda line: F.exists(_list(cues.patient), lambda p: F.contains(F.col(line), p) & F.arrays_overlap(F.split(F.trim(p), " "), F.col("own_words")))
    meaning = F.filter("own_words", lambda x: ~x.isin(list(cues.fillers))) if cues.fillers else F.col("own_words")
    return rows.select(
        "session_id", "position", "segment_id", "role", "fixed", "role_after",
        (F.size("own_words") > 0).alias("speaks"), F.size("own_words").between(1, SHORT).alias("short"),
        _role("own", cues).alias("direct"), _role("backward", cues).alias("with_before"), _role("forward", cues).alias("with_after"),
        (F.trim("own").isin(list(cues.answers)) & _any("asked", cues.questions)).alias("answers"),
        F.coalesce(F.try_element_at(meaning, F.lit(1)).isin(list(cues.starts)), F.lit(False)).alias("starts"),
        shares("backward").alias("shares_before"), shares("forward").alias("shares_after"),
        _any("own", strong_d).alias("own_doctor"), _any("own", strong_p).alias("own_patient"),
        (_any("backward", strong_d) | _any("forward", strong_d)).alias("joined_doctor"), (_any("backward", strong_p) | _any("forward", strong_p)).alias("joined_patient"),
    )


def _inferred(before: str | None) -> Column:
    """The role that a row's evidence gives after a row of role `before`; null if none."""
    c, is_before = F.col, lambda role: F.lit(before == role)
    return (
        F.when(c("direct").isNotNull(), c("direct"))
        .when(c("answers") & is_before("DOCTOR"), "PATIENT")
        .when(~c("short"), F.lit(None))
        .when(is_before("DOCTOR") & (c("with_before") == "DOCTOR"), "DOCTOR")
        .when((c("role_after") == "DOCTOR") & c("starts") & (c("with_after") == "DOCTOR"), "DOCTOR")
        .when(is_before("PATIENT") & (c("with_before") == "PATIENT") & c("shares_before"), "PATIENT")
        .when((c("role_after") == "PATIENT") & (c("with_after") == "PATIENT") & c("shares_after"), "PATIENT")
    )


def _outcomes(rows: DataFrame) -> DataFrame:
    """For each role before: the role with (`on`) and without (`off`) weak evidence, and whether it is a strong change."""
    out = []
    for name, before in _BEFORE.items():
        found = F.col(f"to_{name}")
        rows = rows.withColumn(f"to_{name}", F.when(~F.col("fixed") & F.col("speaks"), _inferred(before)))
        changes = found.isNotNull() & (found != F.coalesce("role", F.lit("")))
        by = lambda kind, found=found: F.when(found == "DOCTOR", F.col(f"{kind}_doctor")).otherwise(F.col(f"{kind}_patient"))
        strong = changes & (F.col("direct") == found) & by("own")
        holds = strong | (F.col("answers") & F.lit(before == "DOCTOR")) | by("joined")
        out += [F.when(changes, found).otherwise(F.col("role")).alias(f"on_{name}"), F.when(changes & holds, found).otherwise(F.col("role")).alias(f"off_{name}"), F.coalesce(strong, F.lit(False)).alias(f"strong_{name}")]
    return rows.select("session_id", "position", "segment_id", "role", *out)


def cue_step(state: dict | None, row: dict) -> tuple[dict, list[dict]]:
    """Carries the role before under both readings."""
    state = state or {"on": "other", "off": "other"}
    on, off = row[f"on_{state['on']}"], row[f"off_{state['off']}"]
    out = {"session_id": row["session_id"], "position": row["position"], "segment_id": row["segment_id"], "role": row["role"], "on": on, "off": off, "strong": row[f"strong_{state['on']}"]}
    name = lambda role: (role or "other").lower() if role in ("DOCTOR", "PATIENT") else "other"
    return {"on": name(on), "off": name(off)}, [out]


def cue_cleanup(rows: DataFrame, cues: Cues = CONSULTATION) -> DataFrame:
    """(session_id, position, segment_id, role, changed, strong): roles after the cues, and the session's strong changes.

    `rows` has session_id, position, segment_id, role, text and `fixed` (rows whose
    role stays). A row's own cue decides; a short answer after a doctor's question
    is the patient's; a row of up to three words may complete a phrase with the row
    before it, as that reads by then, or after it. Weak cues, and phrases joined
    without a strong one, count only where the session has three or more changes by
    strong cues of its own. Null and empty texts say nothing.
    """
    kind = "session_id long, position long, segment_id string, role string, on string, off string, strong boolean"
    each = fold(_outcomes(_evidence(rows, cues)), ["session_id"], ["position"], cue_step, kind)
    strong = F.count_if("strong").over(Window.partitionBy("session_id"))
    role = F.when(F.col("n_strong") >= WEAK_FROM, F.col("on")).otherwise(F.col("off"))
    each = each.withColumn("n_strong", strong).withColumn("now", role)
    changed = ~F.col("now").eqNullSafe(F.col("role"))
    return each.select("session_id", "position", "segment_id", F.col("now").alias("role"), changed.alias("changed"), F.col("n_strong").alias("strong"))
