"""Hand-made sessions of the cue cleanup."""

from parlance.operators import cues


def cleaned(spark, rows, fixed=()):
    data = [(1, i, f"s{i}", role, text, i in fixed) for i, (role, text) in enumerate(rows)]
    df = spark.createDataFrame(data, "session_id long, position long, segment_id string, role string, text string, fixed boolean")
    return [r.role for r in cues.cue_cleanup(df).orderBy("position").collect()]


def test_strong_cues_and_answers_after_questions(spark):
    rows = [("PATIENT", "Can you tell me where?"), ("DOCTOR", "Yeah."), ("PATIENT", "Nothing to see"), ("DOCTOR", "Yeah."), ("DOCTOR", None), (None, "I'm worried.")]
    # the second row answers what the first is by then; the fourth follows no question
    assert cleaned(spark, rows) == ["DOCTOR", "PATIENT", "PATIENT", "DOCTOR", "DOCTOR", "PATIENT"]
    assert cleaned(spark, rows, fixed=(0,)) == ["PATIENT", "DOCTOR", "PATIENT", "DOCTOR", "DOCTOR", "PATIENT"]


def test_short_rows_complete_phrases(spark):
    rows = [("DOCTOR", "So how can I"), ("PATIENT", "help this afternoon"), ("PATIENT", "uh can"), ("DOCTOR", "you tell us more"), ("PATIENT", "Well, it was my"), ("DOCTOR", "chest it hurts"), ("DOCTOR", "do for you?"), ("PATIENT", "I have pain")]
    # "do for you" has no word of the patient's cue that follows it
    assert cleaned(spark, rows) == ["DOCTOR", "DOCTOR", "DOCTOR", "DOCTOR", "PATIENT", "PATIENT", "DOCTOR", "PATIENT"]


def test_weak_cues_count_after_three_strong_changes(spark):
    weak = [("PATIENT", "Okay."), ("DOCTOR", "and I hope so too")]
    strong = [("PATIENT", "tell me about it all"), ("DOCTOR", "i noticed it then first"), ("PATIENT", "have you been there then")]
    assert cleaned(spark, weak + strong[:2]) == ["PATIENT", "DOCTOR", "DOCTOR", "PATIENT"]
    assert cleaned(spark, weak + strong) == ["DOCTOR", "PATIENT", "DOCTOR", "PATIENT", "DOCTOR"]
    assert cleaned(spark, []) == []
