"""Hand-made notes for the violation finder."""

from parlance.operators import fidelity

RULES = fidelity.Rules(
    topics={"fever": ["fever", "febrile", "temperature"], "weight change": ["weight"]},
    characteristics={"onset": ("(^| )(sudden|come on)( |[.,?]|$)", "(^| )(sudden|gradual)( |[.,?]|$)")},
    uncertain="don't know|not sure",
    preserved="unclear|uncertain|unsure",
    denial="(^| )(no|not|never)( |[.,]|$)",
    denied="(^| )(denies|denied|no)( |[.,]|$)",
    equivocal="don't think so",
    states={"anxious": ("anxious", "worried|nervous")},
    exam={"exam": "exam (showed|revealed)", "performed": "i've checked", "intent": "will do an exam", "absent": "no exam", "presupposed": "on exam"},
    doctor_quote="doctor said",
)
ROWS = [(1, 0, "DOCTOR", "Did it come on sudden?"), (1, 1, "PATIENT", "I don't know really"), (1, 2, "DOCTOR", "Any temperature?"), (1, 3, "PATIENT", "No."), (1, 4, "DOCTOR", "Your weight, did it change?"), (1, 5, "PATIENT", "I don't think so, no weight change, just a bit"), (1, 6, "PATIENT", None), (2, 0, "PATIENT", "I am worried, no fever"), (2, 1, "DOCTOR", "I've checked your chest")]
NOTES = {
    (1, "Onset was sudden."): [("uncertainty-resolved", "resolved-to-definitive", 1)],
    (1, "It is described as gradual."): [("uncertainty-resolved", "invented-attribution", 1)],
    (1, "A sudden pain."): [("uncertainty-resolved", "uncertainty-not-preserved", 1)],
    (1, "Whether sudden is unclear."): [],
    (1, 'Sudden or not, "I don\'t know".'): [],
    (1, "Denies fever."): [],
    (1, "No weight change."): [("uncertainty-resolved", "hedge-dropped", 5)],
    (1, "No weight change, anxious."): [("patient-state-without-evidence", "anxious", None)],
    (1, "Exam showed nothing."): [("exam-not-performed", "exam-claim-without-performance", None)],
    (1, 'Says "a lot of pain" and "just a bit".'): [("non-verbatim-quote", "not-verbatim", None)],
    (1, 'The doctor said "your weight".'): [],
    (2, "Denies weight loss."): [("negative-without-denial", "weight change", None)],
    (2, "Anxious. Exam revealed a sudden wheeze, no fever."): [],
    (3, "Denies fever, anxious."): [],
    (1, None): [],
    (1, ""): [],
}


def test_each_violation_has_a_row(spark):
    rows = spark.createDataFrame(ROWS, "session_id long, position long, role string, text string")
    sentences = [(s, "plan" if i % 2 else None, i, t) for i, (s, t) in enumerate(NOTES)]
    got = {}
    for r in fidelity.violations(spark.createDataFrame(sentences, "session_id long, location string, ordinal long, sentence string"), rows, RULES).collect():
        got.setdefault(r.ordinal, []).append((r.rule, r.subtype, r.row))
    want = {i: v for i, v in enumerate(NOTES.values()) if v}
    assert got == want


def test_no_rows_and_no_sentences(spark):
    rows = spark.createDataFrame([], "session_id long, position long, role string, text string")
    sentences = spark.createDataFrame([], "session_id long, location string, ordinal long, sentence string")
    assert fidelity.violations(sentences, rows, RULES).count() == 0
