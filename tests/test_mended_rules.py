"""Cases of rules that a query's SQL alone would not show."""

from parlance.operators import governance, notes, rules
from pyspark.sql import functions as F


def test_lexicon_takes_words_and_replacements_literally(spark):
    df = spark.createDataFrame([("Cost of cost, c++ and A.B",), (r"a\b CO  ST",)], "text string")
    text, found = rules.lexicon_rewrite(F.col("text"), [("co$t", ["cost", "co st"]), (r"x\1", ["c++", r"a\b"]), ("ab", ["a.b"])])
    assert [tuple(r) for r in df.select(text, found).collect()] == [("Co$t of co$t, x\\1 and Ab", 4), ("x\\1 Co$t", 2)]


def test_orphans_are_judged_by_their_own_speakers_words(spark):
    rows = [(1, 0, "a", "DOCTOR", "tell", True), (1, 1, "a", "DOCTOR", "me more", True), (1, 2, "b", "PATIENT", "i have pain", False), (1, 3, "c", "DOCTOR", "nothing here", True), (1, 4, "b", "PATIENT", "tell me", False), (1, 5, "a", "DOCTOR", "I have it, tell me", True)]
    df = spark.createDataFrame(rows, "session_id long, position long, speaker_id string, role string, text string, orphan boolean")
    got = {r.position: r.role for r in rules.orphan_role(df, ["tell me"], ["i have"]).collect()}
    # 3 has no cue and another speaker's rows beside it; 4 is no orphan; 5 has the patient's cue first
    assert got == {0: "DOCTOR", 1: "DOCTOR", 2: "PATIENT", 3: "DOCTOR", 4: "PATIENT", 5: "PATIENT"}


def test_only_a_doctor_performs_an_examination(spark):
    rule = {"exam": "exam showed", "performed": "i checked", "intent": "will do an exam", "absent": "no exam", "presupposed": "on exam"}
    rows = spark.createDataFrame([(1, "PATIENT", "I checked my car"), (2, "doctor", "I checked it"), (3, "DOCTOR", "hello")], "session_id long, role string, text string")
    claims = [(s, f"{s}{i}", t) for s in (1, 2, 3) for i, t in enumerate(["Exam showed nothing.", "No fever on exam.", "We will do an exam showed.", "No exam, exam showed", None, ""])]
    got = notes.needs_exam(spark.createDataFrame(claims, "session_id long, claim_id string, claim string"), rows, **rule).collect()
    kinds = {"0": "exam-claim-without-performance", "1": "exam-presupposed-without-performance"}
    assert {(r.claim_id, r.subtype) for r in got} == {(f"{s}{i}", k) for s in (1, 3) for i, k in kinds.items()}


def test_quotes_bridge_one_short_interjection(spark):
    said = [("PATIENT", "i feel"), ("DOCTOR", "mhm"), ("PATIENT", "fine today"), ("DOCTOR", "ok"), ("NURSE", "yes"), ("PATIENT", "and cold"), ("DOCTOR", "one two three four"), ("PATIENT", "now"), ("DOCTOR", "..."), ("PATIENT", "then go")]
    rows = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(said)], "session_id long, position long, role string, text string")
    asked = {"i feel fine today": True, "feel fine": True, "today and": False, "cold now": False, "now then go": True, "go": True, "": False, "i fine": False}
    quotes = spark.createDataFrame([(1, q, "PATIENT", q) for q in asked] + [(1, "mhm ok", "DOCTOR", "mhm ok")], "session_id long, claim_id string, role string, quote string")
    assert {r.claim_id: r.found for r in notes.quotes_found(quotes, rows).collect()} == {**asked, "mhm ok": True}


def test_forbidden_keys_at_any_depth_in_arrays_and_any_case(spark):
    deep = '{"x": ' * 9 + '{"token": 1}' + "}" * 9
    texts = ['{"a":[{"token":{"secret":1}}],"b.c":{"token":2},"TOKEN":1}', deep, "[]", "token", None, '"token"', '[[{"q\\"x":{"Secret":[]}}]]']
    df = spark.createDataFrame(list(enumerate(texts)), "record_id long, json string")
    got = {(r.record_id, r.path) for r in governance.forbidden_keys(df, "json", ["token", "secret"]).collect()}
    assert got == {(0, "$.a[0].token"), (0, "$.a[0].token.secret"), (0, '$."b.c".token'), (0, "$.TOKEN"), (1, "$" + ".x" * 9 + ".token"), (6, '$[0][0]."q\\"x".Secret')}


def _below_explode(df):
    """The optimised plan's lines below its last explode, and those above it."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = max(i for i, line in enumerate(lines) if "Generate" in line)
    return "\n".join(lines[at + 1 :]), "\n".join(lines[:at])


def test_words_are_split_once_for_each_row(spark):
    from parlance.plans import catalogue
    from parlance.sources.adapt import numbered_words, timed_words, transcript

    sf = "/root/testdata/sf0.001"
    assert "regexp_extract_all" not in _below_explode(timed_words(transcript(spark, sf)))[1]
    plan = catalogue.QUERIES["og14_token_times"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    for name in ("ok9_superseded_states", "ok10_unconfirmed_actions"):
        plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.split("\n"):
            assert not ("arrays_overlap" in line and "token#" in line and "explode" not in line and "array_distinct" not in line), line
    words = numbered_words(transcript(spark, sf)).select("session_id", "position", "i", "at").collect()
    by = {}
    for r in sorted(words, key=lambda r: (r.session_id, r.position, r.i)):
        by[r.session_id] = by.get(r.session_id, 0) + 1
        assert r.at == by[r.session_id]


def test_chunks_and_quotes_carry_no_text_along(spark):
    from parlance.operators import relabel
    from pyspark.sql import functions as F

    texts = spark.createDataFrame([(1, " ".join(map(str, range(40)))), (2, ""), (3, None), (4, "a")], "id long, text string")
    found = relabel.chunked_words(texts, "id", F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))
    assert sorted((r.id, r.chunk, r.text, r.start_ms, r.end_ms) for r in found.collect()) == [(1, 0, " ".join(map(str, range(18))), 0, 1000), (1, 1, " ".join(map(str, range(18, 36))), 1000, 2000), (1, 2, "36 37 38 39", 2000, 3000), (4, 0, "a", 0, 1000)]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_packed_interval_files_equal_files(spark, tmp_path):
    import glob

    from parlance.plans import catalogue
    from parlance.sources import readers

    interval = 'xmin = {}\nxmax = {}\ntext = "{}"\n'
    grids = {"doctor-1": interval.format(0, 1.5, "hi\x1e there") + interval.format(2, 90, "late"), "patient-2": interval.format(1, 2, " "), "x": interval.format(3, 4, "y")}
    for name, text in grids.items():
        (tmp_path / "files" / name).mkdir(parents=True)
        (tmp_path / "files" / name / "part.txt").write_text(text)
    spark.createDataFrame(list(grids.items()), "file string, value string").write.json(str(tmp_path / "packed"))
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    packed = rows(readers.packed_textgrid(spark, str(tmp_path / "packed"), 60_000))
    assert packed == rows(readers.textgrid(spark, str(tmp_path / "files" / "*"), 60_000)) and len(packed) == 3
    grid = catalogue.QUERIES["oa3_oa4_textgrid"](spark, "/root/testdata/sf0.001")
    assert len(grid.inputFiles()) < 100  # a file for each role of each session before
