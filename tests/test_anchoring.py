"""Anchors that follow each other, and where the words between them go."""

import random
from difflib import SequenceMatcher

from parlance.operators import anchoring


def test_windows_equal_a_search_of_all():
    rng = random.Random(2)
    for _ in range(150):
        stream = [rng.choice("abcdef") for _ in range(rng.randrange(1, 40))]
        words = [rng.choice("abcdef") for _ in range(rng.randrange(1, 9))]
        cursor, n, best = rng.randrange(len(stream)), len(words), None
        low, high = max(0, cursor - 2), min(len(stream), cursor + max(12, 3 * n + 8))
        short = max(1, n - 3)
        for a in range(low, high):
            for z in range(min(high, a + short), min(high, a + min(max(short, n + 6), high - low)) + 1):
                score = SequenceMatcher(None, words, stream[a:z]).ratio()
                if best is None or score > best[2]:
                    best = (a, z, score)
        want = best if best and best[2] >= (0.86 if n <= 2 else 0.48) else None
        assert anchoring.best_window(words, stream, cursor) == want


def test_anchors_are_searched_for_once(spark):
    from parlance.plans import catalogue

    plan = catalogue.QUERIES["og10_cursor_runs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1


def runs(spark, rows, heard):
    data = [(1, i, role, text) for i, (role, text) in enumerate(rows)]
    words = spark.createDataFrame([(1, i, w) for i, w in enumerate(heard.split())], "session_id long, at long, word string")
    found = anchoring.allocation(spark.createDataFrame(data, "session_id long, position long, role string, text string"), words).collect()
    heard = heard.split()
    places = sorted((r.from_word, r.to_word) for r in found)
    assert [a for a, _ in places] == [0, *(z for _, z in places)][: len(places)] and (places[-1][1] if places else 0) == len(heard)
    return [(r.position, r.source, " ".join(heard[r.from_word : r.to_word])) for r in sorted(found, key=lambda r: r.from_word)]


def test_gaps_go_where_they_belong(spark):
    rows = [("DOCTOR", "where does it hurt most"), ("PATIENT", "it hurts in my left knee"), ("DOCTOR", "since when does it"), ("PATIENT", "for about three long weeks")]
    heard = "well where does it hurt most really it hurts in my left knee badly then so since when does it oh dear me for about three long weeks now"
    assert runs(spark, rows, heard) == [
        (0, "opening", "well"), (0, "anchor", "where does it hurt most"), (0, "gap", "really"), (1, "anchor", "it hurts in my left knee"), (2, "gap", "badly then so"),
        (2, "anchor", "since when does it"), (3, "gap", "oh dear me"), (3, "anchor", "for about three long weeks"), (3, "gap", "now"),
    ]


def test_rows_without_anchor_and_sessions_with_few(spark):
    rows = [("DOCTOR", "where does it hurt most"), ("PATIENT", "zebra zebra zebra"), ("DOCTOR", "since when does it"), ("PATIENT", None)]
    heard = "where does it hurt most my knee it seems since when does it go on"
    assert runs(spark, rows, heard) == [(0, "anchor", "where does it hurt most"), (2, "gap", "my knee it seems"), (2, "anchor", "since when does it"), (2, "gap", "go on")]
    shared = runs(spark, [("DOCTOR", "alpha beta"), ("PATIENT", "gamma delta"), ("DOCTOR", "")], "one two three four five")
    assert shared == [(0, "shared", "one two"), (1, "shared", "three four five")]
    assert runs(spark, rows, "") == []
