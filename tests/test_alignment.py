"""Word alignment against plain recursion, and rules on rows worked out by hand."""

import random
import uuid
from functools import lru_cache
from itertools import combinations

from parlance.operators import alignment, governance, live, notes
from pyspark.sql import functions as F


def _cost(a, b):
    @lru_cache(None)
    def d(i, j):
        if not i or not j:
            return i + j
        return min(d(i - 1, j - 1) + (a[i - 1] != b[j - 1]), d(i - 1, j) + 1, d(i, j - 1) + 1)

    return d(len(a), len(b))


def _pairs(n, most=9):
    rng = random.Random(4)
    return [([rng.choice("abc") for _ in range(rng.randrange(most))], [rng.choice("abc") for _ in range(rng.randrange(most))]) for _ in range(n)]


def test_edit_operations_rebuild_both_sides_at_least_cost():
    for a, b in _pairs(300):
        ops = alignment.edit_operations(a, b)
        assert sum(c != "M" for c in ops) == _cost(tuple(a), tuple(b))
        assert sum(c in "MSD" for c in ops) == len(a) and sum(c in "MSI" for c in ops) == len(b)
        i = j = 0
        for c in ops:
            assert c != "M" or a[i] == b[j]
            assert c != "S" or a[i] != b[j]
            i, j = i + (c in "MSD"), j + (c in "MSI")


def test_forced_matches_are_in_every_longest_common_subsequence():
    for a, b in _pairs(120, 7):
        every, best = [], 0
        for n in range(min(len(a), len(b)), 0, -1):
            for x in combinations(range(len(a)), n):
                for y in combinations(range(len(b)), n):
                    if all(a[i] == b[j] for i, j in zip(x, y)):
                        every.append(set(zip(x, y)))
            if every:
                best = n
                break
        want = set.intersection(*every) if best else set()
        assert set(alignment.forced_matches(a, b)) == want
        at = {}
        for one in [s for s in every if len(s) == best]:
            for rank, pair in enumerate(sorted(one)):
                at.setdefault(rank, set()).add(pair)
        unsure = [p for ps in at.values() if len(ps) > 1 for p in ps]
        _, left, right = alignment.optimal_matches(a, b)
        assert {i for i, x in enumerate(left) if x} == {i for i, _ in unsure} and {j for j, x in enumerate(right) if x} == {j for _, j in unsure}


def test_whole_recordings_stay_in_little_memory():
    import tracemalloc

    rng = random.Random(9)
    a = [f"w{rng.randrange(4000)}" for _ in range(12_000)]
    b = [w for i, w in enumerate(a) if i % 11] + ["end"]
    tracemalloc.start()
    forced = alignment.forced_matches(a, b)
    ops = alignment.edit_operations(a, b)
    assert tracemalloc.get_traced_memory()[1] < 120 << 20
    tracemalloc.stop()
    assert ops.count("M") == len(b) - 1 and ops.count("D") == len(a) - len(b) + 1 and ops.count("I") == 1
    assert len(forced) > 0.9 * len(b) and all(a[i] == b[j] for i, j in forced)
    for f in (alignment.forced_matches, alignment.edit_operations):
        try:
            f(["a"] * 65_536, ["a"])
        except ValueError:
            continue
        raise AssertionError("longer sides are refused")


def test_only_places_of_equal_words_are_looked_at():
    import time

    rng = random.Random(3)
    a = [f"w{rng.randrange(9000)}" for _ in range(30_000)]
    b = [w for i, w in enumerate(a) if i % 11]
    began = time.process_time()
    forced = alignment.forced_matches(a, b)
    assert time.process_time() - began < 10 and len(forced) > 0.9 * len(b)
    # stretches give what one stretch gives
    x, y = (["a", "b", "a"] * 700)[:2000], ["a", "b"] * 900
    found, left, right = alignment.optimal_matches(x, y)
    assert not set(left.nonzero()[0]) & {i for i, _ in found} and not set(right.nonzero()[0]) & {j for _, j in found}


def test_tables_cut_into_stretches_give_what_one_table_gives(monkeypatch):
    rng = random.Random(12)
    sides = _pairs(60, 40) + [(["a"] * 30, ["a"] * 50), (["a", "b"] * 20, ["b", "a"] * 15)]
    sides += [(a, [w if rng.random() < 0.8 else "x" for w in a for _ in range(rng.choice([0, 1, 1, 2]))]) for a in ([f"w{rng.randrange(15)}" for _ in range(80)] for _ in range(40))]
    want = [[x.tolist() for x in alignment.optimal_codes(*alignment._codes(a, b))] for a, b in sides]
    for cells, stretches, held in ((1, 2, 1 << 20), (20, 3, 0), (200, 64, 300)):
        monkeypatch.setattr(alignment, "CELLS", cells)
        monkeypatch.setattr(alignment, "STRETCHES", stretches)
        monkeypatch.setattr(alignment, "HELD", held)
        assert [[x.tolist() for x in alignment.optimal_codes(*alignment._codes(a, b))] for a, b in sides] == want


def test_sessions_of_any_length_are_aligned(spark):
    said = [f"w{i}" for i in range(70_000)]
    said[50_000] = said[49_999]
    shown = [w for i, w in enumerate(said) if i % 11 and i != 49_999] + ["end"]
    want, j = set(), 0
    for i in range(70_000):
        if i % 11 and i != 49_999:
            want.add(("DOCTOR", "forced", i, j) if i != 50_000 else ("DOCTOR", "ambiguous", None, j))
            j += 1
    refs = spark.createDataFrame([(1, "DOCTOR", said), (1, "PATIENT", ["w65000", "w65001"])], "session_id long, role string, words array<string>")
    hyps = spark.createDataFrame([(1, shown)], "session_id long, words array<string>")
    places = [shown.index("w65000"), shown.index("w65001")]
    want |= {("PATIENT", "forced", k, j) for k, j in enumerate(places)}
    found = alignment.role_matches(refs, hyps)
    assert {(r.role, r.kind, r.ref_index, r.hyp_index) for r in found.collect()} == want
    kinds = {r["class"]: r["count"] for r in alignment.one_role_words(found).groupBy("class").count().collect()}
    assert kinds == {"exact_unambiguous": len(shown) - 4, "cross_role_ambiguous": 2, "within_role_ambiguous": 1}


def test_rows_are_taken_one_at_a_time_and_numbered_by_batch():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"r": [["a", "b"], None, [], ["c", "a"]], "h": [["b"], ["a"], ["c"], []]}, pa.schema({"r": pa.list_(pa.string()), "h": pa.list_(pa.string())}))
    got = [[list(map(int, x)) for x in v] for v in alignment._coded(batch.slice(0), ["r", "h"])]
    a, b, c = got[0][0][0], got[0][0][1], got[3][0][0]
    assert len({a, b, c}) == 3 and got == [[[a, b], [b]], [[], [a]], [[], [c]], [[c, a], []]]
    part = [[list(map(int, x)) for x in v] for v in alignment._coded(batch.slice(2), ["r", "h"])]
    assert [[len(x) for x in v] for v in part] == [[0, 1], [2, 0]] and part[0][1][0] == part[1][0][0]


def test_phrases_may_cross_rows(spark):
    rows = spark.createDataFrame([(1, 0, ["x", "a"]), (1, 1, []), (1, 2, ["b"]), (1, 3, ["c", "a", "b", "c"]), (2, 0, ["a"])], "session_id long, position long, words array<string>")
    assert {tuple(r) for r in alignment.occurrences(rows, ["a", "b", "c"], ["x"]).collect()} == {(1, 1, 0, 3), (1, 4, 3, 3), (1, 0, 0, 0)}
    plan = alignment.occurrences(rows, ["a", "b"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1  # what is exploded are places, not words


def test_edit_steps_as_a_table_function(spark):
    alignment.register_edit_steps(spark)
    pairs = spark.createDataFrame([(1, ["a", "b", "c"], ["a", "x", "c", "d"]), (2, None, ["a"]), (3, [], [])], "id long, r array<string>, h array<string>")
    got = spark.sql("SELECT p.id, s.* FROM {pairs} AS p, LATERAL edit_steps(p.r, p.h) AS s", pairs=pairs).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, "M", 0, 0), (1, 1, "S", 1, 1), (1, 2, "M", 2, 2), (1, 3, "I", None, 3), (2, 0, "I", None, 0)]


def test_words_of_one_role(spark):
    refs = spark.createDataFrame([(1, "DOCTOR", "how are you today".split()), (1, "PATIENT", "you are well well".split()), (2, "DOCTOR", [])], "session_id long, role string, words array<string>")
    shown = spark.createDataFrame([(1, "how are well today zebra".split()), (2, ["a"])], "session_id long, words array<string>")
    found = alignment.role_matches(refs, shown)
    assert {tuple(r) for r in found.collect()} == {(1, "DOCTOR", "forced", 0, 0), (1, "DOCTOR", "forced", 1, 1), (1, "DOCTOR", "forced", 3, 3), (1, "PATIENT", "forced", 1, 1), (1, "PATIENT", "ambiguous", None, 2)}
    got = {(r.hyp_index, r["class"], r.role, r.ref_index) for r in alignment.one_role_words(found).collect()}
    assert got == {(0, "exact_unambiguous", "DOCTOR", 0), (1, "cross_role_ambiguous", None, None), (2, "within_role_ambiguous", None, None), (3, "exact_unambiguous", "DOCTOR", 3)}


def test_overlap_ambiguous_words(spark):
    line = [("good", False), ("so", True), ("yes", True), ("then", False), ("so", False)]
    refs = spark.createDataFrame([(1, i, w, o) for i, (w, o) in enumerate(line)] + [(2, 0, "good", False)], "session_id long, place int, word string, overlaps boolean")
    shown = spark.createDataFrame([(1, "good yes so".split()), (2, ["good"])], "session_id long, words array<string>")
    # `yes` and `so` each match in an order of their own: good+yes+so(4) is the longest, all forced; only `yes` overlaps
    assert [tuple(r) for r in alignment.overlap_ambiguous(refs, shown).collect()] == [(1, 1)]
    shown = spark.createDataFrame([(1, ["good", "so"])], "session_id long, words array<string>")
    assert [tuple(r) for r in alignment.overlap_ambiguous(refs, shown).collect()] == [(1, 1)]


def test_anchor_takes_the_most_similar_window():
    stream = "so the patient has a chest pain since monday and takes aspirin".split()
    assert alignment.anchor("chest pains since".split(), stream, 3)[:2] == (5, 8)
    assert alignment.anchor(["zebra"], stream, 0) is None
    assert alignment.anchor(["pain"], stream, 6)[:2] == (6, 7)


def test_allocation_covers_each_word_once(spark):
    from parlance.plans import catalogue

    rows = catalogue.QUERIES["og10_allocated_words"](spark, "/root/testdata/sf0.001").collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.session_id, r.position)):
        assert r.from_word == by.get(r.session_id, 0) and r.to_word >= r.from_word
        by[r.session_id] = r.to_word


def test_uuid5_equals_the_library(spark):
    names = ["https://example.org/a", "", "ünï"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(governance.uuid5(uuid.NAMESPACE_URL, F.col("n"))).collect()
    assert [r[0] for r in got] == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_sentences_go_on_inside_quotations(spark):
    text = "He said \"No. Never. I won't.\" Then he left. 3 days passed! “One. Two” went on."
    got = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(notes.sentences(F.col("t"))).collect()
    assert got[0][0] == ["He said \"No. Never. I won't.\" Then he left.", "3 days passed!", "“One. Two” went on."]
    assert got[1][0] == [] and got[2][0] is None


def test_punctuation_joins_the_word_before(spark):
    got = spark.createDataFrame([(["¿", "you", "?", "!", "well", ","],)], "t array<string>").select(alignment.folded_punctuation(F.col("t"))).first()[0]
    assert got == ["¿", "you?!", "well,"]


def test_two_speakers_swap(spark):
    ids = F.array(F.lit("a"), F.lit("b"))
    row = spark.range(1).select(live.completed_swap(F.create_map(F.lit("a"), F.lit("b")), ids, ids).alias("m"), live.completed_swap(F.create_map(F.lit("a"), F.lit("b")), ids, F.array(F.lit("b"))).alias("n")).first()
    assert row.m == {"a": "b", "b": "a"} and row.n == {"a": "b"}


def test_fragments_join_and_are_judged_anew(spark):
    rows = [(1, 0, "s", "well", 0, 500), (1, 1, "s", "I had a long day", 800, 3000), (1, 2, "s", "and then I went home", 3200, 6000), (1, 3, "t", "oh", 6100, 6300), (1, 4, "s", "yes", 6400, 6600)]
    got = notes.merged_fragments(spark.createDataFrame(rows, "session_id long, position int, speaker_id string, text string, start_ms long, end_ms long")).orderBy("position").collect()
    assert [(r.position, r.n_rows, r.text) for r in got] == [(0, 2, "well I had a long day"), (2, 1, "and then I went home"), (3, 1, "oh"), (4, 1, "yes")]
