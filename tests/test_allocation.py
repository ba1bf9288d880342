"""Allocation operators without SQL against plain rules, and their edges."""

from collections import defaultdict
from difflib import SequenceMatcher

from parlance.operators import allocation, evidence
from parlance.operators.sequences import edit_counts
from parlance.plans import catalogue
from pyspark.sql import functions as F


def test_garble_similarity_equals_the_standard_library(spark):
    rows = [("s", "Metform in, twice"), ("s", "met four men"), ("t", None), ("t", ""), ("u", "metformin")]
    got = {(r.session_id, r.term): r.similarity for r in allocation.garble_similarity(spark.createDataFrame(rows, "session_id string, text string"), ["Metformin", "12"]).collect()}
    said = {"s": ["metformintwice", "metfourmen"], "t": [""], "u": ["metformin"]}
    want = {(s, t): max(SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for y in ys) for s, ys in said.items() for t, x in (("Metformin", "metformin"), ("12", ""))}
    assert got == want and got["u", "Metformin"] == 1.0


def test_regional_errors_count_each_word_once(spark):
    sf = "/root/testdata/sf0.001"
    found = catalogue.QUERIES["ox_op1_regional_errors"](spark, sf).collect()
    assert {r.region for r in found} == {"clean", "overlap"}
    from parlance.sources.adapt import reference, timed_words, transcript

    spoken = reference(spark, sf).select("session_id", "ref_text").collect()
    shown = defaultdict(int)
    for r in timed_words(transcript(spark, sf)).select(F.col("session_id").cast("string").alias("s")).collect():
        shown[r.s] += 1
    refs = defaultdict(int)
    import re

    for r in spoken:
        refs[str(r.session_id)] += len(re.findall("[a-z']+", r.ref_text.lower()))
    for s in {r.session_id for r in found}:
        mine = [r for r in found if r.session_id == s]
        assert sum(r.matches + r.substitutions + r.deletions for r in mine) == refs[s]
        assert sum(r.matches + r.substitutions + r.insertions for r in mine) == shown[s]
    assert edit_counts([], ["a"])[2] == 1


def test_share_confidence_edges(spark):
    rows = [([], 0, 1, 1), ([90, 50], 0, 0, 2), ([90, 50], 0, 1, 0), ([90, None], 0, 2, 2), ([90, 50], 5, 6, 6), ([90, 50, 70], 1, 2, 3)]
    df = spark.createDataFrame(rows, "c array<int>, a int, z int, n int")
    got = [r[0] for r in df.select(allocation.share_confidence(F.col("c"), F.col("a"), F.col("z"), F.col("n"))).collect()]
    assert got == [None, None, None, 90, 50, 50]


def test_spoken_numbers(spark):
    df = spark.createDataFrame([("24",), ("twenty-four",), ("about forty",), ("go sleep",), ("seven",)], "q string")
    assert [r[0] for r in df.select(evidence.number_of(F.col("q"))).collect()] == [24, 24, 40, None, 7]


def test_files_by_hash(spark, tmp_path):
    import hashlib

    for name in "ab":
        (tmp_path / name).write_text(name * 3)
    found = {r.path.rsplit("/", 1)[1]: r.sha256 for r in allocation.file_hashes(spark, str(tmp_path)).collect()}
    assert found == {n: hashlib.sha256(n.encode() * 3).hexdigest() for n in "ab"}
