"""Word errors against a plain dynamic programme, and of long rows."""

import random

from parlance.operators import sequences


def plain(ref, hyp):
    """(distance, deletions, substitutions, insertions), least in this order."""
    row = [(j, 0, 0, j) for j in range(len(hyp) + 1)]
    for w in ref:
        new = [(row[0][0] + 1, row[0][1] + 1, *row[0][2:])]
        for j, x in enumerate(hyp):
            d, dels, subs, ins = row[j]
            a = (d + (w != x), dels, subs + (w != x), ins)
            d, dels, subs, ins = row[j + 1]
            b = (d + 1, dels + 1, subs, ins)
            d, dels, subs, ins = new[j]
            new.append(min(a, b, (d + 1, dels, subs, ins + 1)))
        row = new
    return row[-1]


def test_edit_counts_equal_a_plain_table():
    rng = random.Random(5)
    for _ in range(300):
        ref, hyp = ([rng.choice("abcd") for _ in range(rng.randrange(14))] for _ in range(2))
        d, dels, subs, ins = plain(ref, hyp)
        assert sequences.edit_counts(ref, hyp) == (d, subs, ins, dels, len(ref) - subs - dels)


def test_long_rows_are_counted(spark):
    rows = [("a", ["x", "y"], ["x"] + ["z"] * 70_000 + ["y"]), ("b", ["x"] + ["z"] * 70_000, ["x"]), ("c", None, ["x"])]
    df = spark.createDataFrame(rows, "key string, ref array<string>, hyp array<string>")
    got = {r.key: tuple(r)[1:] for r in sequences.word_errors(df, "key", "ref", "hyp").collect()}
    assert got == {"a": (70_000, 0, 70_000, 0, 2), "b": (70_000, 0, 0, 70_000, 1), "c": (1, 0, 1, 0, 0)}
