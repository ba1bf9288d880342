"""Word sequences: bag differences, shingles, alignments and turn-level defects."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import rate, shingles


def bag(words: DataFrame, key: list[str], word: str = "word") -> DataFrame:
    """Occurrences of each word by key: key, word, n."""
    return words.groupBy(*key, word).agg(F.count(F.lit(1)).alias("n"))


def bag_difference(left: DataFrame, right: DataFrame, key: list[str], word: str = "word") -> DataFrame:
    """Occurrences on the left without a partner on the right: key, word, n. Counts, not sets, are subtracted."""
    a, b = bag(left, key, word), bag(right, key, word).withColumnRenamed("n", "m")
    return a.join(b, [*key, word], "left").withColumn("n", F.col("n") - F.coalesce("m", F.lit(0))).where("n > 0").drop("m")


def surplus_classes(reference: DataFrame, hypothesis: DataFrame, key: list[str]) -> DataFrame:
    """Surplus words by class and their rates, by key.

    A surplus word of the reference's vocabulary is a duplicate; another is
    garbled if reference words are missing and a false insertion if none are.
    """
    missing, surplus = bag_difference(reference, hypothesis, key), bag_difference(hypothesis, reference, key)
    vocabulary = reference.select(*key, "word").distinct().withColumn("known", F.lit(True))
    by = surplus.join(vocabulary, [*key, "word"], "left").groupBy(*key).agg(F.sum(F.when(F.col("known"), F.col("n"))).alias("dup"), F.sum(F.when(F.col("known").isNull(), F.col("n"))).alias("other"))
    total = lambda df, name: df.groupBy(*key).agg(F.count(F.lit(1)).alias(name))
    out = total(reference, "reference_words").join(total(hypothesis, "hypothesis_words"), key, "full").join(missing.groupBy(*key).agg(F.sum("n").alias("missing")), key, "left").join(by, key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = out.select(*key, *(zero(c).alias(c) for c in ("reference_words", "hypothesis_words", "missing", "dup", "other")))
    out = out.select(*key, "reference_words", "hypothesis_words", "missing", F.col("dup").alias("duplicates"), F.when(F.col("missing") > 0, F.col("other")).otherwise(0).alias("garbled"), F.when(F.col("missing") > 0, 0).otherwise(F.col("other")).alias("insertions"))
    return out.select("*", rate(F.col("insertions"), F.col("reference_words")).alias("insertion_rate"), rate(F.col("missing"), F.col("reference_words")).alias("omission_rate"), rate(F.col("duplicates"), F.col("hypothesis_words")).alias("duplicate_rate"))


def duplication_share(texts: DataFrame, id: str, words: Column, n: int = 4) -> DataFrame:
    """(id, duplication): the repeated share of each text's n-grams, 0 without any n-gram.

    Grams are counted as rows, so a long text is no long task.
    """
    at = texts.select(id, F.posexplode(words).alias("i", "word"))
    w = Window.partitionBy(id).orderBy("i")
    gram = at.select(id, F.xxhash64("word", *(F.lead("word", k).over(w) for k in range(1, n))).alias("gram"), F.lead("word", n - 1).over(w).alias("_last")).where("_last is not null")
    by = gram.groupBy(id, "gram").agg(F.count(F.lit(1)).alias("m")).groupBy(id).agg(F.round(1 - F.count(F.lit(1)) / F.sum("m"), 6).alias("duplication"))
    return texts.select(id).join(by, id, "left").withColumn("duplication", F.coalesce("duplication", F.lit(0.0)))


def seam_rereads(rows: DataFrame, words: Column, *, n: int = 3, reach_ms: int = 2000) -> DataFrame:
    """n-grams of each session that an earlier row with a start at most `reach_ms` away also has, repeats counted."""
    split = rows.select("session_id", "position", "start_ms", words.alias("words"))
    grams = split.select("session_id", "position", "start_ms", F.explode(shingles(F.col("words"), n)).alias("gram"))
    each = grams.groupBy("session_id", "gram", "start_ms", "position").agg(F.count(F.lit(1)).alias("times"))
    # of the earlier rows with this n-gram the last one is nearest, so it decides
    before = F.lag("start_ms").over(Window.partitionBy("session_id", "gram").orderBy("start_ms", "position"))
    found = each.withColumn("before", before).where(F.col("start_ms") - F.col("before") <= reach_ms).groupBy("session_id").agg(F.sum("times").alias("rereads"))
    return rows.select("session_id").distinct().join(found, "session_id", "left").withColumn("rereads", F.coalesce("rereads", F.lit(0)))


def coherence(rows: DataFrame, norm: Column) -> DataFrame:
    """Defects of adjacent rows: repeated identity, time running backwards, repeated wording, repeated role."""
    w = Window.partitionBy("session_id").orderBy("position")
    rows = rows.withColumn("_norm", norm)
    same = lambda c: F.lag(c).over(w) == F.col(c)
    found = F.array_compact(F.array(F.when(same("speaker_id") & ~same("role"), "identity"), F.when(F.lag("start_ms").over(w) > F.col("start_ms"), "chronology"), F.when(same("_norm") & (F.col("_norm") != ""), "wording"), F.when(same("role"), "role")))
    return rows.select("session_id", "segment_id", F.array_join(found, ",").alias("defects"))


def surplus_turns(rows: DataFrame, licensed: DataFrame, norm: Column, ref_norm: Column) -> DataFrame:
    """Turns that a session repeats more often than its reference does: session_id, norm, surplus.

    A turn is its role and text; a text that two roles repeat has a row for each.
    """
    shown = rows.groupBy("session_id", "role", norm.alias("norm")).agg(F.count(F.lit(1)).alias("n"))
    allowed = licensed.groupBy("session_id", F.col("ref_role").alias("role"), ref_norm.alias("norm")).agg(F.count(F.lit(1)).alias("m"))
    surplus = F.col("n") - F.greatest(F.coalesce("m", F.lit(0)), F.lit(1))
    return shown.join(allowed, ["session_id", "role", "norm"], "left").select("session_id", "norm", surplus.alias("surplus")).where("surplus > 0")


_ERRORS = "key string, distance int, substitutions int, insertions int, deletions int, matches int"


def edit_counts(reference: list[str], hypothesis: list[str]) -> tuple[int, int, int, int, int]:
    """(distance, substitutions, insertions, deletions, matches); ties prefer fewer deletions, then substitutions.

    Distance and deletions are packed into one number in the order of
    preference; the other counts follow from them and the lengths, so no length
    is too large. A row of the table is a few array steps and two rows are alive
    at once.
    """
    names = {w: i for i, w in enumerate(dict.fromkeys([*reference, *hypothesis]))}
    ref, hyp = (np.array([names[w] for w in x], np.int64) for x in (reference, hypothesis))
    one, deletion = 1 << 31, 1
    steps = np.arange(len(hyp) + 1, dtype=np.int64) * one
    row = steps.copy()
    for w in ref:
        diagonal = row[:-1] + np.where(hyp == w, 0, one)
        best = np.append(row[0], diagonal)
        best = np.minimum(best, np.append(np.iinfo(np.int64).max - one, row[1:]) + one + deletion)
        best[0] = row[0] + one + deletion
        row = np.minimum.accumulate(best - steps) + steps
    last = int(row[-1])
    d, dels = divmod(last, one)
    ins = dels + len(hyp) - len(ref)
    subs = d - dels - ins
    return d, subs, ins, dels, len(ref) - subs - dels


def word_errors(pairs: DataFrame, key: str, reference: str, hypothesis: str) -> DataFrame:
    """Word errors of two word arrays of each row of any length, in Arrow batches; nulls count as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, r, h in zip(batch[key], batch[reference], batch[hypothesis]):
                r, h = list(r if r is not None else []), list(h if h is not None else [])
                out.append((str(k), *edit_counts(r, h)))
            yield pd.DataFrame(out, columns=["key", "distance", "substitutions", "insertions", "deletions", "matches"])

    return pairs.select(F.col(key).cast("string").alias(key), reference, hypothesis).mapInPandas(run, _ERRORS)


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        m = at.get(w, 0)
        x = row & m
        row = (row + x | row - x) & full
    return len(a) - bin(row).count("1")


def lcs_words(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two word arrays, in Arrow batches; null counts as empty."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([lcs_length(list(x if x is not None else []), list(y if y is not None else [])) for x, y in zip(a, b)])

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "int")(a, b)


def variant_pairs(pairs: DataFrame, a: str, b: str, least: float = 0.8) -> DataFrame:
    """Pairs of word arrays that say the same: equal bags, or one and/but apart, or a shared 4-gram with enough order in common."""
    swap = F.transform(F.array_sort(a), lambda w: F.when(w == "but", "and").otherwise(w))
    other = F.transform(F.array_sort(b), lambda w: F.when(w == "but", "and").otherwise(w))
    bags = (F.array_sort(a) == F.array_sort(b)) | (F.array_sort(swap) == F.array_sort(other))
    shared = F.arrays_overlap(shingles(F.col(a), 4), shingles(F.col(b), 4))
    longer = F.greatest(F.size(a), F.size(b))
    ratio = F.round(lcs_words(F.col(a), F.col(b)) / F.when(longer > 0, longer), 6)
    return pairs.withColumn("lcs_ratio", ratio).withColumn("variant", bags | (shared & (F.col("lcs_ratio") >= least)))


def locate(needle: Column, words: Column) -> Column:
    """First place (from 0) of a word array inside another, -1 without one; an empty needle is nowhere."""
    n = F.size(needle)
    at = F.sequence(F.lit(1), F.size(words) - n + 1)
    found = F.transform(at, lambda i: F.slice(words, i, n) == needle)
    return F.when((n > 0) & (F.size(words) >= n), F.array_position(found, True) - 1).otherwise(-1)


def token_times(words: Column, start: Column, end: Column) -> Column:
    """(word, start, end) by even integer shares of the span."""
    at = lambda i, n: start + F.floor((end - start) * i / n)
    # the words are a variable of a lambda, so that they are split once and not for each of them
    timed = lambda ws: F.transform(ws, lambda w, i: F.struct(w.alias("word"), at(i, F.size(ws)).alias("start"), at(i + 1, F.size(ws)).alias("end")))
    return F.transform(F.array(words), timed)[0]


def allocation_check(runs: DataFrame, n_source: DataFrame) -> DataFrame:
    """By session, source words that runs [a, b) use twice or not at all: duplicated, unallocated, complete."""
    used = runs.where("a < b").select("session_id", F.explode(F.sequence(F.col("a"), F.col("b") - 1)).alias("i")).groupBy("session_id", "i").agg(F.count(F.lit(1)).alias("n"))
    by = used.groupBy("session_id").agg(F.count_if(F.col("n") > 1).alias("duplicated"), F.count(F.lit(1)).alias("used"))
    out = n_source.join(by, "session_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = out.select("session_id", zero("duplicated").alias("duplicated"), (F.col("n") - zero("used")).alias("unallocated"))
    return out.withColumn("complete", (F.col("duplicated") == 0) & (F.col("unallocated") == 0))
