"""Text rules and audits: lexicon rewrites, cues, and set differences between two lists of entries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import cue_words


def _quoted(word: str) -> str:
    """The word as a literal of Spark's regular expressions."""
    return re.sub(r"([^0-9A-Za-z_\u0080-\U0010ffff])", r"\\\1", word)


def _pattern(variant: str) -> str:
    """Whole words of the variant, apart by any white space; an end that is no word character has no boundary."""
    words = variant.split()
    first, last = r"\b" if re.match(r"\w", words[0]) else "", r"\b" if re.search(r"\w$", words[-1]) else ""
    return first + r"\s+".join(map(_quoted, words)) + last


def lexicon_rewrite(text: Column, lexicon: list[tuple[str, list[str]]]) -> tuple[Column, Column]:
    """The text with variants as their canonical forms, and how many were found.

    Canonicals in their order, the longest variant first, whole words in any
    case; a match that begins with a capital keeps it.
    """
    found = F.lit(0)
    for canonical, variants in lexicon:
        for variant in sorted(variants, key=lambda v: (-len(v), v)):
            p = _pattern(variant)
            found = found + F.regexp_count(text, F.lit(f"(?i){p}"))
            capital = f"(?i)(?-i:(?=[A-Z])){p}"
            given = re.sub(r"([$\\])", r"\\\1", canonical)  # no group references
            text = F.regexp_replace(text, capital, given[:1].upper() + given[1:])
            text = F.regexp_replace(text, f"(?i)(?-i:(?![A-Z])){p}", given)
    return text, found


def cue_count(text: Column, cues: list[str]) -> Column:
    """How many of the cues occur in the lower-cased text; null counts none."""
    low = F.coalesce(F.lower(text), F.lit(""))
    return F.size(F.filter(F.array(*map(F.lit, cues)), lambda c: F.contains(low, c)))


def row_exception(own: Column, other: Column, n_words: Column) -> Column:
    """keep, uncertain or flip: five words and two cues of the other role flip, cues of both are uncertain."""
    return F.when((other > 0) & (own > 0), "uncertain").when((n_words >= 5) & (other >= 2), "flip").otherwise("keep")


def cue_phrase(text: Column) -> Column:
    """Cue words of the text in one line with blanks around, so that cues are found as whole words."""
    return F.concat(F.lit(" "), F.array_join(cue_words(F.coalesce(text, F.lit(""))), " "), F.lit(" "))


def phrase_role(phrase: Column, doctor: list[str], patient: list[str]) -> Column:
    """DOCTOR or PATIENT by the cue that comes first in a cue phrase (DOCTOR on a tie); null without a cue."""
    at = lambda text, cues: F.array_min(F.filter(F.array(*(F.instr(text, f" {c} ") for c in cues)), lambda x: x > 0))
    # variables of lambdas, so that the phrase and the places are worked out once for each row
    places = F.transform(F.array(phrase), lambda t: F.struct(at(t, doctor).alias("d"), at(t, patient).alias("p")))
    role = lambda d, p: F.when(d.isNull() & p.isNull(), F.lit(None)).when(p.isNull() | (d <= p), "DOCTOR").otherwise("PATIENT")
    return F.transform(places, lambda x: role(x["d"], x["p"]))[0]


def orphan_role(rows: DataFrame, doctor: list[str], patient: list[str]) -> DataFrame:
    """Rows of orphan speakers (column `orphan`) with the role that their words show; others, and rows without a cue, keep theirs.

    A row is judged by its own text, then joined to the row before, then to the
    row after, if that is the same speaker's; the first phrase with a cue decides.
    """
    w = Window.partitionBy("session_id").orderBy("position")
    beside = lambda f: F.when(f("speaker_id").over(w) == F.col("speaker_id"), f("text").over(w))
    rows = rows.withColumns({"_before": beside(F.lag), "_after": beside(F.lead)})
    joined = [F.col("text"), F.concat("_before", F.lit(" "), "text"), F.concat("text", F.lit(" "), "_after")]
    found = F.coalesce(*(phrase_role(cue_phrase(t), doctor, patient) for t in joined), F.col("role"))
    return rows.withColumn("role", F.when(F.col("orphan"), found).otherwise(F.col("role"))).drop("_before", "_after")


def without_markers(text: Column) -> Column:
    """Inline reference markers such as [3] or [1, 2] taken out with the blanks before them."""
    return F.regexp_replace(text, r"\s*\[\d+(?:\s*,\s*\d+)*\]", "")


def parity(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, finding) where two lists differ: missing (right only), extra (left only), duplicate (twice in left)."""
    a = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("a"))
    b = right.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("b"))
    found = F.array_compact(F.array(F.when(F.col("a").isNull(), "missing"), F.when(F.col("b").isNull(), "extra"), F.when(F.col("a") > 1, "duplicate")))
    return a.join(b, key, "full").select(key, F.explode(found).alias("finding"))


def closed_schema(json: Column, fields: list[str]) -> Column:
    """Struct of the sorted fields that a JSON object lacks, and of those it has beside them."""
    keys = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    want = F.array(*map(F.lit, fields))
    line = lambda x: F.array_join(F.array_sort(x), ",")
    return F.struct(line(F.array_except(want, keys)).alias("missing"), line(F.array_except(keys, want)).alias("unknown"))


def out_of_order(rows: DataFrame, by: str, keys: list[str], order: str) -> DataFrame:
    """Rows whose keys come before those of the row in front of them."""
    w = Window.partitionBy(by).orderBy(order)
    now = F.struct(*keys)
    return rows.withColumn("_before", F.lag(now).over(w)).where(F.col("_before") > now).drop("_before")


def one_finding_each(findings: DataFrame, identity: list[str], order: str) -> DataFrame:
    """The first row of each identity."""
    rest = [c for c in findings.columns if c not in identity]
    first = findings.groupBy(*identity).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return first.select(*identity, "_row.*")
