"""Validators: a table of rules, evaluated once for each record, whose failures are findings with an identity of their own."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import norm_contract


@dataclass(frozen=True)
class Rule:
    """A closed code, where it fails (null: it holds), and what it asks for."""

    code: str
    fails: Column
    asks: str


# Fixed values of the review contract.
STATUSES = ("active", "disabled", "rejected")
CATEGORIES = ("asr_variant", "abbreviation_acronym", "semantic_synonym", "ambiguous_product")
EVIDENCE = ("observed_development_asr_error", "approved_synthetic_asr_fixture")
LOCALE, CONSUMER = "en-AU", "live_post_asr_normalizer"
#: Personal data that no record may carry: mail addresses, long numbers, and dates.
PRIVATE = r"[\w.+-]+@[\w-]+\.[a-z]{2,}|(?:\d[ -]?){8,}|\b\d{1,2}/\d{1,2}/\d{4}\b"


def findings(records: DataFrame, rules: list[Rule], key: str = "record_id") -> DataFrame:
    """(key, code, asks, finding_id) of each rule that a record fails; the id is that of code and key, so runs can be compared.

    Records that repeat have their findings once. A record without key has
    findings too, with the key null.
    """
    each = F.array_compact(F.array(*(F.when(r.fails, F.struct(F.lit(r.code).alias("code"), F.lit(r.asks).alias("asks"))) for r in rules)))
    found = records.select(key, F.explode(each).alias("f")).select(key, "f.code", "f.asks").distinct()
    identity = F.sha2(F.concat_ws("|", "code", F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    return found.withColumn("finding_id", F.left(identity, F.lit(16)))


def pair_rules() -> list[Rule]:
    """Rules for reviewed pairs: status, category, review, canonical, variant, raw_text, visible_text, evidence, locale, consumer, hard_negatives, rationale."""
    c = F.col
    text = lambda name: F.coalesce(c(name), F.lit(""))
    active, other = c("status").eqNullSafe(F.lit("active")), lambda name, known: ~F.coalesce(c(name).isin(*known), F.lit(False))
    guards = F.coalesce("hard_negatives", F.array().cast("array<string>"))
    line = lambda v: F.concat(F.lit(" "), norm_contract(F.regexp_replace(F.coalesce(v, F.lit("")), "[^A-Za-z0-9']+", " ")), F.lit(" "))
    collides = F.exists(guards, lambda g: F.contains(line(g), line(c("variant")))) & (F.trim(line(c("variant"))) != "")
    held = F.array_join(F.array(*(text(x) for x in ("canonical", "variant", "raw_text", "visible_text", "rationale")), F.array_join(guards, "\n")), "\n")
    return [
        Rule("review.invalid_status", other("status", STATUSES), "status must be active, disabled or rejected"),
        Rule("review.invalid_category", other("category", CATEGORIES), "category is not one of the contract"),
        Rule("review.unapproved_active_pair", active & ~c("review").eqNullSafe(F.lit("approved")), "an active pair needs an approved review"),
        Rule("review.active_semantic_synonym", active & c("category").eqNullSafe(F.lit("semantic_synonym")), "synonyms are not rewritten"),
        Rule("review.active_ambiguous_product", active & c("category").eqNullSafe(F.lit("ambiguous_product")), "ambiguous products are not rewritten"),
        Rule("review.active_text_mismatch", active & ~(c("raw_text").eqNullSafe(text("variant")) & c("visible_text").eqNullSafe(text("canonical"))), "an active pair shows its variant and canonical"),
        Rule("review.generic_active_provenance", active & other("evidence", EVIDENCE), "an active pair needs observed or approved evidence"),
        Rule("review.invalid_consumer", ~(c("locale").eqNullSafe(F.lit(LOCALE)) & c("consumer").eqNullSafe(F.lit(CONSUMER))), "locale and consumer are fixed"),
        Rule("review.missing_hard_negative", F.size(guards) == 0, "a pair needs a hard negative"),
        Rule("review.hard_negative_collision", active & collides, "a hard negative holds the whole variant"),
        Rule("review.missing_safety_rationale", F.trim(text("rationale")) == "", "the rationale must not be empty"),
        Rule("privacy.private_value", held.rlike(PRIVATE), "no mail address, long number or date"),
    ]


def duplicate_pairs(pairs: DataFrame, key: str = "record_id") -> DataFrame:
    """(key, code, asks, finding_id) of pairs whose canonical and variant, as the contract compares them, are those of another record."""
    same = pairs.groupBy(norm_contract(F.coalesce("canonical", F.lit(""))).alias("a"), norm_contract(F.coalesce("variant", F.lit(""))).alias("b")).agg(F.count_distinct(key).alias("n")).where("n > 1")
    named = pairs.select(key, norm_contract(F.coalesce("canonical", F.lit(""))).alias("a"), norm_contract(F.coalesce("variant", F.lit(""))).alias("b")).join(same, ["a", "b"])
    return findings(named, [Rule("review.duplicate_pair", F.lit(True), "a pair is reviewed once")], key)


def leaked_context(probes: DataFrame) -> DataFrame:
    """(probe_id, entry_id) of probes with the context off that got entries or snippets all the same; `<prompt>` where no entry is named."""
    entries, snippets = (F.coalesce(x, F.array().cast("array<string>")) for x in ("entry_ids", "snippets"))
    leaks = probes.where(F.col("context_enabled").eqNullSafe(F.lit(False)) & ((F.size(entries) > 0) | (F.size(snippets) > 0)))
    return leaks.select("probe_id", F.coalesce(F.try_element_at(entries, F.lit(1)), F.lit("<prompt>")).alias("entry_id"))
