"""Role attribution: how well labelled rows and words agree with reference intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import rate
from parlance.operators import intervals, notes

#: The roles that can be right; any other label is uncertain.
ROLES = ("DOCTOR", "PATIENT")
_row = ["session_id", "segment_id"]


def accuracy(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """Share of correctly labelled rows by session, over all rows and over those clear of cross-talk."""
    clean = intervals.touching(rows, intervals.cross_talk(refs), keep=False).select(*_row, F.lit(True).alias("clean"))
    judged = intervals.expected_roles(rows, refs).join(clean, _row, "left").withColumn("clean", F.coalesce("clean", F.lit(False)))
    known, right, clear = F.col("expected_role").isNotNull(), F.col("role") == F.col("expected_role"), F.col("clean")
    return judged.groupBy("session_id").agg(
        F.count_if(known).alias("scored"),
        F.count_if(right).alias("correct"),
        rate(F.count_if(right), F.count_if(known)).alias("accuracy"),
        F.count_if(known & clear).alias("clean_scored"),
        rate(F.count_if(right & clear), F.count_if(known & clear)).alias("clean_accuracy"),
    )


def strict(judged: DataFrame) -> DataFrame:
    """Attribution counts by session, an uncertain label counting against the row."""
    known, sure = F.col("expected_role").isNotNull(), F.col("role").isin(*ROLES)
    right = F.col("role") == F.col("expected_role")
    return judged.groupBy("session_id").agg(
        F.count_if(known).alias("scored"),
        F.count_if(right).alias("correct"),
        F.count_if(known & sure & ~right).alias("wrong"),
        F.count_if(known & ~sure).alias("uncertain"),
        F.count_if(~known).alias("unscored"),
        rate(F.count_if(right), F.count_if(known)).alias("strict_accuracy"),
        rate(F.count_if(right), F.count_if(known & sure)).alias("confident_accuracy"),
        rate(F.count_if(known & ~sure), F.count_if(known)).alias("uncertain_rate"),
    )


def purity(judged: DataFrame) -> DataFrame:
    """Each speaker's largest share of one reference role."""
    counts = judged.where("expected_role is not null").groupBy("session_id", "speaker_id", "expected_role").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("session_id", "speaker_id").agg(F.sum("n").alias("rows_scored"), F.max("n").alias("rows_best"), F.round(F.max("n") / F.sum("n"), 6).alias("purity"))


def dyadic_mapping(judged: DataFrame) -> DataFrame:
    """For sessions of exactly two speakers, the better of the two role assignments; ties make the first speaker the doctor."""
    doctor, patient = F.count_if(F.col("expected_role") == "DOCTOR"), F.count_if(F.col("expected_role") == "PATIENT")
    by = judged.groupBy("session_id", "speaker_id").agg(doctor.alias("d"), patient.alias("p"))
    two = by.groupBy("session_id").agg(F.count(F.lit(1)).alias("speakers"), F.min_by(F.struct("d", "p"), "speaker_id").alias("a"), F.max_by(F.struct("d", "p"), "speaker_id").alias("b"), F.sum(F.col("d") + F.col("p")).alias("scored")).where("speakers = 2")
    straight, crossed = F.col("a.d") + F.col("b.p"), F.col("a.p") + F.col("b.d")
    return two.select("session_id", "scored", F.greatest(straight, crossed).alias("best_correct"), F.when(straight >= crossed, "DOCTOR").otherwise("PATIENT").alias("first_speaker_role"))


def emission_windows(refs: DataFrame) -> DataFrame:
    """Disjoint windows between the ends of successive intervals: session_id, window_index, from_ms, until_ms."""
    w = Window.partitionBy("session_id").orderBy("ordinal")
    return refs.select("session_id", F.col("ordinal").alias("window_index"), F.lag("ref_end", 1, 0).over(w).alias("from_ms"), F.col("ref_end").alias("until_ms"))


def emission_window(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Each row's window with from_ms < end_ms <= until_ms; the first if they overlap, null without one."""
    pair = intervals.near_join(rows.select(*_row, "end_ms"), windows, ["session_id"], "end_ms", "from_ms", "until_ms", 0).where("from_ms < end_ms and end_ms <= until_ms")
    return rows.select(*_row).join(pair.groupBy(*_row).agg(F.min("window_index").alias("window_index")), _row, "left")


def lane_diff(live: DataFrame, corrected: DataFrame) -> DataFrame:
    """Rows of two lanes by segment_id: added, removed, changed or same role."""
    a, b = live.select("segment_id", F.col("role").alias("live_role"), F.lit(1).alias("_a")), corrected.select("segment_id", F.col("role").alias("corrected_role"), F.lit(1).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("live_role") == F.col("corrected_role"), "same").otherwise("changed")
    return a.join(b, "segment_id", "full").select("segment_id", "live_role", "corrected_role", change.alias("change"))


def same_speaker_context(rows: DataFrame) -> DataFrame:
    """Texts right before and after a row, where the same speaker says them."""
    w = Window.partitionBy("session_id").orderBy("start_ms", "end_ms", "position")
    near = lambda f: F.when(f("speaker_id").over(w) == F.col("speaker_id"), f("text").over(w))
    return rows.select(*_row, near(F.lag).alias("previous_text"), near(F.lead).alias("next_text"))


def in_region(points: DataFrame, spans: DataFrame) -> DataFrame:
    """`points` with hit: whether a span (start inclusive, end exclusive) holds the word."""
    key = [*_row, "word_index"]
    inside = intervals.near_join(points.select(*key, "at_ms"), spans.select("session_id", "start_ms", "end_ms"), ["session_id"], "at_ms", "start_ms", "end_ms", 0).where("at_ms < end_ms").select(*key).distinct()
    return points.join(inside.withColumn("hit", F.lit(True)), key, "left").withColumn("hit", F.col("hit").isNotNull())


def words_by_region(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Words inside and outside spans (start inclusive, end exclusive) by session."""
    marked, hit = in_region(points.select(*_row, "word_index", "at_ms"), spans), F.col("hit")
    return marked.groupBy("session_id").agg(F.count_if(~hit).alias("clean_words"), F.count_if(hit).alias("overlap_words"))


def regional_words(points: DataFrame, spans: DataFrame, name: str) -> DataFrame:
    """(session_id, region, words in order of time): a session's words in clean and in overlapped speech."""
    region = F.when(F.col("hit"), "overlap").otherwise("clean")
    ordered = F.array_sort(F.collect_list(F.struct("at_ms", "segment_id", "word_index", "word")))
    return in_region(points, spans).groupBy("session_id", region.alias("region")).agg(F.transform(ordered, lambda x: x["word"]).alias(name))


def boundary_buckets(points: DataFrame, refs: DataFrame, tolerances: tuple[int, ...] = (150, 250, 400)) -> DataFrame:
    """Words near and away from interval edges at each tolerance: words, scored, correct."""
    key, far = [*_row, "word_index"], max(tolerances)
    edges = refs.select("session_id", F.explode(F.array("ref_start", "ref_end")).alias("edge")).distinct().withColumn("edge2", F.col("edge"))
    near = intervals.near_join(points.select(*key, "at_ms"), edges, ["session_id"], "at_ms", "edge", "edge2", far).groupBy(*key).agg(F.min("gap_ms").alias("dist"))
    each = points.join(near, key, "left").withColumn("tolerance_ms", F.explode(F.array(*map(F.lit, tolerances))))
    close = F.coalesce(F.col("dist") <= F.col("tolerance_ms"), F.lit(False))
    return each.groupBy("tolerance_ms", close.alias("near_boundary")).agg(F.count(F.lit(1)).alias("words"), F.count("active_role").alias("scored"), F.count_if(F.col("role") == F.col("active_role")).alias("correct"))


def confusion(judged: DataFrame) -> DataFrame:
    """Speaker by reference role, with the rows an unconstrained mapping would get right."""
    doctor, patient = (F.count_if(F.col("expected_role") == r) for r in ROLES)
    return judged.groupBy("session_id", "speaker_id").agg(doctor.alias("doctor_rows"), patient.alias("patient_rows"), F.greatest(doctor, patient).alias("oracle_rows"))


def majority_role(rows: DataFrame) -> DataFrame:
    """Each speaker's most frequent role; ties go to the role seen first."""
    votes = rows.groupBy("session_id", "speaker_id", "role").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("first_at"))
    return votes.groupBy("session_id", "speaker_id").agg(F.max_by("role", F.struct("n", -F.col("first_at"))).alias("majority_role"), F.max("n").alias("votes"))


def suppressed_speakers(rows: DataFrame, *, share: float = 0.05, most_ms: int = 1000, rows_below: int = 2) -> DataFrame:
    """Speakers with too little speech by share, by time and by rows at once."""
    by = rows.groupBy("session_id", "speaker_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech_ms"), F.count(F.lit(1)).alias("n_rows"))
    total = F.sum("speech_ms").over(Window.partitionBy("session_id"))
    return by.withColumn("_total", total).where((F.col("speech_ms") < F.col("_total") * share) & (F.col("speech_ms") <= most_ms) & (F.col("n_rows") < rows_below)).drop("_total")


def orphan_speakers(mapped: DataFrame) -> DataFrame:
    """Speakers who share their mapped role with one that has more rows."""
    by = mapped.groupBy("session_id", "speaker_id", "mapped_role").agg(F.count(F.lit(1)).alias("n_rows"))
    return by.withColumn("_top", F.max("n_rows").over(Window.partitionBy("session_id", "mapped_role"))).where("n_rows < _top").drop("_top")


def scored_folds(windows: DataFrame, rows: DataFrame, refs: DataFrame) -> DataFrame:
    """Folded spans with what they should and do show: session_id, origin, visible, start_ms, end_ms, window, n_words, expected_role, visible_roles, class, state.

    `windows` has session_id, window and spans, an array of (origin, visible,
    start_ms, end_ms, n_words); of spans that windows repeat, the last window's
    counts. The expected role is the reference's with the most overlap; visible
    roles are those, DOCTOR or PATIENT, of the visible speaker's rows that overlap
    the span. Spans without length overlap nothing; null and empty arrays have none.
    """
    key = ["session_id", "origin", "visible", "start_ms", "end_ms"]
    spans = windows.select("session_id", "window", F.explode("spans").alias("s")).select("session_id", "window", "s.*")
    last = spans.groupBy(*key).agg(F.max_by(F.struct("window", "n_words"), F.struct("window", "n_words")).alias("w")).select(*key, "w.*")
    last = last.withColumn("segment_id", F.concat_ws("|", *key))
    judged = intervals.expected_roles(last, refs)
    shown = rows.where(F.col("role").isin(*ROLES)).select("session_id", F.col("speaker_id").alias("visible"), "role", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    met = intervals.overlap_join(last, shown, ["session_id", "visible"], "start_ms", "end_ms", "r_start", "r_end")
    roles = met.groupBy("session_id", "segment_id").agg(F.array_sort(F.collect_set("role")).alias("visible_roles"))
    both = judged.join(roles, ["session_id", "segment_id"], "left").withColumn("visible_roles", F.coalesce("visible_roles", F.array().cast("array<string>")))
    kind = notes.fold_class(F.col("expected_role"), F.col("visible_roles")), notes.attribution_state(F.col("expected_role"), F.col("visible_roles"))
    return both.select(*key, "window", "n_words", "expected_role", "visible_roles", kind[0].alias("class"), kind[1].alias("state"))


def fold_changes(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """(session_id, change, n, newly_wrong): how spans that both runs have (see scored_folds) changed state, and how many became confidently wrong."""
    key = ["session_id", "origin", "visible", "start_ms", "end_ms"]
    both = baseline.select(*key, F.col("state").alias("was")).join(candidate.select(*key, F.col("state").alias("now")), key)
    change = notes.state_change(F.col("was"), F.col("now"))
    return both.groupBy("session_id", change.alias("change")).agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("now") == "wrong") & (F.col("was") != "wrong")).alias("newly_wrong"))
