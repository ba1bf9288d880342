"""Live transcripts: which rows a window may show, when, and under which speaker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators.folds import fold

# Fixed values of the live rules, in milliseconds where they are times.
CONTEXT, MARGIN, HOLD = 500, 300, 1000
MUTABLE_WORDS, DORMANT_WORDS, DORMANT_AFTER, DRAIN_AFTER, ROW_GAP = 10, 3, 12_000, 25_000, 1500
LOOKBACK = 5000
FLIP_MARGIN, FLIP_REPEATS, CONFIDENCES = 9, 2, 5
MARGINAL, MARGINAL_SHARE, SUSTAINED_FRAMES, SUSTAINED_SHARE, FRAME = 1500, 0.05, 50, 0.015, 80


def reread_step(window: int):
    """Rows by end: each shows up in the first window whose edge is HOLD after it, unless it ends within MARGIN of what is shown."""

    def step(state: dict | None, row: dict) -> tuple[dict, list[dict]]:
        state = state or {"mark": 0, "top": 0, "window": None}
        k = -(-(row["end_ms"] + HOLD) // window)
        mark = max(state["mark"], state["top"]) if k != state["window"] else state["mark"]
        shown = row["end_ms"] > mark + MARGIN
        out = {"session_id": row["session_id"], "segment_id": row["segment_id"], "window": k, "mark_ms": mark, "start_ms": max(row["start_ms"], mark - CONTEXT)}
        return {"mark": mark, "top": max(state["top"], row["end_ms"]) if shown else state["top"], "window": k}, [out] if shown else []

    return step


REREAD = "session_id long, segment_id string, window long, mark_ms long, start_ms long"


def reread_emissions(rows: DataFrame, window: int = 10_000) -> DataFrame:
    """Rows that windows of `window` ms show, the last window without a hold-back."""
    return fold(rows, ["session_id"], ["end_ms", "position"], reread_step(window), REREAD)


def trimmed_buffer(chunks: DataFrame, length: Column, cap: int) -> DataFrame:
    """session_id, kept, dropped, offset_ms: the oldest chunks go while those that are left exceed `cap`."""
    order = Window.partitionBy("session_id").orderBy("position")
    before = F.coalesce(F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = chunks.select("session_id", length.alias("length"), (F.sum(length).over(Window.partitionBy("session_id")) - before).alias("left"))
    gone = F.col("left") > cap
    return each.groupBy("session_id").agg(F.count_if(~gone).alias("kept"), F.count_if(gone).alias("dropped"), F.coalesce(F.sum(F.when(gone, F.col("length"))), F.lit(0)).alias("offset_ms"))


def stable_rows(words: DataFrame) -> DataFrame:
    """Rows of each slot's stable words: the last ten are held, three once the slot is dormant, none later; gaps part rows."""
    slot, session = Window.partitionBy("session_id", "speaker_id"), Window.partitionBy("session_id")
    order = slot.orderBy("w_start", "position", "i")
    silence = F.max("w_end").over(session) - F.max("w_end").over(slot)
    held = F.when(silence > DRAIN_AFTER, 0).when(silence > DORMANT_AFTER, DORMANT_WORDS).otherwise(MUTABLE_WORDS)
    stable = words.withColumn("_at", F.row_number().over(order)).withColumn("_keep", F.count(F.lit(1)).over(slot) - held).where("_at <= _keep")
    apart = F.coalesce((F.col("w_start") - F.lag("w_end").over(order) > ROW_GAP).cast("int"), F.lit(0))
    runs = stable.withColumn("_apart", apart).withColumn("run", F.sum("_apart").over(order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "word"))), lambda x: x["word"]), " ")
    return runs.groupBy("session_id", "speaker_id", "run").agg(F.min("w_start").alias("start_ms"), F.max("w_end").alias("end_ms"), F.count(F.lit(1)).alias("n_words"), text.alias("text"))


def release(rows: DataFrame, stable: Column) -> tuple[DataFrame, DataFrame]:
    """Ordered release: (snapshots, rows), one snapshot as each row arrives.

    The horizon is the clock less LOOKBACK, but no later than the oldest start
    of a row that is not stable; it never goes back. A row is released at the
    first snapshot, its own or later, whose horizon has reached its end; null if
    only the final flush releases it.
    """
    so_far = Window.partitionBy("session_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    clock = F.max("end_ms").over(so_far) - LOOKBACK
    frontier = F.min(F.when(~stable, F.col("start_ms"))).over(so_far)
    snaps = rows.select("session_id", "position", "end_ms", clock.alias("clock_ms"), F.least(clock, frontier).alias("_horizon"))
    snaps = snaps.withColumn("horizon_ms", F.max("_horizon").over(so_far)).drop("_horizon")

    def reached(at: str) -> DataFrame:
        # horizons and ends in one order: the horizons below an end are counted, no pairs are made
        marks = snaps.select("session_id", F.col(at).alias("v"), F.lit(1).alias("is_end"), F.lit(None).cast("long").alias("own"), F.col("position").alias("snap"))
        ends = snaps.select("session_id", F.col("end_ms").alias("v"), F.lit(0).alias("is_end"), F.col("position").alias("own"), F.lit(None).cast("long").alias("snap"))
        later = Window.partitionBy("session_id").orderBy("v", "is_end").rowsBetween(1, Window.unboundedFollowing)
        both = marks.unionByName(ends).withColumn("first", F.min("snap").over(later)).where("own is not null")
        return both.select("session_id", F.col("own").alias("position"), F.when(F.col("first").isNotNull(), F.greatest("first", "own")).alias(f"{at}_at"))

    timed = reached("clock_ms").join(reached("horizon_ms"), ["session_id", "position"])
    return snaps.drop("end_ms"), timed.select("session_id", "position", F.col("clock_ms_at").alias("ready_at"), F.col("horizon_ms_at").alias("released_at"))


def release_labels(snaps: DataFrame, timed: DataFrame) -> DataFrame:
    """Each snapshot's decision: what was ready by the clock, what was released, and what held the rest."""
    count = lambda at: timed.where(F.col(at).isNotNull()).groupBy("session_id", F.col(at).alias("position")).agg(F.count(F.lit(1)).alias(at))
    both = snaps.join(count("ready_at"), ["session_id", "position"], "left").join(count("released_at"), ["session_id", "position"], "left").fillna(0, ["ready_at", "released_at"])
    order = Window.partitionBy("session_id").orderBy("position")
    gone = F.coalesce(F.sum("released_at").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ready = F.sum("ready_at").over(order.rowsBetween(Window.unboundedPreceding, 0)) - gone
    both = both.withColumn("ready", ready).withColumn("released", F.col("released_at"))
    label = F.when((F.col("released") > 0) & (F.col("released") < F.col("ready")), "release_limited_by_stability_frontier").when(F.col("released") > 0, "release_ready_rows").when(F.col("ready") > 0, "hold_stability_frontier").otherwise("hold_clock_lookback")
    return both.select("session_id", "position", "ready", "released", label.alias("label"))


def revisions(before: Column, now: Column, held: int) -> Column:
    """Struct of (revised, late, truncated) between two word arrays of a slot; words but the last `held` were shown."""
    n = F.least(F.size(before), F.size(now))
    shown = F.greatest(F.size(before) - held, F.lit(0))
    pairs = F.zip_with(F.slice(before, 1, F.greatest(n, F.lit(0))), F.slice(now, 1, F.greatest(n, F.lit(0))), lambda a, b: a != b)
    late = F.slice(pairs, 1, F.least(shown, n))
    times = lambda x: F.size(F.filter(x, lambda y: y))
    return F.struct(times(pairs).alias("revised"), times(late).alias("late"), F.greatest(F.size(before) - F.greatest(F.size(now), shown), F.lit(0)).alias("truncated"))


def wall_clock(spans: DataFrame, step: int) -> DataFrame:
    """(session_id, voiced_ms, at_ms): every `step` ms of voiced time, on the wall clock of the span that holds it."""
    before = Window.partitionBy("session_id").orderBy("start_ms", "position").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.where("end_ms > start_ms").withColumn("low", F.coalesce(F.sum(F.expr("end_ms - start_ms")).over(before), F.lit(0)))
    ticks = F.expr(f"sequence((low + {step - 1}) div {step}, (low + end_ms - start_ms + {step - 1}) div {step})")
    each = spans.withColumn("tick", F.explode(ticks)).withColumn("voiced_ms", F.col("tick") * step).where("voiced_ms < low + end_ms - start_ms")
    return each.select("session_id", "voiced_ms", (F.col("start_ms") + F.col("voiced_ms") - F.col("low")).alias("at_ms"))


def coactivity(rows: DataFrame, step: int) -> DataFrame:
    """(session_id, a, b, steps): steps of time in which two speakers were both active."""
    steps = F.expr(f"sequence(start_ms div {step}, (end_ms - 1) div {step})")
    active = rows.where("end_ms > start_ms").select("session_id", "speaker_id", F.explode(steps).alias("step"))
    slots = active.groupBy("session_id", "step").agg(F.array_sort(F.collect_set("speaker_id")).alias("slots")).where(F.size("slots") > 1)
    each = slots.select("session_id", "slots", F.posexplode("slots").alias("at", "a"))
    pairs = each.select("session_id", "a", F.explode(F.slice("slots", F.col("at") + 2, F.size("slots"))).alias("b"))
    return pairs.groupBy("session_id", "a", "b").agg(F.count(F.lit(1)).alias("steps"))


def continuity_step(state: dict | None, vote: dict) -> tuple[dict, list[dict]]:
    """Votes by overlap, largest first: each window speaker and each known speaker is taken once."""
    state = state or {"windows": [], "known": []}
    if vote["window_speaker"] in state["windows"] or vote["known_speaker"] in state["known"]:
        return state, []
    return {"windows": [*state["windows"], vote["window_speaker"]], "known": [*state["known"], vote["known_speaker"]]}, [vote]


def continuity(votes: DataFrame) -> DataFrame:
    """Greedy one-to-one map of window speakers to known ones from (session_id, window_speaker, known_speaker, overlap_ms).

    Ties go to the larger ids, as in a reversed sort. A session has a few votes,
    one for each pair of speakers.
    """
    ranked = votes.where("overlap_ms > 0").withColumn("rank", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("overlap_ms"), F.desc("window_speaker"), F.desc("known_speaker"))))
    return fold(ranked, ["session_id"], ["rank"], continuity_step, "session_id long, window_speaker string, known_speaker string, overlap_ms long")


def completed_swap(mapping: Column, window: Column, known: Column) -> Column:
    """A map with one of two speakers gets the other, where both sides are the same two speakers."""
    fits = (F.size(window) == 2) & (F.size(known) == 2) & (F.size(F.array_except(window, known)) == 0) & (F.size(mapping) == 1)
    rest = lambda ids, taken: F.array_except(ids, taken)
    other = F.map_from_arrays(rest(window, F.map_keys(mapping)), rest(known, F.map_values(mapping)))
    return F.when(fits, F.map_concat(mapping, other)).otherwise(mapping)


def capped_speakers(rows: DataFrame, cap: int = 2) -> DataFrame:
    """(session_id, segment_id, speaker_id, canonical): rows of speakers beyond the `cap` who speak longest go to the nearest one in time.

    The gap to the canonical row that ended last before, or starts next, decides;
    equal gaps go to the one before.
    """
    spoken = rows.groupBy("session_id", "speaker_id").agg(F.sum(F.expr("end_ms - start_ms")).alias("ms"))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("ms"), "speaker_id"))
    top = spoken.withColumn("rank", rank).select("session_id", "speaker_id", (F.col("rank") <= cap).alias("top"))
    both = rows.join(top, ["session_id", "speaker_id"])
    order = Window.partitionBy("session_id").orderBy("start_ms", "position")
    before = F.max(F.when(F.col("top"), F.struct("end_ms", "position", "speaker_id"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("top"), F.struct("start_ms", "position", "speaker_id"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    both = both.withColumn("_before", before).withColumn("_after", after)
    near = F.greatest(F.col("start_ms") - F.col("_before.end_ms"), F.lit(0)) <= F.greatest(F.col("_after.start_ms") - F.col("end_ms"), F.lit(0))
    found = F.when(F.col("top"), F.col("speaker_id")).when(F.col("_before").isNotNull() & (F.col("_after").isNull() | near), F.col("_before.speaker_id")).otherwise(F.col("_after.speaker_id"))
    return both.select("session_id", "segment_id", "speaker_id", found.alias("canonical"))


def folded_slots(rows: DataFrame) -> DataFrame:
    """(session_id, speaker_id, ms, share, visible): marginal slots are shown under the one that speaks longest, unless sustained."""
    slots = rows.groupBy("session_id", "speaker_id").agg(F.sum(F.expr("end_ms - start_ms")).alias("ms"))
    session = Window.partitionBy("session_id")
    total = F.sum("ms").over(session)
    slots = slots.withColumn("total", total).withColumn("main", F.max(F.struct("ms", "speaker_id")).over(session)["speaker_id"])
    marginal = F.col("ms") < F.greatest(F.lit(float(MARGINAL)), MARGINAL_SHARE * F.col("total"))
    sustained = (F.expr(f"ms div {FRAME}") >= SUSTAINED_FRAMES) & (F.col("ms") >= SUSTAINED_SHARE * F.col("total"))
    visible = F.when(marginal & ~sustained, F.col("main")).otherwise(F.col("speaker_id"))
    return slots.select("session_id", "speaker_id", "ms", F.round(F.col("ms") / F.when(F.col("total") > 0, F.col("total")), 4).alias("share"), visible.alias("visible"))


def slot_shares(rows: DataFrame, window: Column) -> DataFrame:
    """Each window's speech by slot: its own, all so far, and the slot's share of all so far."""
    each = rows.groupBy("session_id", window.alias("window"), "speaker_id").agg(F.sum(F.expr("end_ms - start_ms")).alias("delta_ms"))
    slot = Window.partitionBy("session_id", "speaker_id").orderBy("window")
    every = Window.partitionBy("session_id").orderBy("window").rangeBetween(Window.unboundedPreceding, 0)
    both = each.withColumn("total_ms", F.sum("delta_ms").over(slot)).withColumn("_all", F.sum("delta_ms").over(every))
    return both.select("session_id", "window", "speaker_id", "delta_ms", "total_ms", F.round(F.col("total_ms") / F.when(F.col("_all") > 0, F.col("_all")), 4).alias("share"))


def evictions(sessions: DataFrame, now: Column, ttl: int, most: int) -> DataFrame:
    """session_id and why: expired (idle beyond `ttl` seconds), evicted (not among the `most` used last) or kept."""
    idle = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_seen").cast("timestamp"))
    live = sessions.withColumn("expired", idle > ttl * 1_000_000)
    last = live.where("not expired").orderBy(F.desc("last_seen"), "session_id").limit(most).select("session_id", F.lit(True).alias("recent"))
    why = F.when(F.col("expired"), "expired").when(F.col("recent"), "kept").otherwise("evicted")
    return live.join(last, "session_id", "left").select("session_id", why.alias("state"))


def debounce_step(state: dict | None, row: dict) -> tuple[dict, list[dict]]:
    """A swap of the labels counts once it is proposed twice in a row, or is surer than the last five by FLIP_MARGIN points."""
    if state is None:
        return {"map": row["proposed"], "last": [row["confidence"]], "pending": None, "times": 0}, [{**row, "shown": row["proposed"], "suppressed": False}]
    times = state["times"] + 1 if state["pending"] == row["proposed"] else 1
    sure = len(state["last"]) * row["confidence"] - sum(state["last"]) >= FLIP_MARGIN * len(state["last"])
    if row["proposed"] != state["map"] and times < FLIP_REPEATS and not sure:
        return {**state, "pending": row["proposed"], "times": times}, [{**row, "shown": state["map"], "suppressed": True}]
    return {"map": row["proposed"], "last": [*state["last"], row["confidence"]][-CONFIDENCES:], "pending": None, "times": 0}, [{**row, "shown": row["proposed"], "suppressed": False}]


DEBOUNCED = "session_id long, position long, proposed string, confidence long, shown string, suppressed boolean"


def debounced(proposals: DataFrame) -> DataFrame:
    """What is shown after each proposal (session_id, position, proposed, confidence in points)."""
    return fold(proposals, ["session_id"], ["position"], debounce_step, DEBOUNCED)


def running_confidence(value: Column, by: str, order: str, n: int = CONFIDENCES) -> Column:
    return F.round(F.avg(value).over(Window.partitionBy(by).orderBy(order).rowsBetween(1 - n, 0)), 6)


def late_tail(snapshot: DataFrame, final: DataFrame, counters: list[str]) -> DataFrame:
    """What counters gained after the snapshot; sessions that gained nothing have no row."""
    both = final.join(snapshot.select("session_id", *(F.col(c).alias(f"_{c}") for c in counters)), "session_id")
    gained = [(F.col(c) - F.col(f"_{c}")).alias(c) for c in counters]
    return both.select("session_id", *gained).where(" or ".join(f"{c} > 0" for c in counters))


def stability(remaps: Column, updates: Column, merges: Column, pending: Column) -> Column:
    """unstable: remaps beyond a fifth of the updates, a merge, or a contrary map that waits."""
    return F.when((remaps > 0.2 * updates) | (merges > 0) | pending, "unstable").otherwise("stable")


def watermark(rows: DataFrame) -> DataFrame:
    """One frozen identity for each session: rows, last end, and a digest of its rows' digests in order."""
    digest = F.sha2(F.concat_ws("|", "role", "text"), 256)
    each = rows.select("session_id", "position", "end_ms", digest.alias("digest"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "digest"))), lambda x: x["digest"]), "")
    return each.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_rows"), F.max("end_ms").alias("last_ms"), F.sha2(line, 256).alias("identity"))


def chunk_plan(duration: Column, whole: int, slice_: int, least: int) -> Column:
    """Array of (start, end): one chunk up to `whole`, else slices; a last one under `least` joins the one before."""
    n = F.ceil(duration / slice_).cast("long")
    n = F.when((n > 1) & (duration - (n - 1) * slice_ < least), n - 1).otherwise(n)
    n = F.when(duration <= whole, F.lit(1).cast("long")).otherwise(n)
    start = lambda i: i * slice_
    return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.struct(start(i).alias("start"), F.when(i == n - 1, duration).otherwise(start(i + 1)).alias("end")))


def recombined(words: DataFrame, chunks: DataFrame) -> DataFrame:
    """Words of chunks (session_id, chunk, i, word, rel_ms) on the visit's clock, with their index in the visit and a flag at seams."""
    each = words.join(chunks.select("session_id", "chunk", "offset_ms"), ["session_id", "chunk"])
    order = Window.partitionBy("session_id").orderBy("chunk", "i")
    return each.select("session_id", "chunk", "i", "word", (F.col("rel_ms") + F.col("offset_ms")).alias("at_ms"), (F.row_number().over(order) - 1).alias("visit_index"), ((F.col("i") == 0) & (F.col("chunk") > 0)).alias("seam"))
