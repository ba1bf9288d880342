"""Corrected words back to the rows of a live transcript: anchors that follow each other, and the words between them.

The cursor of a session moves with each anchor that is accepted, so its rows are
taken one after the other, beside the session's words. What becomes of the words
between anchors depends on two rows and is decided by columns.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import cue_words
from parlance.operators.cues import CONSULTATION, Cues
from parlance.operators.rules import cue_phrase, phrase_role

# Fixed values of the anchor rule: words back and ahead, spans shorter and longer than the row, and scores.
BACK, LEAST_AHEAD, AHEAD, MORE, SHORTER, LONGER, FLOOR, SHORT_FLOOR, SHORT, LEAST_ANCHORS, ROWS_AN_ANCHOR, TAIL = 2, 12, 3, 8, 3, 6, 0.48, 0.86, 2, 2, 3, 2
#: What a window's place in the queue stands for: a bound on all windows of its start, a bound on itself, its score.
_ANY_ORDER, _IN_ORDER, _SCORED = range(3)


def _common_in_order(words: list[str], stream: list[str], high: int, start: int, short: int, long: int) -> dict[int, int]:
    """Length of the longest common subsequence of the words and each window from `start`, by the window's end.

    Bits are words; a line of the table is a few steps on whole numbers.
    """
    at: dict[str, int] = {}
    for i, w in enumerate(words):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(words)) - 1
    row, out = full, {}
    for end in range(start + 1, min(high, start + long) + 1):
        if m := at.get(stream[end - 1]):
            x = row & m
            row = (row + x | row - x) & full
        if end >= min(start + short, high):
            out[end] = len(words) - row.bit_count()
    return out


def _common_in_any_order(words: list[str], near: list[str]) -> np.ndarray:
    """For each place of `near`, the last start of a window in which the place's word is more than the words have of it; -1 if none."""
    left, out = Counter(words), np.empty(len(near), np.int64)
    places: dict[str, list[int]] = {}
    for p, w in enumerate(near):
        if n := left.get(w):
            before = places.setdefault(w, [])
            out[p] = before[-n] if len(before) >= n else -1
            before.append(p)
        else:
            out[p] = p
    return out


class _Matcher:
    """Matched words of difflib's rule between the words and windows of a stream; what windows share is worked out once."""

    def __init__(self, words: list[str], near: list[str]):
        self.words, self.near = words, near
        self.at: dict[str, list[int]] = {w: [] for w in words}
        for j, w in enumerate(near):
            if w in self.at:
                self.at[w].append(j)
        self.done: dict[frozenset, dict[tuple, tuple]] = {}

    def matches(self, start: int, end: int) -> int:
        common: frozenset = frozenset()
        if end - start >= 200:  # difflib leaves out words that make up more than a hundredth of a long window
            most = (end - start) // 100 + 1
            common = frozenset(w for w, at in self.at.items() if bisect_left(at, end) - bisect_left(at, start) > most)
        places = [() if w in common else self.at[w] for w in self.words]
        done, total, todo = self.done.setdefault(common, {}), 0, [(0, len(self.words), start, end)]
        while todo:
            alo, ahi, blo, bhi = part = todo.pop()
            if alo < ahi and blo < bhi:
                if part not in done:
                    done[part] = self._longest(places, *part)
                i, j, size = done[part]
                if size:
                    total += size
                    todo += [(alo, i, blo, j), (i + size, ahi, j + size, bhi)]
        return total

    def _longest(self, places: list, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        best_i, best_j, size, runs = alo, blo, 0, {}
        for i in range(alo, ahi):
            now, at = {}, places[i]
            for j in at[bisect_left(at, blo) :] if len(at) > 8 else at:
                if j < blo:
                    continue
                if j >= bhi:
                    break
                k = now[j] = runs.get(j - 1, 0) + 1
                if k > size:
                    best_i, best_j, size = i - k + 1, j - k + 1, k
            runs = now
        a, b = self.words, self.near
        while best_i > alo and best_j > blo and a[best_i - 1] == b[best_j - 1]:
            best_i, best_j, size = best_i - 1, best_j - 1, size + 1
        while best_i + size < ahi and best_j + size < bhi and a[best_i + size] == b[best_j + size]:
            size += 1
        return best_i, best_j, size


def best_window(words: list[str], stream: list[str], cursor: int) -> tuple[int, int, float] | None:
    """(start, end, score) of the stream's window near the cursor that is most like the words; None below the floor.

    The score is that of difflib on lists of words; ties go to the first start,
    then to the shorter window. Windows are bounded by the words that they have in
    common, first in any order, then in order, and the highest is looked at next:
    it is bounded more closely, or scored if that is done.
    """
    n = len(words)
    low, high = max(0, cursor - BACK), min(len(stream), cursor + max(LEAST_AHEAD, AHEAD * n + MORE))
    if not n or low >= high:
        return None
    near = stream[low:high]
    size = len(near)
    short = max(1, n - SHORTER)
    long = min(max(short, n + LONGER), size)
    floor = SHORT_FLOOR if n <= SHORT else FLOOR
    over = np.concatenate([_common_in_any_order(words, near), np.full(long, size)])
    fits = np.cumsum(sliding_window_view(over, long)[:size] < np.arange(size)[:, None], axis=1)
    lengths = np.arange(min(short, long), long + 1)
    tops = (2 * fits[:, lengths - 1] / (n + lengths)).max(axis=1)
    last = np.arange(max(0, size - short + 1), size)  # their windows end with the stretch and are shorter
    tops[last] = 2 * fits[last, size - last - 1] / (n + size - last)
    heap = [(-top, start, 0, _ANY_ORDER) for start, top in enumerate(tops.tolist()) if top >= floor]
    heapify(heap)
    matcher = _Matcher(words, near)
    while heap:
        bound, start, end, kind = heappop(heap)
        if kind == _SCORED:
            return low + start, low + end, -bound
        if kind == _ANY_ORDER:
            for end, common in _common_in_order(words, near, size, start, short, long).items():
                if (top := 2 * common / (n + end - start)) >= floor:
                    heappush(heap, (-top, start, end, _IN_ORDER))
        elif (score := 2 * matcher.matches(start, end) / (n + end - start)) >= floor:
            heappush(heap, (-score, start, end, _SCORED))
    return None


def anchors(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Each row's span of words: session_id, position, n, from_word, to_word, score, clamped, confident (anchors of the session), total, loose (words between it and the next row's, null without any).

    `rows` has session_id, position and text, `words` session_id, at and word, both
    compared by their cue words. A row without an anchor has an empty span at the
    cursor and a score of 0; one that begins before the cursor is clamped to it. A
    session's rows and words are held together. Sessions without words have no rows.
    """
    schema = "session_id long, position long, n long, from_word long, to_word long, score double, clamped boolean, confident long, total long, loose array<string>"
    each = rows.select(F.col("session_id").cast("long").alias("session_id"), F.col("position").cast("long").alias("position"), cue_words(F.coalesce("text", F.lit(""))).alias("w"))
    heard = words.select(F.col("session_id").cast("long").alias("session_id"), F.col("at").cast("long").alias("at"), F.regexp_replace(F.lower(F.coalesce("word", F.lit(""))), "[^a-z0-9]", "").alias("word"), F.col("word").cast("string").alias("spoken"))

    def follow(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("at")
        stream, spoken = right.column("word").to_pylist(), right.column("spoken").to_pylist()
        cursor, out = 0, []
        for i, row in enumerate(left.sort_by("position").to_pylist() if stream else []):
            found, clamped = best_window(row["w"], stream, cursor), False
            if found and found[0] < cursor:
                found, clamped = (cursor, max(cursor, found[1]), found[2]), True
            if not found or found[1] <= found[0]:
                found = (cursor, cursor, 0.0)
            cursor = found[1]
            out.append({"session_id": row["session_id"], "position": row["position"], "n": i, "from_word": found[0], "to_word": found[1], "score": found[2], "clamped": clamped, "total": len(stream)})
        for x, y in zip(out, [*out[1:], {"from_word": len(stream)}]):
            x["loose"] = spoken[x["to_word"] : y["from_word"]] or None
        confident = sum(x["to_word"] > x["from_word"] for x in out)
        names = [f.strip().split(" ")[0] for f in schema.split(",")]
        columns = [[x.get(c, confident) for x in out] for c in names]
        kinds = {"score": pa.float64(), "clamped": pa.bool_(), "loose": pa.list_(pa.string())}
        return pa.table({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in zip(names, columns)})

    return each.groupBy("session_id").cogroup(heard.groupBy("session_id")).applyInArrow(follow, schema)


def _gap(found: DataFrame, rows: DataFrame, cues: Cues) -> DataFrame:
    """Anchored rows with the gap behind each, and what decides where it goes."""
    w = Window.partitionBy("session_id").orderBy("n")
    each = found.join(rows.select("session_id", F.col("position").cast("long").alias("position"), F.upper(F.coalesce("role", F.lit("UNKNOWN"))).alias("role"), "text"), ["session_id", "position"])
    each = each.withColumns({"next": F.lead("position").over(w), "before": F.lag("position").over(w), "next_role": F.lead("role").over(w), "gap_to": F.coalesce(F.lead("from_word").over(w), F.col("total"))})
    each = each.withColumn("gap", F.col("gap_to") - F.col("to_word"))
    role = lambda loose: phrase_role(cue_phrase(F.concat_ws(" ", F.coalesce("text", F.lit("")), F.array_join(loose, " "))), list(cues.doctor), list(cues.patient)).isNotNull()
    plain = lambda i: F.regexp_replace(F.lower(F.try_element_at("loose", F.lit(i))), "[^a-z0-9]", "")
    return each.withColumns({"first": plain(1), "final": plain(-1), "completes": role(F.col("loose")), "completes_but_last": role(F.slice("loose", 1, F.greatest(F.size("loose") - 1, F.lit(0))))})


def allocation(rows: DataFrame, words: DataFrame, cues: Cues = CONSULTATION) -> DataFrame:
    """(session_id, position, from_word, to_word, source): runs of a session's words for its rows, each word in one run.

    `words` are numbered from 0 without gaps (at). Runs of source `anchor` are the
    rows' own; `opening` words before the first anchor are the first row's. A
    `gap` behind a row goes to the next one, but a last gap stays (behind a row
    without anchor it goes to the row before), and so do up to two words that
    complete a cue phrase, that follow a doctor before another role, or that
    follow a patient before a doctor and don't start as a question does. A filler
    at the gap's end goes ahead alone if the rest completes a cue phrase, and one
    at its start goes ahead to a patient. With fewer anchors than 2, or than one
    in three rows, words are `shared` by the rows' own numbers of words.
    """
    found = anchors(rows, words)
    each = _gap(found, rows, cues).withColumn("enough", F.col("confident") >= F.greatest(F.lit(LEAST_ANCHORS), F.expr(f"(count(1) over (partition by session_id)) div {ROWS_AN_ANCHOR}")))
    run = lambda at, a, z, source: F.struct(at.alias("position"), a.cast("long").alias("from_word"), z.cast("long").alias("to_word"), F.lit(source).alias("source"))
    c = F.col
    own = F.when(c("to_word") > c("from_word"), run(c("position"), c("from_word"), c("to_word"), "anchor"))
    opening = F.when((c("n") == 0) & (c("from_word") > 0), run(c("position"), F.lit(0), c("from_word"), "opening"))
    missing, few = c("to_word") == c("from_word"), c("gap") <= TAIL
    ahead = (c("gap") > 1) & c("final").isin(list(cues.fillers)) & c("completes_but_last") & c("next").isNotNull() & ~missing
    stays = (few & c("completes")) | (
        ~(c("first").isin(list(cues.fillers)) & (c("next_role") == "PATIENT"))
        & few
        & (((c("role") == "DOCTOR") & (c("next_role") != "DOCTOR")) | ((c("role") == "PATIENT") & (c("next_role") == "DOCTOR") & ~c("first").isin(list(cues.starts))))
    )
    target = F.when(missing, F.coalesce("next", "before", "position")).when(c("next").isNull() | stays, c("position")).otherwise(c("next"))
    some = c("gap") > 0
    gap = F.when(some & ~ahead, run(target, c("to_word"), c("gap_to"), "gap"))
    kept, sent = F.when(some & ahead, run(c("position"), c("to_word"), c("gap_to") - 1, "gap")), F.when(some & ahead, run(c("next"), c("gap_to") - 1, c("gap_to"), "gap"))
    size = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\S+"), F.lit(0))).cast("long")
    session, order = Window.partitionBy("session_id"), Window.partitionBy("session_id").orderBy("n")
    each = each.withColumn("size", size)
    each = each.withColumns({"upto": F.sum("size").over(order), "whole": F.sum("size").over(session), "last": F.max("n").over(session)})
    cut = lambda part: F.when(c("whole") > 0, F.expr(f"total * ({part}) div whole")).otherwise(F.when(F.lit(part == "upto"), c("total")).otherwise(F.when(c("n") == 0, 0).otherwise(c("total"))))
    each = each.withColumns({"share_from": cut("upto - size").cast("long"), "share_to": F.when(c("n") == c("last"), c("total")).otherwise(cut("upto")).cast("long")})
    shared = F.when(c("share_to") > c("share_from"), run(c("position"), c("share_from"), c("share_to"), "shared"))
    # one pass for both kinds of session, as the anchors are dear
    runs = F.when(c("enough"), F.array(opening, own, gap, kept, sent)).otherwise(F.array(shared))
    return each.select("session_id", F.explode(F.array_compact(runs)).alias("r")).select("session_id", "r.*")
