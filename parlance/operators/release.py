"""Live release of recognised words: stable prefixes of each slot, in spoken order across slots.

A step of a session brings one slot's hypothesis from word `first` on; the words
before it are as they were. Words enter the slot's log with the span in which they
were first heard; later hypotheses change their text in place, and a change of a
word that was shown is counted. The last words of a log are held as they may
change; a slot that has been silent for long holds fewer, then none. Stable words
become rows, rows wait until the clock and the oldest held word have passed them.

`release_step` is that rule for one step. It runs over tables here and over
streams in `parlance.streaming.release`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from parlance.operators.folds import fold
from parlance.operators.live import DORMANT_AFTER, DORMANT_WORDS, DRAIN_AFTER, LOOKBACK, MUTABLE_WORDS, ROW_GAP

#: Between two looks at the clock at most, in milliseconds.
TICK = 5_000

WORDS = "array<struct<text: string, start_ms: long, end_ms: long, confidence: double>>"
STEP = f"session_id long, position long, clock_ms long, slot string, first int, words {WORDS}, final boolean"
#: `kind` is `row` or `decision`; the other's columns are null.
RELEASED = (
    "session_id long, position long, kind string, slot string, text string, start_ms long, end_ms long, confidence double, late boolean, "
    "decision string, clock_horizon_ms long, frontier_ms long, horizon_ms long, hold_ms long, pending_before int, ready int, released int, pending_after int, unstable_slots int, revised int, late_revised int"
)
_NAMES = [f.strip().split(" ")[0] for f in RELEASED.split(", ")]


def new_state() -> dict:
    """Slots (log of [text, start, end, confidence], shown, last), rows that wait, the newest start shown, and counts."""
    return {"slots": {}, "pending": [], "newest": -1, "revised": 0, "late_revised": 0, "clock": 0, "position": -1}


def _hear(state: dict, row: dict) -> None:
    if row["slot"] is None:
        return
    slot = state["slots"].setdefault(row["slot"], {"log": [], "shown": 0, "last": 0})
    log, words, first = slot["log"], row["words"] or [], max(0, min(row["first"] or 0, len(slot["log"])))
    for i, word in enumerate(words[: len(log) - first], first):
        if log[i][0] != word["text"]:
            state["revised"] += 1
            state["late_revised"] += i < slot["shown"]
            log[i][0] = word["text"]
        if word["confidence"] is not None:
            log[i][3] = word["confidence"]
    del log[max(slot["shown"], first + len(words)) :]
    log += [[w["text"], w["start_ms"], max(w["end_ms"], w["start_ms"] + 50), w["confidence"]] for w in words[len(log) - first :]]
    slot["last"] = max([slot["last"], *(w["end_ms"] for w in words)])


def _held(slot: dict, clock: int) -> int:
    silent = clock - slot["last"]
    return 0 if silent > DRAIN_AFTER else DORMANT_WORDS if silent > DORMANT_AFTER else MUTABLE_WORDS


def _rows(state: dict, final: bool) -> None:
    """Moves stable words to the rows that wait; a silence inside parts rows."""
    for name, slot in state["slots"].items():
        upto = len(slot["log"]) if final else max(slot["shown"], len(slot["log"]) - _held(slot, state["clock"]))
        words, slot["shown"] = slot["log"][slot["shown"] : upto], upto
        group: list = []
        for word in [*words, None]:
            if group and (word is None or word[1] - group[-1][2] > ROW_GAP):
                sure = [w[3] for w in group if w[3] is not None]
                state["pending"].append({"slot": name, "text": " ".join(w[0] for w in group), "start_ms": group[0][1], "end_ms": max(w[2] for w in group), "confidence": sum(sure) / len(sure) if sure else None})
                group = []
            group.append(word)


def release_step(max_hold: int = 0):
    """The rule, with a bound in milliseconds on how long held words may keep back rows that the clock has passed (0: none)."""

    def step(state: dict | None, row: dict) -> tuple[dict, list[dict]]:
        state = state or new_state()
        state["clock"], state["position"] = max(state["clock"], row["clock_ms"]), row["position"]
        _hear(state, row)
        _rows(state, bool(row["final"]))
        waiting, clock = state["pending"], state["clock"] - LOOKBACK
        unstable = [(s["log"][s["shown"]][1], len(s["log"]) - s["shown"] <= DORMANT_WORDS and state["clock"] - s["last"] > DORMANT_AFTER) for s in state["slots"].values() if len(s["log"]) > s["shown"]]
        frontier = min((start for start, dormant in unstable if not dormant), default=None)
        horizon = clock if frontier is None else min(clock, frontier)
        hold = None if frontier is None else max(0, clock - frontier)
        ready = sum(r["start_ms"] <= clock for r in waiting)
        blocked = sum(horizon < r["start_ms"] <= clock for r in waiting)
        bounded = not row["final"] and max_hold > 0 and blocked > 0 and hold + TICK > max_hold
        if bounded:
            horizon = clock
        out = sorted((r for r in waiting if row["final"] or r["start_ms"] <= horizon), key=lambda r: (r["start_ms"], r["slot"]))
        state["pending"] = [] if row["final"] else [r for r in waiting if r["start_ms"] > horizon]
        if row["final"]:
            label = "final_flush"
        elif not waiting:
            label = "hold_mutable_tail" if frontier is not None else "no_pending_rows"
        elif bounded:
            label = "release_bounded_stability_frontier"
        elif out:
            label = "release_limited_by_stability_frontier" if len(out) < ready else "release_ready_rows"
        else:
            label = "hold_stability_frontier" if ready else "hold_clock_lookback"
        key = {"session_id": row["session_id"], "position": row["position"]}
        emitted = []
        for r in out:
            emitted.append(dict.fromkeys(_NAMES) | key | r | {"kind": "row", "late": r["start_ms"] < state["newest"]})
            state["newest"] = max(state["newest"], r["start_ms"])
        final = bool(row["final"])
        decision = {
            "kind": "decision", "decision": label, "clock_horizon_ms": clock, "frontier_ms": None if final else frontier, "horizon_ms": None if final or not waiting and frontier is None else horizon if waiting else frontier, "hold_ms": None if final else hold,
            "pending_before": len(waiting), "ready": len(waiting) if final else ready, "released": len(out), "pending_after": len(state["pending"]), "unstable_slots": 0 if final else len(unstable), "revised": state["revised"], "late_revised": state["late_revised"],
        }
        return state, [*emitted, dict.fromkeys(_NAMES) | key | decision]

    return step


def released(steps: DataFrame, max_hold: int = 0) -> DataFrame:
    """What each step of each session releases, and its decision (columns of RELEASED); steps are in the order of position."""
    return fold(steps, ["session_id"], ["position"], release_step(max_hold), RELEASED)
