"""Live release over a stream, with keyed state and event-time timers.

Steps wait in a list until the watermark has passed their time, and are then taken
in the order of position: so steps that come out of order, or twice, give what
the table gives. A session's logs are a map by slot, and rows that wait to be
shown a list; only slots that a step touches are written again. A session that
the watermark has passed by `idle_ms` is flushed and forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parlance.operators.release import RELEASED, WORDS, new_state, release_step

_NAMES = [f.strip().split(" ")[0] for f in RELEASED.split(", ")]


class Release(StatefulProcessor):
    def __init__(self, max_hold: int, idle_ms: int):
        self.step, self.idle_ms = release_step(max_hold), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.early = handle.getListState("early", f"at long, position long, clock_ms long, slot string, first int, words {WORDS}, final boolean")
        self.slots = handle.getMapState("slots", "slot string", f"shown int, last long, log {WORDS}")
        self.pending = handle.getListState("pending", "slot string, text string, start_ms long, end_ms long, confidence double")
        self.counts = handle.getValueState("counts", "newest long, revised long, late_revised long, clock long, position long, idle_at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for table in rows:
            new = [(int(r.at), int(r.position), int(r.clock_ms), r.slot, None if pd.isna(r.first) else int(r.first), _words(r.words), bool(r.final)) for r in table.itertuples()]
            self.early.appendList(new)
            for at in {r[0] for r in new}:
                self.handle.registerTimer(max(at, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame([], columns=_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = [(*r[:5], [tuple(w) for w in r[5]], r[6]) for r in self.early.get()]  # state can't take rows back
        due, later = [], []
        for r in waiting:
            (due if r[0] <= now else later).append(r)
        counts = self.counts.get() if self.counts.exists() else None
        state, idle_at = self._state(counts), counts[5] if counts else 0
        out, touched = [], set()
        for r in sorted(due, key=lambda r: r[1]):
            if r[1] <= state["position"]:
                continue  # this step has been taken
            row = {"session_id": key[0], "position": r[1], "clock_ms": r[2], "slot": r[3], "first": r[4], "words": [dict(zip(("text", "start_ms", "end_ms", "confidence"), w)) for w in r[5]], "final": r[6]}
            before = {name: slot["shown"] for name, slot in state["slots"].items()}
            state, emitted = self.step(state, row)
            out += emitted
            touched |= {name for name, slot in state["slots"].items() if name == r[3] or before.get(name) != slot["shown"]}
        if due:
            idle_at = max(idle_at, max(r[0] for r in due) + self.idle_ms)
            self.handle.registerTimer(idle_at)
        elif not later and now >= idle_at:
            if state["pending"] or any(len(s["log"]) > s["shown"] for s in state["slots"].values()):
                _, out = self.step(state, {"session_id": key[0], "position": state["position"] + 1, "clock_ms": state["clock"], "slot": None, "first": None, "words": None, "final": True})
            for kept in (self.early, self.slots, self.pending, self.counts):
                kept.clear()
            yield pd.DataFrame(out, columns=_NAMES)
            return
        if due:
            self.early.put(later) if later else self.early.clear()
            for name in touched:
                slot = state["slots"][name]
                self.slots.updateValue((name,), (slot["shown"], slot["last"], [tuple(w) for w in slot["log"]]))
            rows = [tuple(r[c] for c in ("slot", "text", "start_ms", "end_ms", "confidence")) for r in state["pending"]]
            self.pending.put(rows) if rows else self.pending.clear()
            self.counts.update((state["newest"], state["revised"], state["late_revised"], state["clock"], state["position"], idle_at))
        yield pd.DataFrame(out, columns=_NAMES)

    def _state(self, counts) -> dict:
        state = new_state()
        if counts:
            state |= dict(zip(("newest", "revised", "late_revised", "clock", "position"), counts))
            state["slots"] = {name[0]: {"shown": s[0], "last": s[1], "log": [list(w) for w in s[2]]} for name, s in self.slots.iterator()}
            state["pending"] = [dict(zip(("slot", "text", "start_ms", "end_ms", "confidence"), r)) for r in self.pending.get()]
        return state

    def close(self) -> None:
        pass


def _words(words) -> list[tuple]:
    found = [] if words is None else words
    value = lambda w, c: w[c] if isinstance(w, dict) else getattr(w, c)
    return [(value(w, "text"), int(value(w, "start_ms")), int(value(w, "end_ms")), None if pd.isna(value(w, "confidence")) else float(value(w, "confidence"))) for w in found]


def release_stream(steps: DataFrame, *, time: str = "arrived", delay: str = "5 seconds", idle_ms: int = 7_200_000, max_hold: int = 0) -> DataFrame:
    """Released rows and decisions (columns of RELEASED) of a stream of steps with an event time.

    Steps later than the watermark (`delay` behind the latest) are dropped by
    Spark. Needs the RocksDB state store.
    """
    timed = steps.withWatermark(time, delay).withColumn("at", F.unix_millis(time))
    processor = Release(max_hold, idle_ms)
    return timed.groupBy("session_id").transformWithStateInPandas(processor, RELEASED, "append", "eventTime")
