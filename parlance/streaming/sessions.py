"""Order-dependent rules over streams: the step functions of `parlance.operators` with Spark's keyed state."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from parlance.operators.folds import Step
from parlance.operators.live import DEBOUNCED, REREAD, debounce_step, reread_step

Finish = Callable[[dict], list[dict]]


def stateful(rows: DataFrame, by: list[str], order: list[str], step: Step, schema: str, *, time: str, delay: str, idle_ms: int, finish: Finish | None = None) -> DataFrame:
    """What `step` emits over each key's rows, in order within a micro-batch.

    Rows older than the watermark (`delay` behind the latest `time`) are dropped
    by Spark. A key that the watermark has passed by `idle_ms` emits `finish` of
    its state and forgets it, so state is bounded by the keys in use. State is one
    JSON text for each key.
    """
    names = StructType.fromDDL(schema).fieldNames()

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (text,) = state.get
            state.remove()
            yield pd.DataFrame(finish(json.loads(text)) if finish else [], columns=names)
            return
        now = json.loads(state.get[0]) if state.exists else None
        table = pd.concat(list(parts)).sort_values(order, kind="stable")
        latest, out = int(pd.to_datetime(table[time]).max().timestamp() * 1000), []
        for row in json.loads(table.drop(columns=[time]).to_json(orient="records")):
            now, emitted = step(now, row)
            out += emitted
        state.update((json.dumps(now),))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame(out, columns=names)

    timed = rows.withWatermark(time, delay)
    return timed.groupBy(*by).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.EventTimeTimeout)


def reread_stream(rows: DataFrame, *, window: int = 10_000, time: str = "arrived", delay: str = "5 seconds", idle_ms: int = 7_200_000) -> DataFrame:
    """Rows of re-read windows as they become visible; a row that ends before what is shown is not shown again."""
    return stateful(rows, ["session_id"], ["end_ms", "position"], reread_step(window), REREAD, time=time, delay=delay, idle_ms=idle_ms)


def debounced_stream(proposals: DataFrame, *, time: str = "arrived", delay: str = "5 seconds", idle_ms: int = 7_200_000) -> DataFrame:
    """What is shown after each proposed mapping of a session."""
    return stateful(proposals, ["session_id"], ["position"], debounce_step, DEBOUNCED, time=time, delay=delay, idle_ms=idle_ms)


def session_counts(events: DataFrame, *, time: str = "ts", gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """session_id, window and events of each run of events without a gap, once the watermark has passed it."""
    from pyspark.sql import functions as F

    return events.withWatermark(time, delay).groupBy("session_id", F.session_window(time, gap).alias("window")).agg(F.count(F.lit(1)).alias("events"))


def deduplicated(rows: DataFrame, keys: list[str], *, time: str = "arrived", delay: str = "10 minutes") -> DataFrame:
    """The first of rows that share their keys within the watermark, as retried publishers send them."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
