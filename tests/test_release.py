"""Live release: worked steps, and the stream against the table with late, repeated and disordered steps."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from parlance.operators.release import STEP, released, release_step
from parlance.streaming.release import release_stream

START = datetime(2024, 1, 1)


def word(text, at, length=200, confidence=None):
    return {"text": text, "start_ms": at, "end_ms": at + length, "confidence": confidence}


def run(steps, max_hold=0):
    state, out, step = None, [], release_step(max_hold)
    for i, (clock, slot, first, words, final) in enumerate(steps):
        state, emitted = step(state, {"session_id": 1, "position": i, "clock_ms": clock, "slot": slot, "first": first, "words": words, "final": final})
        out.append(([(r["slot"], r["text"], r["start_ms"]) for r in emitted if r["kind"] == "row"], emitted[-1]))
    return out


def said(n, at=0, gap=300, name="w"):
    return [word(f"{name}{i}", at + gap * i) for i in range(n)]


def test_the_last_ten_words_are_held_and_rows_wait_for_the_clock():
    out = run([(4_000, "a", 0, said(12), False), (9_000, "a", 12, [], False), (9_100, "a", 12, [word("end", 8_000)], True)])
    assert out[0][0] == [] and out[0][1]["decision"] == "hold_clock_lookback" and out[0][1]["frontier_ms"] == 600
    assert out[1][0] == [("a", "w0 w1", 0)] and out[1][1]["decision"] == "release_ready_rows" and out[1][1]["hold_ms"] == 3_400
    assert out[2][0] == [("a", " ".join(f"w{i}" for i in range(2, 12)), 600), ("a", "end", 8_000)] and out[2][1]["decision"] == "final_flush"


def test_revisions_change_words_in_place_and_late_ones_are_counted():
    out = run([(9_000, "a", 0, said(12), False), (9_500, "a", 0, [word("x", 50), word("w1", 50), word("y", 50)], False), (9_600, "a", 3, said(9, 900, name="z"), True)])
    assert out[1][1]["revised"] == 2 and out[1][1]["late_revised"] == 1
    # the hypothesis shrank to three words and grew again: words keep their first span
    assert out[2][0] == [("a", "y " + " ".join(f"z{i}" for i in range(9)), 600)]


def test_silent_slots_hold_three_words_then_none_and_do_not_hold_others():
    steps = [(3_000, "a", 0, said(5), False), (14_000, "b", 0, said(12, 11_000), False), (20_000, "b", 12, said(1, 19_000), False), (27_000, "b", 13, said(1, 26_500), False)]
    out = run(steps)
    assert [o[1]["decision"] for o in out] == ["hold_mutable_tail", "release_ready_rows", "release_ready_rows", "release_ready_rows"]
    rows = [r for o in out for r in o[0]]
    assert ("a", "w0 w1", 0) in rows and ("a", "w2 w3 w4", 600) in rows


def test_a_bound_lets_rows_pass_old_held_words():
    steps = [(1_000, "a", 0, said(3, 0), False), (11_900, "b", 0, said(14, 4_000), False)]
    assert run(steps)[1][1]["decision"] == "hold_stability_frontier"
    out = run(steps, max_hold=8_000)
    assert out[1][1]["decision"] == "release_bounded_stability_frontier" and out[1][0] == [("b", "w0 w1 w2 w3", 4_000)]
    last = run([*steps, (12_000, "a", 3, [], True)], max_hold=8_000)[2]
    assert last[0][0] == ("a", "w0 w1 w2", 0)


def steps_of(session, n, seed):
    rng, out, logs, clock = random.Random(seed), [], {"a": 0, "b": 0}, 0
    for i in range(n):
        slot = rng.choice("ab")
        clock += rng.randrange(300, 2_500)
        first = max(0, logs[slot] - rng.randrange(4))
        words = [word(f"{slot}{rng.randrange(9)}", clock + 150 * k, 140, rng.random()) for k in range(rng.randrange(1, 7))]
        logs[slot] = max(logs[slot], first + len(words))
        out.append({"session_id": session, "position": i, "clock_ms": clock, "slot": slot, "first": first, "words": words, "final": i == n - 1 and session != 3, "arrived": i})
    return out


@pytest.mark.parametrize("max_hold", [0, 6_000])
def test_stream_equals_table(spark, tmp_path, max_hold):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    every = [s for k in (1, 2, 3) for s in steps_of(k, 40, k)]
    sent = sorted(every, key=lambda s: s["arrived"])
    rng = random.Random(3)
    for i in range(0, len(sent), 12):  # out of order inside the delay, some twice
        part = sent[i : i + 12]
        rng.shuffle(part)
        sent[i : i + 12] = part
    sent = [*sent[:50], *sent[40:50], *sent[50:]]
    folder = tmp_path / "in"
    folder.mkdir()

    def write(name, rows):
        (folder / name).write_text("".join(json.dumps({**r, "arrived": (START + timedelta(seconds=r["arrived"])).isoformat()}) + "\n" for r in rows))
        at = 1_700_000_000 + len(os.listdir(folder))
        os.utime(folder / name, (at, at))

    for i in range(0, len(sent), 26):
        write(f"{i:03d}.json", sent[i : i + 26])
    write("800.json", [{**every[0], "session_id": 9, "arrived": 200}])
    write("801.json", [{**every[5], "position": 99, "arrived": 2}, {**every[0], "session_id": 9, "position": 1, "arrived": 500}])
    write("802.json", [{**every[0], "session_id": 9, "position": 2, "arrived": 501}])
    source = spark.readStream.schema(STEP + ", arrived timestamp").option("maxFilesPerTrigger", 1).json(str(folder))
    name = f"released{max_hold}"
    query = release_stream(source, delay="12 seconds", idle_ms=60_000, max_hold=max_hold).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ckpt")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = [r for r in spark.table(name).collect() if r.session_id != 9]
    flushed = [{**s} for s in every]
    flushed.append({"session_id": 3, "position": 40, "clock_ms": max(s["clock_ms"] for s in every if s["session_id"] == 3), "slot": None, "first": None, "words": None, "final": True})
    table = spark.createDataFrame([{k: v for k, v in s.items() if k != "arrived"} for s in flushed], STEP)
    want = released(table, max_hold).collect()
    line = lambda r: str([None if isinstance(x, float) and x != x else x for x in r])
    assert sorted(map(line, got)) == sorted(map(line, want)) and len(want) > 150
