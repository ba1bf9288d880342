"""Streams against the same rules over tables, with late rows and expired keys."""

import json
import os
from datetime import datetime, timedelta

from parlance.operators import live
from parlance.streaming import sessions

START = datetime(2024, 1, 1)


def _write(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("".join(json.dumps({**r, "arrived": (START + timedelta(seconds=r["arrived"])).isoformat()}) + "\n" for r in rows))
    at = 1_700_000_000 + len(os.listdir(path))  # a stream takes files by their time
    os.utime(path / name, (at, at))


def _drain(stream, tmp_path, name):
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"ckpt-{name}")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    return stream.sparkSession.table(name).collect()


def _source(spark, path, schema):
    return spark.readStream.schema(schema + ", arrived timestamp").option("maxFilesPerTrigger", 1).json(str(path))


def test_reread_stream_equals_table_and_drops_late_rows(spark, tmp_path):
    rows = [{"session_id": s, "segment_id": f"{s}-{i}", "position": i, "start_ms": 900 * i, "end_ms": 900 * i + 1100 + 37 * s, "arrived": 2 * i} for i in range(30) for s in (1, 2)]
    for at in range(0, len(rows), 20):
        _write(tmp_path / "in", f"{at:03d}.json", rows[at : at + 20])
    _write(tmp_path / "in", "900.json", [{"session_id": 1, "segment_id": "late", "position": 99, "start_ms": 90_000, "end_ms": 95_000, "arrived": 1}])
    schema = "session_id long, segment_id string, position long, start_ms long, end_ms long"
    got = {r.segment_id for r in _drain(sessions.reread_stream(_source(spark, tmp_path / "in", schema)), tmp_path, "reread")}
    table = spark.createDataFrame([{k: v for k, v in r.items() if k != "arrived"} for r in rows], schema)
    want = {r.segment_id for r in live.reread_emissions(table).collect()}
    assert got == want and "late" not in got and len(want) > 30


def test_debounced_stream_equals_table(spark, tmp_path):
    rows = [{"session_id": 1, "position": i, "proposed": p, "confidence": c, "arrived": i} for i, (p, c) in enumerate([("AB", 80), ("BA", 82), ("AB", 80), ("BA", 82), ("BA", 70), ("AB", 99), ("AB", 50)])]
    _write(tmp_path / "in", "0.json", rows[:3])
    _write(tmp_path / "in", "1.json", rows[3:])
    schema = "session_id long, position long, proposed string, confidence long"
    got = sorted((r.position, r.shown, r.suppressed) for r in _drain(sessions.debounced_stream(_source(spark, tmp_path / "in", schema)), tmp_path, "debounced"))
    assert got == [(0, "AB", False), (1, "AB", True), (2, "AB", False), (3, "AB", True), (4, "BA", False), (5, "AB", False), (6, "AB", False)]
    table = spark.createDataFrame([{k: v for k, v in r.items() if k != "arrived"} for r in rows], schema)
    assert sorted((r.position, r.shown, r.suppressed) for r in live.debounced(table).collect()) == got


def test_idle_keys_finish(spark, tmp_path):
    step = lambda state, row: ({"n": (state or {"n": 0})["n"] + 1}, [])
    _write(tmp_path / "in", "0.json", [{"session_id": 1, "arrived": 0}, {"session_id": 1, "arrived": 1}])
    _write(tmp_path / "in", "1.json", [{"session_id": 2, "arrived": 100}])
    _write(tmp_path / "in", "2.json", [{"session_id": 2, "arrived": 101}])
    source = _source(spark, tmp_path / "in", "session_id long")
    out = sessions.stateful(source, ["session_id"], ["session_id"], step, "n long", time="arrived", delay="1 second", idle_ms=10_000, finish=lambda s: [s])
    assert [r.n for r in _drain(out, tmp_path, "idle")] == [2]
