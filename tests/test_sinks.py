"""The store of sessions: appends, replacements, retries, conflicts and compaction."""

import os

import pytest
from parlance.sources import sinks


def rows(spark, *values):
    return spark.createDataFrame(list(values), "session_id long, position int, text string")


def content(spark, path):
    return sorted(tuple(r) for r in sinks.stored(spark, path).collect())


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_the_store_only_adds_files(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    sinks.create(rows(spark, (1, 0, "a"), (1, 1, "b"), (2, 0, "c")), path)
    with pytest.raises(sinks.Conflict):
        sinks.create(rows(spark, (1, 0, "x")), path)
    before = files(tmp_path)
    assert sinks.append_rows(spark, path, rows(spark, (1, 7, "d"), (1, 9, "e"), (3, 5, "f")), request="r1") == 2
    assert sinks.append_rows(spark, path, rows(spark, (1, 7, "d"), (1, 9, "e"), (3, 5, "f")), request="r1") == 2
    after = files(tmp_path)
    assert before.items() <= after.items() and len(after) > len(before)
    assert content(spark, path) == [(1, 0, "a"), (1, 1, "b"), (1, 2, "d"), (1, 3, "e"), (2, 0, "c"), (3, 0, "f")]
    sinks.replace_sessions(spark, path, rows(spark, (1, 4, "y"), (1, 2, "x")))
    sinks.delete_sessions(spark, path, rows(spark, (2, 0, ""), (9, 0, "")))
    sinks.append_rows(spark, path, rows(spark, (2, 0, "new")))
    want = [(1, 0, "x"), (1, 1, "y"), (2, 0, "new"), (3, 0, "f")]
    assert content(spark, path) == want and after.items() <= files(tmp_path).items()
    sinks.compact(spark, path)
    assert content(spark, path) == want
    now = sinks._version(spark, path)[0]
    assert sinks.append_rows(spark, path, rows(spark, (1, 0, "again")), request="r1") == now and content(spark, path) == want
    sinks.delete_sessions(spark, path, rows(spark, (1, 0, "")))
    assert content(spark, path) == want[2:]


def test_a_write_that_fails_or_loses_leaves_nothing(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/store"
    sinks.create(rows(spark, (1, 0, "a")), path)
    stale = sinks._version(spark, path)
    sinks.append_rows(spark, path, rows(spark, (1, 0, "b")))
    monkeypatch.setattr(sinks, "_version", lambda *_: stale)
    with pytest.raises(sinks.Conflict):
        sinks.append_rows(spark, path, rows(spark, (1, 0, "lost")))
    monkeypatch.undo()
    assert content(spark, path) == [(1, 0, "a"), (1, 1, "b")]
