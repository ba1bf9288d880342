"""Sinks: a versioned store of sessions' rows, quality records, evidence files and canonical JSON.

The store never changes a file. A write puts its rows, or the sessions that it
takes away, into a folder of its own and then commits a version: a small file
that lists all writes which count, moved into place without overwriting. So an
append costs what it adds, a write that fails leaves nothing that is read, and of
two writers one has to try again. A row counts unless a later write took its
session away. `compact` writes what counts as one write again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was about to."""


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _version(spark: SparkSession, path: str) -> tuple[int, list[dict]]:
    """The newest version and its writes (write, version, rows, gone, request), in order; 0 and none for a new store."""
    fs, at = _hadoop(spark, path)
    found = max([0, *(int(f.getPath().getName()[1:]) for f in fs.globStatus(at(f"{path}/versions/v*")) or [])])
    return found, [json.loads(r.value) for r in spark.read.text(f"{path}/versions/v{found}").collect()] if found else []


def _commit(spark: SparkSession, path: str, writes: list[dict], after: int) -> int:
    fs, at = _hadoop(spark, path)
    aside, final = at(f"{path}/staged/{uuid.uuid4().hex}"), at(f"{path}/versions/v{after + 1}")
    out = fs.create(aside, False)
    out.write(bytearray("".join(json.dumps(w) + "\n" for w in writes).encode()))
    out.close()
    fs.mkdirs(final.getParent())
    jvm = spark.sparkContext._jvm
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(aside, final, options)
    except Py4JJavaError as failed:
        if not fs.exists(final):
            raise
        raise Conflict(f"version {after + 1} of {path} is there already") from failed
    return after + 1


def _write(spark: SparkSession, path: str, rows: DataFrame | None, gone: DataFrame | None, request: str | None) -> int:
    """Write and commit rows and the sessions taken away before them; a request that has been committed is not repeated."""
    now, writes = _version(spark, path)
    if request is not None and any(w["request"] == request for w in writes):
        return now
    name = uuid.uuid4().hex
    if rows is not None:
        rows.repartition("session_id").sortWithinPartitions("session_id", "position").write.parquet(f"{path}/rows/_write={name}")
    if gone is not None:
        gone.select("session_id").distinct().write.parquet(f"{path}/gone/_write={name}")
    return _commit(spark, path, [*writes, {"write": name, "version": now + 1, "rows": rows is not None, "gone": gone is not None, "request": request}], now)


def create(rows: DataFrame, path: str) -> int:
    """Store rows of sessions as version 1; fails if the store is there."""
    if _version(rows.sparkSession, path)[0]:
        raise Conflict(f"{path} is a store already")
    return _write(rows.sparkSession, path, rows, None, None)


def _read(spark: SparkSession, path: str, kind: str, writes: list[dict]) -> DataFrame:
    """Rows or sessions of these writes, with the version of each."""
    some = [w for w in writes if w[kind]]
    found = spark.read.option("basePath", f"{path}/{kind}").parquet(*(f"{path}/{kind}/_write={w['write']}" for w in some))
    numbers = spark.createDataFrame([(w["write"], w["version"]) for w in some], "_write string, _version long")
    return found.join(F.broadcast(numbers), "_write").drop("_write")  # a row for each write since the last compaction


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the newest version."""
    _, writes = _version(spark, path)
    rows = _read(spark, path, "rows", writes)
    if any(w["gone"] for w in writes):
        gone = _read(spark, path, "gone", writes).groupBy("session_id").agg(F.max("_version").alias("_gone"))
        rows = rows.join(gone, "session_id", "left").where("_gone is null or _version >= _gone").drop("_gone")
    return rows.drop("_version")


def _as_stored(rows: DataFrame, there: DataFrame) -> DataFrame:
    return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in there.schema))


def append_rows(spark: SparkSession, path: str, rows: DataFrame, request: str | None = None) -> int:
    """Add rows behind each session's last position, in the order of their own positions; returns the version."""
    there = stored(spark, path)
    last = there.join(rows.select("session_id").distinct(), "session_id", "left_semi").groupBy("session_id").agg(F.max("position").alias("_last"))
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy("position"))
    placed = rows.withColumn("_nth", nth).join(last, "session_id", "left").withColumn("position", F.coalesce("_last", F.lit(-1)) + F.col("_nth"))
    return _write(spark, path, _as_stored(placed, there), None, request)


def replace_sessions(spark: SparkSession, path: str, rows: DataFrame, request: str | None = None) -> int:
    """Put these rows in place of all rows of their sessions; positions become 0, 1, ... in their order."""
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy("position")) - 1
    return _write(spark, path, _as_stored(rows.withColumn("position", nth), stored(spark, path)), rows, request)


def delete_sessions(spark: SparkSession, path: str, sessions: DataFrame, request: str | None = None) -> int:
    """Take all rows of these sessions away."""
    return _write(spark, path, None, sessions, request)


def compact(spark: SparkSession, path: str) -> int:
    """Write what counts as one write; requests committed so far stay known."""
    now, writes = _version(spark, path)
    name = uuid.uuid4().hex
    stored(spark, path).repartition("session_id").sortWithinPartitions("session_id", "position").write.parquet(f"{path}/rows/_write={name}")
    known = [{"write": "", "version": 0, "rows": False, "gone": False, "request": w["request"]} for w in writes if w["request"] is not None]
    return _commit(spark, path, [*known, {"write": name, "version": now + 1, "rows": True, "gone": False, "request": None}], now)


def canonical_json(columns: Sequence[str]) -> Column:
    """A compact JSON object of the columns, keys sorted; nulls are written as null."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def append_quality(records: DataFrame, path: str) -> None:
    """Add a JSON line with sorted keys for each record; records without a session are empty and write nothing."""
    records.where("session_id is not null").select(canonical_json(records.columns).alias("value")).write.mode("append").text(path)


def write_evidence(rows: DataFrame, path: str) -> None:
    """One evidence folder for each (session_id, name); what was there under the same pair is replaced, the rest stays."""
    rows.repartition("session_id", "name").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id", "name").json(path)


def write_once(rows: DataFrame, path: str) -> None:
    """Canonical JSON lines at a path that must not be there yet."""
    rows.select(canonical_json(rows.columns).alias("value")).write.mode("errorifexists").text(path)
