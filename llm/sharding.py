"""Size-tiered compaction of immutable shards under versioned manifests.

`append` writes arrivals as small shards and commits a manifest that lists them.
`compact` plans on the manifest alone: a shard's tier is the power of `fanout`
that its bytes reach over `base`; in each tier, from the smallest, shards next
to each other are put into bins of the next tier's size, and a bin that is full
is merged. Only shards that merge are read and rewritten, once. The order is that
of sequence numbers which commits give: an append's shards, by arrival number,
come after all that are there, so arrival numbers may repeat and have any gaps.

Each write goes to a folder of its own, named by a fresh id (`attempt`) that the
manifest lists, so files of a write that failed or lost are never read. A
manifest is a Parquet folder under a fresh name; version n + 1 is committed by
moving one small file with that name to `versions/v<n+1>` without overwriting.
The move fails if the version is there, so of two writers one has to plan again;
readers see the old version or the new one. On HDFS that move is atomic; on a
store without an atomic move, one writer at a time is needed. Shards are never
changed; those that no manifest of interest lists can be deleted at leisure.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.storage import join_checked, partitions, stored

BASE, FANOUT, TIERS = 1 << 20, 4, 3
TARGET = BASE * FANOUT**TIERS
#: Shards that follow each other in the order of commits and are planned together.
LANE = 1 << 14


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was about to."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def version(spark: SparkSession, root: str) -> int:
    """The newest committed version, 0 if there is none."""
    fs, path = _fs(spark, root)
    found = fs.globStatus(path(f"{root}/versions/v*"))
    return max([0, *(int(f.getPath().getName()[1:]) for f in found or [])])


def manifest(spark: SparkSession, root: str, at: int | None = None) -> DataFrame:
    """(shard, attempt, seq, first, docs, bytes) of a version's shards; seq is their order, first the (least) arrival number."""
    name = spark.read.text(f"{root}/versions/v{at or version(spark, root)}").first()[0]
    return spark.read.schema("shard string, attempt string, seq long, first long, docs long, bytes long").parquet(f"{root}/manifests/{name}")


def commit(spark: SparkSession, root: str, shards: DataFrame, after: int) -> int:
    """Make `shards` version after + 1, or raise Conflict if there is one."""
    fs, path = _fs(spark, root)
    name = uuid.uuid4().hex
    shards.select("shard", "attempt", "seq", "first", "docs", "bytes").write.parquet(f"{root}/manifests/{name}")
    aside, final = path(f"{root}/staged/{name}"), path(f"{root}/versions/v{after + 1}")
    out = fs.create(aside, False)
    out.write(bytearray(name.encode()))
    out.close()
    fs.mkdirs(final.getParent())
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(aside, final, options)
    except Py4JJavaError as failed:
        if not fs.exists(final):
            raise
        raise Conflict(f"version {after + 1} of {root} is there already") from failed
    return after + 1


def read(spark: SparkSession, root: str, at: int | None = None) -> DataFrame:
    """All rows of a version, with the shard of each in a column _shard."""
    shards = manifest(spark, root, at)
    named = shards.select(F.col("shard").alias("_shard"), F.col("attempt").alias("_attempt"))
    return join_checked(_data(spark, root, shards), named, ["_shard", "_attempt"]).drop("_attempt")


def _data(spark: SparkSession, root: str, shards: DataFrame) -> DataFrame:
    """Rows of the writes that these shards come from; there is a write for each version at most."""
    schema = spark.read.parquet(f"{root}/schema").schema.add("_attempt", "string")  # known even while there are no rows
    attempts = sorted(r.attempt for r in shards.select("attempt").distinct().collect())
    if not attempts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{root}/data").parquet(*(f"{root}/data/_attempt={x}" for x in attempts))


def _write(rows: DataFrame, root: str, attempt: str) -> None:
    rows = rows.repartition(2 * partitions(rows.sparkSession), "_shard").sortWithinPartitions("_shard")
    rows.write.option("compression", "zstd").partitionBy("_shard").parquet(f"{root}/data/_attempt={attempt}")


def append(rows: DataFrame, root: str, *, arrival: Column, text: str = "text") -> int:
    """Write rows as one small shard for each arrival number, and commit them after those that are there.

    Null arrival numbers are arrival -1; null texts count 0 bytes; equal rows are
    kept each; an empty table commits a version without new shards. Columns named
    _shard, _attempt and _first are replaced. A call that fails leaves the
    version as it was and can be made again.
    """
    spark, rows, attempt = rows.sparkSession, rows.drop("_shard", "_attempt", "_first"), uuid.uuid4().hex
    now = version(spark, root)
    first = F.coalesce(arrival.cast("long"), F.lit(-1))
    named = rows.withColumn("_first", first).withColumn("_shard", F.concat(F.lit(f"v{now + 1}-a"), F.format_string("%012d", F.col("_first"))))
    named.drop("_first").limit(0).write.mode("append").parquet(f"{root}/schema")
    _write(named.drop("_first"), root, attempt)
    new = named.groupBy(F.col("_shard").alias("shard"), F.lit(attempt).alias("attempt"), F.col("_first").alias("first")).agg(F.count(F.lit(1)).alias("docs"), F.sum(F.coalesce(F.octet_length(text), F.lit(0))).cast("long").alias("bytes"))
    there = manifest(spark, root, now) if now else None
    start = (there.agg(F.max("seq")).first()[0] if now else None) or 0
    new = new.withColumn("seq", F.row_number().over(Window.orderBy("first")) + F.lit(start).cast("long"))  # a row for each arrival of this call
    return commit(spark, root, there.unionByName(new) if now else new, now)


def plan(shards: DataFrame, *, base: int = BASE, fanout: int = FANOUT, tiers: int = TIERS) -> DataFrame:
    """Each shard's run after compaction: its columns and run, the first sequence number of what it merges into."""
    now = shards.select("shard", "attempt", "seq", "first", "docs", "bytes", F.col("seq").alias("run"), F.col("bytes").alias("size"), F.floor(F.col("seq") / LANE).alias("lane"))
    for tier in range(tiers):
        low, high = (0 if tier == 0 else base * fanout**tier), base * fanout ** (tier + 1)
        runs = now.groupBy("lane", "run").agg(F.max("size").alias("size"))  # a run's shards all have its size
        mine = runs.where((F.col("size") >= low) & (F.col("size") < high))
        order = Window.partitionBy("lane").orderBy("run")
        mine = mine.withColumn("upto", F.sum("size").over(order)).withColumn("bin", F.floor((F.col("upto") - F.col("size")) / high))
        bins = Window.partitionBy("lane", "bin")
        mine = mine.withColumn("total", F.sum("size").over(bins)).withColumn("into", F.min("run").over(bins)).withColumn("filled", F.max("upto").over(bins) >= (F.col("bin") + 1) * high)
        moved = mine.where("filled").select("lane", "run", "into", "total")
        now = now.join(moved, ["lane", "run"], "left").withColumn("run", F.coalesce("into", "run")).withColumn("size", F.coalesce("total", "size")).drop("into", "total")
    return now.drop("lane", "size")


def compact(spark: SparkSession, root: str, **policy) -> int:
    """Merge runs of similarly sized shards and commit the result; returns the new version."""
    now, attempt = version(spark, root), uuid.uuid4().hex
    shards = manifest(spark, root, now)
    planned = plan(shards, **policy)
    merged = planned.groupBy(F.floor(F.col("run") / LANE).alias("lane"), "run").agg(F.count(F.lit(1)).alias("parts"), F.min(F.struct("shard", "attempt")).alias("only"), F.min("first").alias("first"), F.sum("docs").alias("docs"), F.sum("bytes").alias("bytes"))
    alone = F.col("parts") == 1
    merged = merged.withColumn("shard", F.when(alone, F.col("only.shard")).otherwise(F.concat(F.lit(f"v{now + 1}-m"), F.format_string("%012d", F.col("run")))))
    merged = merged.withColumn("attempt", F.when(alone, F.col("only.attempt")).otherwise(attempt))
    moves = planned.select("shard", "attempt", "run").join(merged.where("parts > 1").select("run", F.col("shard").alias("new")), "run")
    moves = stored(moves.select(F.col("shard").alias("_shard"), F.col("attempt").alias("_attempt"), F.col("new").alias("_first")), "shard-moves")
    if not moves.isEmpty():
        sources = moves.select(F.col("_attempt").alias("attempt"))
        rows = join_checked(_data(spark, root, sources), moves, ["_shard", "_attempt"])
        _write(rows.drop("_shard", "_attempt").withColumnRenamed("_first", "_shard"), root, attempt)
    return commit(spark, root, merged.select("shard", "attempt", F.col("run").alias("seq"), "first", "docs", "bytes"), now)
