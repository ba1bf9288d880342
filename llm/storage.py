"""Shared storage for intermediate tables, and joins that check sizes first."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

#: A side is broadcast only when it has at most so many rows and bytes; beyond
#: either bound the same join shuffles.
BROADCAST_ROWS = 300_000
BROADCAST_BYTES = 24 << 20

#: Bytes of a batch that Spark hands to a Python worker. Batches are held by both
#: sides at once, and 64 MB of long texts (Spark's default) is a worker's whole share.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches in bytes; a longer row is a batch of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's `spark.checkpoint.dir`. Only where that is unset (local
    mode, tests) a temporary folder is made and put into the setting.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="corpus-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to shared storage and read it back: lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_row_key(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only id and text, with a key that equal rows share: extra columns can't clash."""
    return docs.select(
        F.col(id).cast("long").alias("doc_id"),
        F.col(text).cast("string").alias("text"),
        F.xxhash64(F.col(id).cast("long"), F.col(text)).alias("row_key"),
    )


def join_checked(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join with a stored side, broadcast only if its measured rows and bytes are within the bounds.

    A row's bytes are those of its fixed columns, of its strings and binaries, and
    of the items of its arrays.
    """
    width = F.lit(16)
    for field in small.schema:
        width = width + _bytes_of(F.col(field.name), field.dataType)
    n, total = small.agg(F.count(F.lit(1)), F.sum(width)).first()
    if n <= BROADCAST_ROWS and (total or 0) <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), on, how)
    return big.join(small.hint("merge"), on, how)


def _bytes_of(value: Column, kind: DataType) -> Column:
    """Bytes of a value in a joined row: arrays by their length, as their items are of fixed size here."""
    if isinstance(kind, ArrayType):
        item = kind.elementType
        each = 16 + 8 * len(item.fields) if isinstance(item, StructType) else 16
        return F.coalesce(F.size(value), F.lit(0)) * each + 16
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    return F.lit(8)


def lookup(rows: DataFrame, table: DataFrame, on: list[str], uses: str) -> DataFrame:
    """Left join of `rows` with a stored table of unique keys, without a task for all rows of a common key.

    `uses` is a column of `table`: how many of `rows` have the key. Keys that more
    than a hundred-thousandth of the rows have (1,000 rows at least) are at most
    100,000, and join by a broadcast of checked size; the others shuffle. Null keys
    find nothing, as in any join, and stay out of the shuffle.
    """
    rows = rows.select("*")
    total = table.agg(F.sum(uses)).first()[0] or 0
    limit = max(1_000, total // 100_000)
    more = [f for f in table.schema if f.name not in (*on, uses)]
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in more]
    known = F.lit(True)
    for c in on:
        known = known & F.col(c).isNotNull()
    out = rows.where(~known).select(*rows.columns, *none)
    rows = rows.where(known)
    hot = stored(table.where(F.col(uses) > limit).drop(uses), "hot-keys")
    if not hot.isEmpty():
        out = out.unionByName(join_checked(rows, hot, on).select(*rows.columns, *(f.name for f in more)))
        rows = join_checked(rows, hot.select(*on), on, "left_anti")
    cold = table.where(F.col(uses) <= limit).drop(uses)
    return out.unionByName(rows.join(cold, on, "left").select(*rows.columns, *(f.name for f in more)))
