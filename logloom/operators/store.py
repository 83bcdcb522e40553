"""Stored tables: raw lines, events by batch, quarantine. A batch is written once, whatever the number of attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.schemas import EVENT_COLUMNS, RAW_INDEX


def digest(rows: DataFrame, row: Column) -> str:
    """A digest of rows whatever their order, from each row's SHA-256: SHA-256 over their number and the sums of its parts. Empty for no rows."""
    part = lambda i: F.sum(F.conv(F.substring(row, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)"))
    found = rows.agg(F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *[part(i).cast("string") for i in range(5)]).cast("binary"), 256), F.count(F.lit(1))).first()
    return found[0] if found[1] else ""


def batch_id(events: DataFrame) -> str:
    return digest(events, F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(n).cast("string"), F.lit("\0")) for n, _ in EVENT_COLUMNS]).cast("binary"), 256))


def write_events(events: DataFrame, path: str) -> str | None:
    """Adds a batch of the flat event table under path/batch=<digest>; the same rows again replace themselves. Returns the batch's id, None for no rows."""
    kept = events.storageLevel.useMemory or events.storageLevel.useDisk
    rows = events if kept else events.persist()  # they are read for the digest and for the write
    try:
        if not (batch := batch_id(rows)):
            return None
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").option("compression", "zstd").parquet(path)
        return batch
    finally:
        if not kept:
            rows.unpersist()


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def next_sequence(spark: SparkSession, path: str) -> int:
    """The number after the greatest in the raw store; 0 for one that isn't there. (Read from the files' statistics.)"""
    if not exists(spark, path):
        return 0
    top = spark.read.schema(RAW_INDEX).parquet(path).agg(F.max("sequence")).first()[0]
    return 0 if top is None else top + 1


def write_raw(raw: DataFrame, path: str, first_sequence: int | None = None) -> None:
    """Appends raw lines with a running sequence in the order of path and offset, numbered in range partitions, not in one task.

    Numbers go on from the store's greatest, or from ``first_sequence``. One writer at a time.
    """
    spark = raw.sparkSession
    first_sequence = next_sequence(spark, path) if first_sequence is None else first_sequence
    placed = raw.repartitionByRange("path", "byte_offset").sortWithinPartitions("path", "byte_offset").withColumn("_p", F.spark_partition_id())
    placed = placed.withColumn("_i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).persist()
    counts = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_start"))
    file = F.element_at(F.split(F.col("path"), "/"), -1)
    out = placed.join(F.broadcast(starts), "_p").select((F.col("_start") + F.col("_i") + first_sequence).alias("sequence"), "raw_size", "sha256", "source_id", file.alias("source_file"), "byte_offset", "line_no", "raw")
    out.write.mode("append").option("compression", "zstd").parquet(path)
    placed.unpersist()


def write_quarantine(quarantine: DataFrame, path: str) -> str | None:
    """Adds what was set aside under path/batch=<digest>, once: the same rows again replace themselves."""
    row = F.sha2(F.to_json(F.struct(*sorted(quarantine.columns)), {"ignoreNullFields": "false"}).cast("binary"), 256)
    if not (batch := digest(quarantine, row)):
        return None
    quarantine.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
    return batch


def read_record(spark: SparkSession, path: str, source_id: str, byte_offset: int) -> bytes:
    """The exact bytes of a raw line, checked against size and digest."""
    found = spark.read.parquet(path).where((F.col("source_id") == source_id) & (F.col("byte_offset") == byte_offset)).orderBy(F.col("sequence").desc()).select("raw", (F.sha2("raw", 256) == F.col("sha256")).alias("ok"), (F.length("raw") == F.col("raw_size")).alias("sized")).first()
    if found is None:
        raise KeyError("no such record")
    if not (found["ok"] and found["sized"]):
        raise ValueError("raw record is damaged")
    return bytes(found["raw"])
