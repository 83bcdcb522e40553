"""Ingestion of a folder as a stream: each micro-batch of files goes through the batch flow and is stored once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from logloom.operators.ingest import ingest_lines
from logloom.operators.store import write_events
from logloom.sources.lines import split_lines


def files_stream(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_a_batch).load(folder)


def ingest_stream(spark: SparkSession, folder: str, events_path: str, quarantine_path: str, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None, **options) -> StreamingQuery:
    """Events by batch digest, so that a batch that runs again replaces itself; quarantine overwrites its own batch folder for the same reason."""

    def one(files: DataFrame, number: int) -> None:
        files = files.persist()
        made = ingest_lines(split_lines(files.select("path", "content")), **options)
        flat = made.flat().persist()
        write_events(flat, events_path)
        made.quarantine.write.mode("overwrite").parquet(f"{quarantine_path}/batch={number}")
        if after:
            after(flat, number)
        flat.unpersist()
        files.unpersist()

    return files_stream(spark, folder).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
