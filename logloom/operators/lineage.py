"""Lineage: events joined with the raw lines that they came from, and checks of the raw store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["source_id", "byte_offset", "line_no"]


def latest(raw_index: DataFrame) -> DataFrame:
    """Per key the row with the greatest sequence, found among keys and sequences alone; a sequence is one row's."""
    top = raw_index.groupBy(*KEY).agg(F.max("sequence").alias("sequence"))
    return raw_index.join(top, [*KEY, "sequence"], "left_semi")


def trace(events: DataFrame, raw_index: DataFrame) -> DataFrame:
    """Flat events with their raw line: found, hash_ok (of the stored bytes, the index and the event) and text_ok. Left join: events without a line stay."""
    raw = latest(raw_index).select(*KEY, F.col("sequence").alias("raw_sequence"), F.col("sha256").alias("_sha"), F.col("raw").alias("_raw"))
    joined = events.join(raw, KEY, "left")
    return joined.withColumn("found", F.col("_sha").isNotNull()).withColumn("hash_ok", F.coalesce((F.sha2("_raw", 256) == F.col("_sha")) & (F.col("_sha") == F.col("raw_sha256")), F.lit(False))).withColumn("text_ok", F.coalesce(F.col("_raw") == F.col("raw").cast("binary"), F.lit(False))).drop("_sha", "_raw")


def trace_event(events: DataFrame, raw_index: DataFrame, event_id: str) -> DataFrame:
    """The first event of an id, traced."""
    return trace(events.where(F.col("event_id") == event_id).orderBy("ingest_time").limit(1), raw_index)


def orphans(events: DataFrame, raw_index: DataFrame) -> DataFrame:
    """Events without a raw line."""
    return events.join(raw_index.select(*KEY), KEY, "left_anti")


def verify_store(raw_index: DataFrame) -> DataFrame:
    """(sequence, error) for each fault: a gap or repeat in the sequence, bytes that differ from size or digest, offsets of a source that leave a gap.

    The expected sequence is min + rank: a gap shows as a step other than 1 to the row before, found by range neighbours.
    """
    steps = raw_index.select("sequence", F.explode(F.array(F.col("sequence"), F.col("sequence") + 1)).alias("_edge"))
    ends = steps.groupBy("_edge").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("sequence") == F.col("_edge")).alias("_starts"))
    low = raw_index.agg(F.min("sequence").alias("_low"))
    gaps = ends.join(F.broadcast(low)).where((F.col("_starts") > 1) | ((F.col("_starts") == 1) & (F.col("_n") == 1) & (F.col("_edge") != F.col("_low")))).select(F.col("_edge").alias("sequence"), F.lit("sequence gap or repeat").alias("error"))
    damaged = raw_index.where((F.sha2("raw", 256) != F.col("sha256")) | (F.length("raw") != F.col("raw_size"))).select("sequence", F.lit("bytes differ from size or digest").alias("error"))
    w = Window.partitionBy("source_id").orderBy("byte_offset")
    breaks = latest(raw_index).withColumn("_end", F.lag(F.col("byte_offset") + F.col("raw_size")).over(w)).where(F.coalesce(F.col("_end"), F.lit(0)) != F.col("byte_offset")).select("sequence", F.lit("offsets leave a gap").alias("error"))
    return gaps.unionByName(damaged).unionByName(breaks)
