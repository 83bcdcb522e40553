"""Sharding by a Feistel permutation with cycle walking over global row numbers (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import staged

#: Rows are numbered within so many hash buckets; their counts, of this fixed number, may be broadcast.
BUCKETS = 4096
#: Steps of the cycle walk that every row can take before the exact walk of any length.
STEPS = 4
#: Copies of one row that are expanded by one task at once.
PART = 1_000_000


def feistel(x: Column, side: int, keys: list[int]) -> Column:
    """A permutation of 0 .. side**2 - 1: balanced Feistel rounds on the two digits of x to the base ``side``."""
    start = F.struct(F.floor(x / side).cast("long").alias("l"), F.pmod(x, F.lit(side)).cast("long").alias("r"))
    start = F.struct(F.expr("0L").alias("l"), F.expr("0L").alias("r")) if side == 1 else start
    turned = F.aggregate(
        F.array(*[F.lit(k).cast("long") for k in keys]),
        start,
        lambda acc, k: F.struct(acc["r"].alias("l"), F.pmod(acc["l"] + F.pmod(F.xxhash64(k, acc["r"]), F.lit(side)), F.lit(side)).cast("long").alias("r")),
        lambda acc: acc["l"] * side + acc["r"],
    )
    return turned


def permuted(df: DataFrame, number: str, n: int, seed: int, out: str) -> DataFrame:
    """df with column ``out``: the permuted place, below n, of row ``number``.

    The domain is the least square of at least n; a place of n or more is permuted again (cycle walking). A cycle meets each
    place outside at most once, so side**2 - n + 1 steps always suffice; almost every row needs one.
    """
    side = max(1, math.isqrt(max(n, 1) - 1) + 1)
    keys = [seed * 1_000_003 + i for i in range(4)]
    step = lambda c: feistel(c, side, keys)
    df = df.withColumn(out, step(F.col(number)))
    for _ in range(min(STEPS, side * side - n)):
        df = df.withColumn(out, F.when(F.col(out) < n, F.col(out)).otherwise(step(F.col(out))))
    if (rest := side * side - n - STEPS) > 0:
        walk = F.aggregate(F.sequence(F.lit(1), F.lit(rest)), F.col(out), lambda acc, _: F.when(acc < n, acc).otherwise(step(acc)))
        df = df.withColumn(out, F.when(F.col(out) < n, F.col(out)).otherwise(walk))
    return df


def assign_shards(docs: DataFrame, n_shards: int = 40, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, buckets: int = BUCKETS) -> DataFrame:
    """One row per row of docs: (id, size, text_crc32, row_number, position, shard, slot). Law ``rows``: counts differ by at most one.

    A row's number is its rank by (hash bucket, id, size, text_crc32), whatever the files' layout, so the shuffle is reproducible;
    the bucket is of all three, so that many rows without an id, or with one, are spread. position is its Feistel image, shard =
    position mod n_shards and slot = position div n_shards, gapless from 0. Only these narrow columns are shuffled, never texts.
    Equal rows are counted before the shuffle and expanded after it, very many of them in parts.

    Null ids are one more id; a null text counts as empty (size ``overhead``, crc32 0), very long ones are taken whole. Repeated
    rows get places of their own; an empty table gives no rows; other columns, whatever their names, are ignored. The law spreads
    equal texts like any others.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    rows = rows.select("doc_id", (F.octet_length("_t").cast("long") + overhead).alias("size"), F.crc32(F.col("_t").cast("binary")).cast("long").alias("text_crc32"))
    own = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(buckets)).cast("int"))
    own = staged(own, "rows")
    counts = own.groupBy("_b").agg(F.sum("_n").alias("_n"), F.max("_n").alias("_most"))
    total, most = counts.agg(F.sum("_n"), F.max("_most")).first()
    starts = counts.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_start"))
    w = Window.partitionBy("_b").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("_end", F.sum("_n").over(w)).join(F.broadcast(starts), "_b").withColumn("_from", F.lit(0).cast("long"))
    if (most or 0) > PART:
        own = own.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(PART).cast("long")))).repartition("_b", "_from")
    own = own.withColumn("_copy", F.explode(F.sequence(F.col("_from"), F.least(F.col("_n"), F.col("_from") + PART) - 1)))
    own = own.withColumn("row_number", F.col("_start") + F.col("_end") - F.col("_n") + F.col("_copy"))
    own = permuted(own, "row_number", int(total or 0), seed, "position")
    return own.select("doc_id", "size", "text_crc32", "row_number", "position", F.pmod("position", F.lit(n_shards)).cast("int").alias("shard"), F.floor(F.col("position") / n_shards).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 40, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes docs as Parquet under path, partitioned by shard and sorted by slot within each; returns what was written.

    Rows of the same id, size and crc32 take their places in the order of hashes of all their columns. Columns that clash with shard or slot are replaced.
    """
    places = assign_shards(docs, n_shards, seed, id_col, text_col)
    same = ["_id", "_size", "_crc"]
    w = Window.partitionBy(*same).orderBy("position")
    places = places.select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), F.col("text_crc32").alias("_crc"), "position", "shard", "slot")
    places = places.withColumn("_k", F.row_number().over(w)).drop("position")
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(*[c for c in docs.columns if c not in ("shard", "slot")]).alias("_row"), F.col(id_col).alias("_id"), (F.octet_length(t).cast("long") + 16).alias("_size"), F.crc32(t.cast("binary")).cast("long").alias("_crc"))
    # by the whole row, so that a task that runs again deals them alike; rows that are equal in all columns are one to the other
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*same).orderBy(F.xxhash64("_row"), F.to_json("_row"))))
    on = rows["_id"].eqNullSafe(places["_id"]) & (rows["_size"] == places["_size"]) & (rows["_crc"] == places["_crc"]) & (rows["_k"] == places["_k"])
    out = rows.join(places, on).select("_row.*", "shard", "slot")
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)
