"""Shared helpers: scratch tables in the cluster's shared folder, membership filters of bounded size, vectorised word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of one bitmap that bitmap_construct_agg builds.
BITMAP_BITS = 32768
#: Upper bound of the text bytes that a Python worker handles at once.
CHUNK_BYTES = 1 << 20
#: Upper bound of the bytes that pass to a Python worker at once; Spark's own is 64 MB.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one beside the warehouse (a temporary folder only in local mode)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
            base = "file://" + tempfile.mkdtemp(prefix="logloom-")
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read back, so that lost executors repeat only later work."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that are no longer used, which it does when the driver collects garbage: for loops with many small shuffles."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


#: Bits of a filter for each key, and the most bits (32 MB) of a filter that is broadcast.
KEY_BITS, MOST_LOG2_BITS = 8, 28


def filter_bits(keys: int) -> int:
    """The binary logarithm of a filter's bits for so many keys."""
    return min(MOST_LOG2_BITS, max(15, (KEY_BITS * max(1, keys) - 1).bit_length()))


def membership_filter(keys: DataFrame, key: str, log2_bits: int) -> DataFrame:
    """A filter of 2**log2_bits bits over the 64-bit column ``key``: rows (slice, bits), at most 2**(log2_bits - 15) of 4 KiB.

    With filter_bits of the number of keys it has KEY_BITS bits a key up to 2**MOST_LOG2_BITS in all, so it may be broadcast. It
    lets through every key and some others.
    """
    slot = F.pmod(F.col(key), F.lit(1 << log2_bits))
    slots = keys.select(F.shiftright(slot, 15).cast("int").alias("_slice"), slot.bitwiseAND(F.lit(BITMAP_BITS - 1)).alias("_bit"))
    return slots.groupBy("_slice").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def maybe(rows: DataFrame, key: str, filt: DataFrame, log2_bits: int, into: str) -> DataFrame:
    """rows with the boolean column ``into``: whether ``key`` may be in the filter, which is broadcast."""
    slot = F.pmod(F.col(key), F.lit(1 << log2_bits))
    out = rows.withColumns({"_slice": F.shiftright(slot, 15).cast("int"), "_bit": slot.bitwiseAND(F.lit(BITMAP_BITS - 1)).cast("int")})
    out = out.join(F.broadcast(filt), "_slice", "left")
    byte = "cast(conv(hex(substring(_bits, _bit div 8 + 1, 1)), 16, 10) as int)"
    return out.withColumn(into, F.expr(f"_bits is not null and (shiftright({byte}, _bit % 8) & 1) = 1")).drop("_slice", "_bit", "_bits")


def probe(rows: DataFrame, key: str, filt: DataFrame, log2_bits: int) -> DataFrame:
    """The rows whose ``key`` may be in the filter."""
    return maybe(rows, key, filt, log2_bits, "_maybe").where("_maybe").drop("_maybe")


def give_back() -> None:
    """Lets unused memory go."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, which at the end of each task gives unused memory back: Spark's Python workers live on between tasks and stages."""

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return ended


def small_batches(spark: SparkSession) -> None:
    """From now on the session passes rows to Python in batches of at most BATCH_BYTES (or a single row); a smaller bound that it has stays.

    An executor holds a batch several times for each task: as vectors, which double as they grow, as a message and in the worker.
    Results don't depend on it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    found = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < found <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch whose texts have at most ``most`` bytes together (or a single row)."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(column))
    ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


#: Separators between words in texts: U+0020 and U+0009 to U+000D.
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Longer words are hashed one by one.
LONG_WORD = 64
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, in order, and each text's first index (one more at the end). Words are runs without ASCII white space.

    A word is hashed by eight bytes after the other, each mixed by mix64, which isn't linear in any arithmetic that texts could
    be patterned after; words over LONG_WORD bytes by BLAKE2.
    """
    raw = np.frombuffer(b"\n".join(texts) + b"\n" + bytes(8), np.uint8)[:-8]
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    letters = np.zeros(len(raw) + 8, np.uint8)
    letters[:-8] = _LOWER[raw] if lower else raw
    eight = np.ndarray((len(raw),), "<u8", letters, 0, (1,))  # the eight bytes from each place on
    size = ends - starts
    h = size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    at = np.flatnonzero(size <= LONG_WORD)
    done = 0
    while len(at):
        block = eight[starts[at] + done] & _BYTES[np.minimum(size[at] - done, 8)]
        h[at] = mix64((h[at] ^ block) * np.uint64(0x9FB21C651E98DF25) + np.uint64(0x9E3779B97F4A7C15))
        done += 8
        at = at[size[at] > done]
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(letters[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    first = np.concatenate(([0], np.searchsorted(starts, np.cumsum(lengths))))
    return h, first
