"""Byte-exact scan of log files: lines with their offsets, oversized ones in chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_LINE_BYTES = 65_536
#: Splits whose beginnings are broadcast, a row of some 100 bytes each; with more, Spark joins them as it sees fit.
MOST_SPLITS = 500_000


def source_id(path: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the path, without the URI scheme."""
    return F.substring(F.sha2(F.regexp_replace(path, r"\A[a-z][a-z0-9+.-]*:(//[^/]*)?(?=/)", "").cast("binary"), 256), 1, 16)


def split_lines(files: DataFrame, path: str = "path", content: str = "content", max_line_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    """(path, source_id, line_no, byte_offset, raw, chunk, oversized): a row per line, or per chunk of a line over max_line_bytes.

    Lines end at \\n only and keep their ends; line numbers count from 1, offsets from 0. Bytes pass through ISO-8859-1, which
    keeps each as one character. An empty file has no lines.
    """
    text = F.decode(F.col(content), "ISO-8859-1")
    lines = files.select(F.col(path).alias("path"), F.posexplode(F.regexp_extract_all(text, F.lit("[^\n]*\n|[^\n]+"), F.lit(0))).alias("_at", "_line"))
    before = Window.partitionBy("path").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("_start", F.coalesce(F.sum(F.length("_line").cast("bigint")).over(before), F.lit(0)).cast("bigint"))
    chunk = F.explode(F.sequence(F.lit(0), F.floor((F.length("_line") - 1) / max_line_bytes).cast("int")))
    lines = lines.withColumn("chunk", chunk)
    piece = F.substring(F.col("_line"), F.col("chunk") * max_line_bytes + 1, F.lit(max_line_bytes))
    return lines.select("path", source_id(F.col("path")).alias("source_id"), (F.col("_at") + 1).cast("bigint").alias("line_no"), (F.col("_start") + F.col("chunk") * max_line_bytes).alias("byte_offset"), F.encode(piece, "ISO-8859-1").alias("raw"), "chunk", (F.length("_line") > max_line_bytes).alias("oversized"))


def _most_splits(spark: SparkSession, files: DataFrame) -> int:
    """No fewer splits than Spark reads these files in, by its settings and the files' sizes."""
    conf = spark._jsparkSession.sessionState().conf()
    size = int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    each = min(conf.filesMaxPartitionBytes(), max(conf.filesOpenCostInBytes(), size // spark.sparkContext.defaultParallelism))
    return size // max(1, each) + len(files.inputFiles())


def read_lines(spark: SparkSession, path: str | list[str], max_line_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    """The lines of all files under the path, as split_lines gives them; of files of any size, which Spark reads in splits.

    The text reader deals each line to the split that it begins in. A task numbers the lines of its splits as they come, by byte
    and by line; where each split begins follows from the sums of those before, a row per split. Lines are not shuffled. The last
    line of a file has an end if the lines' bytes, ends included, are as many as the file's. Files are read as they are: ones that
    a codec would decompress are refused.
    """
    known = spark.read.option("lineSep", "\n").option("encoding", "UTF-8").text(path)
    at = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.file_size").alias("file_size"))
    rows = known.select(at.alias("_at"), F.col("value").cast("binary").alias("_line")).select("_at.*", "_line")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[tuple, tuple[int, int]] = {}  # of each split: its bytes and lines so far
        for batch in batches:
            size = pc.add(pc.cast(pc.binary_length(batch.column(3)), pa.int64()), 1).to_numpy(zero_copy_only=False)
            paths, splits = pc.run_end_encode(batch.column(0)), pc.run_end_encode(batch.column(1))
            cuts = np.union1d(np.asarray(paths.run_ends), np.asarray(splits.run_ends))
            offset, line, start = np.empty(len(size), np.int64), np.empty(len(size), np.int64), 0
            for cut in cuts.tolist():
                key = batch.column(0)[start].as_py(), batch.column(1)[start].as_py()
                bytes_, lines_ = ends.get(key, (0, 0))
                total = np.cumsum(size[start:cut])
                offset[start:cut] = bytes_ + total - size[start:cut]
                line[start:cut] = lines_ + np.arange(cut - start)
                ends = {key: (bytes_ + int(total[-1]), lines_ + cut - start)}
                start = cut
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(offset), pa.array(line)], names=["path", "split", "file_size", "_line", "_offset", "_no"])

    numbered = rows.mapInArrow(number, "path string, split bigint, file_size bigint, _line binary, _offset bigint, _no bigint")
    # (lengths alone: the column of lines is read, but not kept)
    sums = rows.groupBy("path", "split", "file_size").agg(F.sum(F.octet_length("_line") + 1).cast("bigint").alias("_bytes"), F.count(F.lit(1)).alias("_lines"))
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    starts = sums.select(
        F.col("path").alias("_path"), F.col("split").alias("_split"), F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_first"), F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_before"),
        F.sum("_bytes").over(whole).alias("_whole"), F.sum("_lines").over(whole).alias("_all"),
    )
    starts = F.broadcast(starts) if _most_splits(spark, known) <= MOST_SPLITS else starts
    lines = numbered.join(starts, (F.col("path") == F.col("_path")) & (F.col("split") == F.col("_split")))
    wrong = (F.col("_whole") != F.col("file_size")) & (F.col("_whole") != F.col("file_size") + 1)
    open_end = (F.col("_whole") == F.col("file_size") + 1) & (F.col("_before") + F.col("_no") + 1 == F.col("_all"))
    raw = F.when(wrong, F.raise_error(F.concat(F.lit("compressed, or changed while it was read: "), F.col("path"))).cast("binary")).when(open_end, F.col("_line")).otherwise(F.concat("_line", F.lit(b"\n")))
    plain = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), r"\Afile:/+", "file:/")
    lines = lines.select(plain.alias("path"), (F.col("_before") + F.col("_no") + 1).cast("bigint").alias("line_no"), (F.col("_first") + F.col("_offset")).cast("bigint").alias("_start"), raw.alias("_raw"))
    chunk = F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("_raw") - 1) / max_line_bytes).cast("int")))
    lines = lines.withColumn("chunk", chunk)
    piece = F.substring(F.col("_raw"), F.col("chunk") * max_line_bytes + 1, F.lit(max_line_bytes))
    return lines.select("path", source_id(F.col("path")).alias("source_id"), "line_no", (F.col("_start") + F.col("chunk") * max_line_bytes).alias("byte_offset"), piece.alias("raw"), "chunk", (F.octet_length("_raw") > max_line_bytes).alias("oversized"))


def byte_lines(text: Column) -> Column:
    """An array of the lines as Python's bytes.splitlines gives them: \\n, \\r and \\r\\n end lines, empty ones are kept."""
    parts = F.split(text, "\r\n|[\n\r]")
    return F.when(text == "", F.array().cast("array<string>")).when(text.rlike(r"[\r\n]\z"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
