"""Best-fit packing planned on the histogram of lengths; documents take the planned places by their rank within a length."""

from __future__ import annotations

import hashlib
import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import chunks, lean, staged
from logloom.llm.tokens import LOWER_LETTERS, WordEncoder, cut_spaces, plain_of, quiet

CAPACITY = 2048
#: A length's pieces are numbered in hash buckets, one for so many pieces in all, from 32 to MOST_SALTS; counts by length and
#: bucket, at most CAPACITY * MOST_SALTS rows of some 20 bytes, may be broadcast.
PIECES_A_SALT, MOST_SALTS = 1_000_000, 1024

_WORKER: dict[str, WordEncoder] = {}


def _encoder(definition: str) -> WordEncoder:
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _WORKER:
        from tokenizers import Tokenizer

        quiet()
        special = tuple(t["content"].lower() for t in json.loads(definition)["added_tokens"])
        _WORKER.clear()
        _WORKER[key] = WordEncoder(Tokenizer.from_str(definition), plain_of(definition), partial(cut_spaces, special=special), LOWER_LETTERS)
    return _WORKER[key]


def pieces_of(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, and with keep_ids the ids): each text's ids, then end_id, cut every ``capacity`` ids."""
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int64())] if keep_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            for part in chunks(batch, "_text"):
                rows = []
                for i, packed in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    packed += end
                    for k, at in enumerate(range(0, len(packed), 4 * capacity)):
                        piece = packed[at : at + 4 * capacity]
                        rows.append((i, k, at // 4, len(piece) // 4, zlib.crc32(piece), *([np.frombuffer(piece, "<u4").astype(np.int64)] if keep_ids else [])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return rows.mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * keep_ids)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over a histogram {length: count}: rows (length, first rank, n, first sequence, offset).

    The n pieces of that length from the first rank on go to as many consecutive sequences from the first on, at the offset.
    Sequences with equal room are one group, so the work and the rows depend on the lengths there are, not on the counts: a step
    uses up a group or a length, a length opens at most two groups of capacity // length rows each.
    """
    out: list[tuple[int, int, int, int, int]] = []
    groups: dict[int, list[tuple[int, int]]] = {}  # by room left: (first sequence, n)
    rooms: list[int] = []
    opened = 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if not groups.get(room):
                groups[room] = []
                insort(rooms, room)
            groups[room].append((first, n))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not in 1 to {capacity}")
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    rooms.pop(at)
                m = min(n, left)
                out.append((length, rank, m, first, capacity - room))
                put(room, first + m, n - m)
                put(room - length, first, m)
                rank, left = rank + m, left - m
                continue
            each = capacity // length
            for m, k in ((left // each, each), (1, left % each)):
                if m and k:
                    for j in range(k):
                        out.append((length, rank, m, opened, j * length))
                        rank += m
                    put(capacity - k * length, opened, m)
                    opened += m
            left = 0
    return out


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with (sequence_id, offset). ``pieces`` is read several times; it should be a stored table.

    Only the histogram (at most ``capacity`` rows) comes to the driver, and the plan made of it (at most two groups of rows a
    length and step) goes to the tasks. A hot length is numbered in hash buckets, more of them the more pieces there are.
    """
    spark = pieces.sparkSession
    salts = min(MOST_SALTS, max(32, pieces.count() // PIECES_A_SALT))
    salt = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(salts)).cast("int").alias("_salt")
    counted = pieces.groupBy("length", salt).agg(F.count(F.lit(1)).alias("_n"))
    rows = plan({r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("_n").alias("n")).collect()}, capacity)
    bases = counted.withColumn("_base", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).drop("_n")
    w = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("_salt", salt).withColumn("_rank", F.row_number().over(w) - 1)
    ranked = ranked.join(F.broadcast(bases), ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    planned = spark.createDataFrame(rows, "length long, _first long, _m long, _sequence long, offset long")
    ranked = ranked.join(F.broadcast(planned), "length").where((F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_m")))
    return ranked.select(*pieces.columns, (F.col("_sequence") + F.col("_rank") - F.col("_first")).alias("sequence_id"), "offset")


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset), in as few sequences as best fit finds.

    A null text counts as empty: one piece of end_id alone. Only documents longer than ``capacity`` are cut, however long.
    Null ids, repeated rows and ties are packed like others: pieces that are alike in id, place and checksum take their places in
    any order. An empty table gives no rows; more columns are ignored.
    """
    return place(staged(pieces_of(docs, tokenizer_path, id_col, text_col, capacity, end_id, keep_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids) from pack(..., keep_ids=True): a group has at most ``capacity`` ids."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id")))
    grouped = packed.groupBy("sequence_id").agg(inside.alias("_p"))
    return grouped.select("sequence_id", F.flatten(F.col("_p.ids")).alias("ids"), F.col("_p.doc_id").alias("doc_ids"))
