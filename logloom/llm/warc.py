"""WARC archives: a writer through Spark's text sink, and a salvage reader that recovers from damage."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import chunks, lean

VERSION = b"WARC/1.0\r\n"
MEMBER = b"\x1f\x8b\x08"
#: An empty gzip member. The text sink ends each row with it, which keeps a file of gzip members valid.
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00" + bytes(8)
#: Bytes that a member is read by.
PIECE = 1 << 14
_VERSION_LINE = re.compile(rb"WARC/\d\.\d\r\n")
RECORD = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_length long, payload binary"
GAP = "gap_reason string"
READ_SCHEMA = f"file string, offset long, length long, inner_offset long, inner_length long, {RECORD}, {GAP}"


def base32(data: bytes) -> str:
    return base64.b32encode(data).decode()


def record(record_id: str, kind: str, uri: str, digest: str, payload_length: int, payload: bytes, refers_to: str | None = None) -> bytes:
    """One WARC record with an HTTP block; a revisit's block has no payload. Both kinds carry the full payload's digest and length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_length}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", re.sub(r"[\r\n]", " ", uri)), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(payload_length)), ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).digest())}")]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")]
    fields.append(("Content-Length", str(len(block))))
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 3) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _parse(data: bytes, at: int) -> tuple[dict, int]:
    """The record at ``at`` and its end; ValueError says which check failed. The header may have any length; it is read up to its first bad line."""
    if not (version := _VERSION_LINE.match(data, at)):
        raise ValueError("no version line")
    fields: dict[str, str] = {}
    begin = version.end()
    while (stop := data.find(b"\r\n", begin)) != begin:
        if stop < 0:
            raise ValueError("header without end")
        name, colon, value = data[begin:stop].partition(b":")
        if not colon:
            raise ValueError("header line without colon")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        begin = stop + 2
    begin += 2
    if not re.fullmatch(r"\d{1,18}", length := fields.get("content-length", "")):
        raise ValueError("no content length")
    end = begin + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("block does not end where its length says")
    block = data[begin:end]
    for name, body in (("warc-block-digest", block), ("warc-payload-digest", block.partition(b"\r\n\r\n")[2] if "http" in fields.get("content-type", "") else block)):
        said = fields.get(name, "")
        if said.startswith("sha1:") and not (name == "warc-payload-digest" and fields.get("warc-type") == "revisit") and said[5:].upper() != base32(hashlib.sha1(body).digest()):
            raise ValueError(f"{name} differs")
    strip = lambda k: fields[k].strip("<>") if k in fields else None
    payload = block.partition(b"\r\n\r\n")[2] if "http" in fields.get("content-type", "") else block
    kind = fields.get("warc-type")
    size = fields.get("x-payload-length", "")
    row = {"record_id": strip("warc-record-id"), "record_type": kind, "target_uri": fields.get("warc-target-uri"), "refers_to": strip("warc-refers-to"), "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or base32(hashlib.sha1(payload).digest()), "payload_length": len(payload) if kind != "revisit" or not size.isdigit() else int(size), "payload": payload, "gap_reason": None}
    return row, end + 4


def _member(data: memoryview, at: int) -> tuple[bytes, int]:
    """What the gzip member at ``at`` holds, and its end. Fed in pieces, as zlib copies all that it is given beyond the end."""
    z, out = zlib.decompressobj(31), []
    while not z.eof:
        if at >= len(data):
            raise ValueError("gzip member without end")
        out.append(z.decompress(data[at : at + PIECE]))
        at = min(at + PIECE, len(data))
    return b"".join(out), at - len(z.unused_data)


def _inflated(data: memoryview, at: int, enough: int | None = None) -> tuple[bytes, int]:
    """What the damaged gzip member at ``at`` holds before its error, or the first ``enough`` bytes or some more; and the place up to which that took reading."""
    z, out, size, step = zlib.decompressobj(31), [], 0, PIECE
    while not z.eof and at < len(data) and (enough is None or size < enough):
        before = z.copy() if step > 1 else None
        try:
            got = z.decompress(data[at : at + step])
        except zlib.error:
            got = None
        if got is None or (enough is not None and size + len(got) >= enough):
            # the last piece is read again byte by byte
            if step > 1:
                z, step = before, 1
                continue
            if got is None:
                break
        out.append(got)
        size += len(got)
        at = min(at + step, len(data))
    return b"".join(out), at


def _within(inner: bytes, whole: bool) -> Iterator[dict]:
    """Rows (inner_offset, inner_length, record fields or gap_reason) that cover what a member holds. Where its inflation failed (not ``whole``), a record that nothing follows is not sound."""
    at, gap, why = 0, None, ""
    while at < len(inner):
        try:
            row, end = _parse(inner, at)
            if end == len(inner) and not whole:
                raise ValueError("record at the end of a damaged gzip member")
        except ValueError as e:
            if gap is None:
                gap, why = at, str(e)
            at = p if (p := inner.find(b"WARC/", at + 1)) >= 0 else len(inner)
            continue
        if gap is not None:
            yield {"inner_offset": gap, "inner_length": at - gap, "gap_reason": why}
            gap = None
        yield {"inner_offset": at, "inner_length": end - at} | row
        at = end
    if gap is not None:
        yield {"inner_offset": gap, "inner_length": len(inner) - gap, "gap_reason": why}


def _read(data: bytes, view: memoryview, at: int) -> tuple[list[dict], int, str | None]:
    """Rows from ``at``, the end of the bytes that they stand for, and, if these are the sound beginning of a damaged member, what is wrong behind it. ValueError if no record is sound."""
    if not data.startswith(MEMBER, at):
        row, end = _parse(data, at)
        return [row], end, None
    damage = None
    try:
        inner, end = _member(view, at)
    except (ValueError, zlib.error) as e:
        damage, (inner, end) = str(e), _inflated(view, at)
    rows = list(_within(inner, damage is None))
    sound = [i for i, r in enumerate(rows) if r["gap_reason"] is None]
    if not sound and (rows or damage is not None):
        raise ValueError(damage or rows[0]["gap_reason"])
    if damage is not None:
        rows = rows[: sound[-1] + 1]
        end = _inflated(view, at, rows[-1]["inner_offset"] + rows[-1]["inner_length"])[1]
    return rows, end, damage


def salvage(data: bytes) -> Iterator[dict]:
    """Rows (offset, length, record fields or gap_reason) that cover the archive, plain or of gzip members.

    A record whose checks fail (version line, header, length, digests, gzip checksum) starts a gap; the reader searches byte by
    byte for the next member or version line whose record is sound and goes on there. Every byte is in one record or one gap.

    A member may hold many records. Its rows have its offset and length, and inner_offset and inner_length in what it inflates to.
    In there the search is for version lines: sound records beside failed ones are found, and what is between is an inner gap.
    Where inflation fails, the records inflated before are rows for the member's bytes up to there, and a gap begins behind; but
    the last record inflated is sound only if something follows it, as the failed gzip check may be its own.
    """
    view, at, gap, why = memoryview(data), 0, None, ""
    while at < len(data):
        try:
            rows, end, damage = _read(data, view, at)
        except ValueError as e:
            if gap is None:
                gap, why = at, str(e)
            places = [p for p in (data.find(MEMBER, at + 1), data.find(b"WARC/", at + 1)) if p >= 0]
            at = min(places, default=len(data))
            continue
        if gap is not None:
            yield {"offset": gap, "length": at - gap, "gap_reason": why}
            gap = None
        for row in rows:
            yield {"offset": at, "length": end - at} | row
        at = end
        if damage is not None:
            gap, why = at, damage
            places = [p for p in (data.find(MEMBER, at), data.find(b"WARC/", at)) if p >= 0]
            at = min(places, default=len(data))
    if gap is not None:
        yield {"offset": gap, "length": len(data) - gap, "gap_reason": why}


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_payload: int = 0, file_bytes: int = 16 << 20, gzip: bool = True) -> None:
    """Writes a record per row into archives of at most about ``file_bytes`` of payload each under path, by any file system that Spark writes.

    Of rows with equal payloads of at least ``min_payload`` bytes, those with the smallest id are responses, the others revisit
    it. A null body is an empty payload, a null url an empty target; rows with a null id revisit the smallest id, if any, else
    are responses; rows repeated with the smallest id are responses too. An empty table writes no record; more columns are ignored.
    """
    body = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), body.alias("body"))
    rows = rows.withColumn("sha1", F.sha1("body")).withColumn("key", F.xxhash64("id", "sha1"))
    total = rows.agg(F.sum(F.length("body"))).first()[0] or 0
    # as many partitions as a join has at least: with fewer, the join would deal the bodies anew
    files = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // file_bytes))
    # the narrow side finds each payload's first record; then it meets the bodies, which are shuffled once, into the files' partitions
    narrow = rows.select("id", "sha1", "key", F.length("body").alias("size"))
    first = narrow.where(F.col("size") >= min_payload).groupBy("sha1").agg(F.min("id").alias("first"))
    first = narrow.select("id", "sha1", "key").join(first, "sha1").where("first is not null").groupBy("key", "sha1").agg(F.first("first").alias("first"))
    typed = rows.repartition(files, "key").join(first.repartition(files, "key"), ["key", "sha1"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    typed = typed.select("id", "url", "sha1", F.length("body").cast("long").alias("size"), F.when(revisit, F.lit(b"")).otherwise(F.col("body")).alias("body"), F.when(revisit, F.col("first")).alias("first"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "body"):
                out = []
                for i, url, sha1, size, body, first in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    data = record(f"urn:page:{'' if i is None else i}", "response" if first is None else "revisit", url, base32(bytes.fromhex(sha1)), size, body, None if first is None else f"urn:page:{first}")
                    out.append(gzip_member(data) if gzip else data[:-4])
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    between = EMPTY_MEMBER if gzip else b"\r\n\r\n"
    typed.mapInArrow(lean(build), "value binary").select(F.col("value").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", between.decode("latin-1")).option("compression", "none").text(path)


def read_warc(spark, path: str) -> DataFrame:
    """All records and gaps (READ_SCHEMA) of the archives under path. A row has either record fields or a gap_reason; bytes of gaps stay addressable by (file, offset, length).

    An archive is one task's and has at most 2 GB, as Spark's binary reader takes files whole (write_warc bounds them). Empty
    archives, and a folder without any, give no rows.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held = [], 0
                for row in salvage(content.as_py()):
                    rows.append({"file": path} | row)
                    held += len(row.get("payload") or b"") + 200
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    arrow = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in READ_SCHEMA.split(", "))])
    return files.mapInArrow(lean(parse), READ_SCHEMA)


def page_of(record_id: Column) -> Column:
    """The id in a record id that write_warc gave; null for null."""
    return F.nullif(F.substring_index(record_id, ":", -1), F.lit("")).cast("long")
