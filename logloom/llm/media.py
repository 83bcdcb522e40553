"""Media columns: payloads as AVI motion-JPEG, read back through the RIFF index; shots by adaptive histogram differences; timed clips.

The stored unit is the quantised DCT coefficient, which JPEG keeps exactly. Every coefficient has size category 8, whose eight
extra bits are the payload's byte, so that both Huffman tables have one code of one bit; a restart after each block keeps DC
differences independent. Any baseline decoder reads the frames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import chunks, lean

#: Blocks of 8 x 8 a row, the most rows of a frame, frames a second.
ACROSS, DOWN, FPS = 8, 8, 25
#: Bins of a luma histogram; neighbours on either side, deviations and least difference of the adaptive threshold.
BINS, REACH, DEVIATIONS, LEAST = 32, 5, 2.0, 0.2
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
_DCT = np.array([[np.sqrt((1 if k == 0 else 2) / 8) * np.cos((2 * x + 1) * k * np.pi / 16) for x in range(8)] for k in range(8)])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman(kind: int, symbol: int) -> bytes:
    return _segment(0xC4, bytes([kind, 1, *[0] * 15, symbol]))


def encode_frame(blocks: np.ndarray) -> bytes:
    """A grey baseline JPEG whose coefficients, in zigzag order, hold the bytes of the blocks (n, 64); n is a multiple of ACROSS."""
    n = len(blocks)
    head = b"\xff\xd8" + _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC0, struct.pack(">BHHB3B", 8, 8 * n // ACROSS, 8 * ACROSS, 1, 1, 0x11, 0))
    head += _huffman(0x00, 8) + _huffman(0x10, 8) + _segment(0xDD, b"\0\1") + _segment(0xDA, b"\1\1\0\0\x3f\0")
    bits = np.zeros((n, 64, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(blocks, axis=1).reshape(n, 64, 8)
    coded = np.zeros((n, 74), np.uint8)
    coded[:, :72] = np.packbits(bits.reshape(n, 576), axis=1)
    coded[:, 72], coded[:, 73] = 0xFF, 0xD0 + np.arange(n) % 8
    stuffed = coded == 0xFF
    stuffed[:, 72] = False
    flat = coded.ravel()
    places = np.arange(flat.size) + np.concatenate(([0], np.cumsum(stuffed.ravel())[:-1]))
    out = np.zeros(flat.size + int(stuffed.sum()), np.uint8)
    out[places] = flat
    return head + out[:-2].tobytes() + b"\xff\xd9"


def _tables(body: bytes) -> Iterator[tuple[int, dict[tuple[int, int], int]]]:
    """Of a DHT segment: table class and number, {(length, code): symbol}."""
    at = 0
    while at < len(body):
        kind, counts = body[at], body[at + 1 : at + 17]
        at, code, table = at + 17, 0, {}
        for length, count in enumerate(counts, 1):
            for _ in range(count):
                table[length, code] = body[at]
                at, code = at + 1, code + 1
            code <<= 1
        yield kind, table


def _scan(data: np.ndarray, dc: dict, ac: dict, n: int, interval: int) -> np.ndarray:
    """Coefficients (n, 64) in zigzag order of a scan with one component, by its Huffman tables."""
    ff = np.flatnonzero(data[:-1] == 0xFF)
    after = data[ff + 1]
    marks = ff[(after >= 0xD0) & (after <= 0xD7)]
    drop = np.zeros(len(data), bool)
    drop[ff[after == 0] + 1] = True
    drop[marks] = drop[marks + 1] = True
    if dc == ac == {(1, 0): 8} and interval == 1:  # the tables that encode_frame writes
        pure = data[~drop]
        if len(pure) != 72 * n or len(marks) != n - 1:
            raise ValueError("scan of another length")
        bits = np.unpackbits(pure.reshape(n, 72), axis=1).reshape(n, 64, 9)
        if bits[:, :, 0].any():
            raise ValueError("a code that isn't in the table")
        value = np.packbits(bits[:, :, 1:].reshape(n, 512), axis=1).astype(np.int32)
        return np.where(value >= 128, value, value - 255)
    out = np.zeros((n, 64), np.int32)
    edges = [0, *(marks + 2).tolist(), len(data)]
    block = 0
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        part = data[a:b][~drop[a:b]]
        bits, at, last = np.unpackbits(part).tolist(), 0, 0

        def symbol(table: dict) -> int:
            nonlocal at
            code = 0
            for length in range(1, 17):
                code = code << 1 | bits[at]
                at += 1
                if (length, code) in table:
                    return table[length, code]
            raise ValueError("a code that isn't in the table")

        def extra(size: int) -> int:
            nonlocal at
            value = 0
            for bit in bits[at : at + size]:
                value = value << 1 | bit
            at += size
            return value if not size or value >> (size - 1) else value - (1 << size) + 1

        for _ in range(interval or n):
            if block == n:
                break
            try:
                last += extra(symbol(dc))
                out[block, 0], k = last, 1
                while k < 64:
                    run, size = divmod(symbol(ac), 16)
                    if size == 0 and run < 15:
                        break
                    k += run
                    if size:
                        out[block, k] = extra(size)
                    k += 1
            except IndexError:
                raise ValueError("scan ends early") from None
            block += 1
    return out


def decode_frame(data: bytes) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Of a baseline JPEG with one component: coefficients (n, 64) in zigzag order as stored, the quantisers, height and width."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, quant, tables, interval, shape = 2, {}, {}, 0, None
    while True:
        if data[at] != 0xFF:
            raise ValueError("no marker")
        marker, (length,) = data[at + 1], struct.unpack_from(">H", data, at + 2)
        body, at = data[at + 4 : at + 2 + length], at + 2 + length
        if marker == 0xDB:
            for i in range(0, len(body), 65):
                quant[body[i] & 15] = np.frombuffer(body[i + 1 : i + 65], np.uint8)
        elif marker == 0xC4:
            tables |= dict(_tables(body))
        elif marker == 0xDD:
            (interval,) = struct.unpack(">H", body)
        elif marker in (0xC0, 0xC1):
            bits, height, width, parts = struct.unpack_from(">BHHB", body)
            if (bits, parts) != (8, 1):
                raise ValueError("only grey frames of 8 bits")
            shape = height, width, body[8]
        elif marker == 0xDA:
            break
    if shape is None:
        raise ValueError("no frame header")
    height, width, q = shape
    n = -(-height // 8) * -(-width // 8)
    end = data.rfind(b"\xff\xd9")
    coefficients = _scan(np.frombuffer(data[at:end], np.uint8), tables[body[2] >> 4], tables[0x10 | body[2] & 15], n, interval)
    return coefficients, quant[q], height, width


def luma(coefficients: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """Samples (n, 8, 8) from 0 to 255."""
    square = np.zeros((len(coefficients), 64))
    square[:, ZIGZAG] = coefficients * quant.astype(np.int32)
    samples = _DCT.T @ square.reshape(-1, 8, 8) @ _DCT + 128
    return np.clip(np.rint(np.round(samples, 6)), 0, 255).astype(np.uint8)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(payload: bytes) -> bytes:
    """An AVI whose frames hold the payload, a positive multiple of 64 bytes; its length is in the INFO list, as frames are filled with zeros."""
    blocks = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    rows = min(DOWN, -(-len(blocks) // ACROSS))
    each = rows * ACROSS
    fill = -len(blocks) % each
    if fill:
        blocks = np.concatenate((blocks, np.zeros((fill, 64), np.uint8)))
    frames = [encode_frame(blocks[i : i + each]) for i in range(0, len(blocks), each)]
    most = max(map(len, frames))
    movi, index = [], []
    at = 4
    for f in frames:
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        movi.append(_chunk(b"00dc", f))
        at += len(movi[-1])
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, 8 * ACROSS, 8 * rows, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, 10000, 0, 0, 0, 8 * ACROSS, 8 * rows)
    strf = struct.pack("<IiiHH4sIiiII", 40, 8 * ACROSS, 8 * rows, 1, 24, b"MJPG", 64 * ACROSS * rows * 3, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", f"payload_bytes={len(payload)}\0".encode()))
    return _chunk(b"RIFF", b"AVI " + header + info + _chunk(b"LIST", b"movi" + b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def _chunks_of(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        name, (size,) = data[at : at + 4], struct.unpack_from("<I", data, at + 4)
        if at + 8 + size > end:
            raise ValueError("a chunk is longer than what holds it")
        yield name, at + 8, size
        at += 8 + size + size % 2


def read_avi(data: bytes) -> tuple[list[bytes], float, int | None]:
    """Frames by the RIFF index (by their order in movi if there is none), frames a second, and the payload's length if it is told."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI")
    rate, length, movi, entries = float(FPS), None, None, None
    for name, at, size in _chunks_of(data, 12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])):
        kind = data[at : at + 4] if name == b"LIST" else b""
        if kind == b"hdrl":
            for n2, a2, _ in _chunks_of(data, at + 4, at + size):
                if n2 == b"avih" and (us := struct.unpack_from("<I", data, a2)[0]):
                    rate = 1e6 / us
        elif kind == b"INFO":
            for n2, a2, s2 in _chunks_of(data, at + 4, at + size):
                told = data[a2 : a2 + s2].rstrip(b"\0").partition(b"payload_bytes=")[2]
                if n2 == b"ICMT" and told.isdigit():
                    length = int(told)
        elif kind == b"movi":
            movi = at, size
        elif name == b"idx1":
            entries = [struct.unpack_from("<4sIII", data, at + i) for i in range(0, size - 15, 16)]
    if movi is None:
        raise ValueError("no movi list")
    if entries is None:
        return [data[a : a + s] for n, a, s in _chunks_of(data, movi[0] + 4, movi[0] + movi[1]) if n[2:] == b"dc"], rate, length
    base = movi[0] if data[movi[0] + entries[0][2] : movi[0] + entries[0][2] + 4] == entries[0][0] else 0  # offsets count from movi, or from the file's start
    return [data[base + at + 8 : base + at + 8 + size] for name, _, at, size in entries if name[2:] == b"dc"], rate, length


def shots(histograms: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) frames of the shots. A cut is where consecutive histograms differ by more than the mean and some deviations of the differences nearby."""
    n = len(histograms)
    difference = np.abs(np.diff(histograms, axis=0)).sum(axis=1) / 2
    cuts = [0]
    for i, d in enumerate(difference):
        near = np.delete(difference[max(0, i - REACH) : i + REACH + 1], min(i, REACH))
        bound = near.mean() + DEVIATIONS * near.std() if len(near) else 0.0
        if d > max(LEAST, bound):
            cuts.append(i + 1)
    return [(a, b - 1) for a, b in zip(cuts, [*cuts[1:], n], strict=True)] if n else []


def examine(media: bytes) -> tuple[bytes, list[tuple[int, int]], float, list[int]]:
    """The payload, the shots, frames a second, and each frame's mean luma, all from the stored bytes."""
    frames, rate, length = read_avi(media)
    stored, histograms, means = [], [], []
    for f in frames:
        coefficients, quant, _, _ = decode_frame(f)
        stored.append((coefficients + np.where(coefficients < 0, 255, 0)).astype(np.uint8).tobytes())
        samples = luma(coefficients, quant)
        histograms.append(np.bincount(samples.ravel() >> 3, minlength=BINS) / samples.size)
        means.append(int(samples.sum(dtype=np.int64) // samples.size))
    return b"".join(stored)[:length], shots(np.array(histograms)), rate, means


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 or (64 if not text else 0))


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """One row per row of docs: (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, clips[, media]).

    payload_sha256, tail_crc32, feature and clips (first and last frame, start and end in seconds, mean luma) come from reading
    the stored bytes. A null text counts as empty: 64 zero bytes; very long ones become more frames. Repeated rows and ties are
    alike; an empty table gives no rows; more columns are ignored.
    """
    clip = pa.struct([("first_frame", pa.int32()), ("last_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("mean_luma", pa.int32())])
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(clip), *([pa.binary()] if keep_media else [])]
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips", *(["media"] if keep_media else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "_text"):
                rows = []
                for text in part.column(1).to_pylist():
                    media = write_avi(padded(text))
                    back, found, rate, means = examine(media)
                    clips = [{"first_frame": a, "last_frame": b, "start_s": round(a / rate, 3), "end_s": round((b + 1) / rate, 3), "mean_luma": sum(means[a : b + 1]) // (b + 1 - a)} for a, b in found]
                    feature = f"frames={len(means)};clips=" + ",".join(f"{c['start_s']:.3f}-{c['end_s']:.3f}@{c['mean_luma']}" for c in clips)
                    rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, clips, *([media] if keep_media else [])))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=["doc_id", *names])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"))
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips array<struct<first_frame:int,last_frame:int,start_s:double,end_s:double,mean_luma:int>>"
    return rows.mapInArrow(lean(run), schema + ", media binary" * keep_media)


def clip_rows(features: DataFrame) -> DataFrame:
    """A row per clip: (doc_id, clip, first_frame, last_frame, start_s, end_s, mean_luma)."""
    return features.select("doc_id", F.posexplode("clips").alias("clip", "_c")).select("doc_id", "clip", "_c.*")
