import hashlib
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.llm import media


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=20000))
def test_round_trip(data):
    payload = media.padded(data)
    assert len(payload) % 64 == 0 and payload and payload.startswith(data)
    assert media.examine(media.write_avi(payload))[0] == payload


def test_all_bytes_in_several_frames():
    payload = bytes(range(256)) * 100 + b"\xff" * 640
    avi = media.write_avi(payload)
    frames, rate, length = media.read_avi(avi)
    assert rate == 25 and length == len(payload) and len(frames) == -(-len(payload) // 4096)
    assert media.examine(avi)[0] == payload


def test_general_scan_reads_the_same(monkeypatch):
    blocks = np.frombuffer(np.random.default_rng(0).bytes(64 * 16), np.uint8).reshape(16, 64)
    frame = media.encode_frame(blocks)
    fast, scan = media.decode_frame(frame)[0], media._scan
    monkeypatch.setattr(media, "_scan", lambda data, dc, ac, n, i: scan(data, dc | {(16, 65534): 0}, ac, n, i))
    assert (media.decode_frame(frame)[0] == fast).all()


def test_general_scan_with_runs_and_ends():
    """A block by hand: DC 3 (size 2), two zeros and AC -1 (run 2, size 1), end of block; then DC difference 0 and end of block."""
    dc, ac = {(1, 0): 2, (2, 2): 0}, {(1, 0): 0x21, (2, 2): 0x00}
    bits = "0" + "11" + "0" + "0" + "10" + "10" + "10"
    data = np.array([int(bits.ljust(16, "1")[i : i + 8], 2) for i in (0, 8)], np.uint8)
    out = media._scan(data, dc, ac, 2, 0)
    assert out[0, :5].tolist() == [3, 0, 0, -1, 0] and out[1, 0] == 3 and not out[1, 1:].any()


def test_luma_of_a_flat_block():
    c = np.zeros((1, 64), int)
    c[0, 0] = 80
    assert (media.luma(c, np.ones(64, np.uint8)) == 138).all()


def test_reading_without_an_index():
    avi = media.write_avi(bytes(range(256)) * 64)
    at = avi.index(b"idx1")
    assert media.read_avi(avi[:at])[0] == media.read_avi(avi)[0]


def test_shots():
    a, b = np.eye(4)[0], np.eye(4)[2]
    assert media.shots(np.array([a] * 6 + [b] * 5 + [a] * 3)) == [(0, 5), (6, 10), (11, 13)]
    assert media.shots(np.array([a])) == [(0, 0)] and media.shots(np.zeros((0, 4))) == []


def test_edges(spark, edges, nothing):
    rows = media.media_features(edges, keep_media=True).collect()
    want = Counter()
    for r in edges.collect():
        p = media.padded((r["text"] or "").encode())
        want[r["doc_id"], len((r["text"] or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows) == want
    assert all(r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() for r in rows)
    long = [r for r in rows if r["n_bytes"] > 100_000]
    assert len(long) == 2 and long[0][1:] == long[1][1:] and long[0]["clips"][-1]["end_s"] > 1
    assert media.media_features(nothing).count() == 0
    clips = media.clip_rows(media.media_features(edges)).collect()
    assert len(clips) == sum(len(r["clips"]) for r in rows)
