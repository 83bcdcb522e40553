import base64
import hashlib
import random
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.llm.warc import EMPTY_MEMBER, gzip_member, page_of, read_warc, record, salvage, write_warc


def _record(i, body=b"<p>hello</p>", kind="response"):
    return record(f"urn:page:{i}", kind, f"http://x/{i}", base64.b32encode(hashlib.sha1(body).digest()).decode(), len(body), body)


def _ids(data):
    return [r.get("record_id") for r in salvage(data)]


def _covers(data):
    at = 0
    for r in salvage(data):
        if r["offset"] == at - 0 and r["length"] == 0:
            continue
        assert r["offset"] in (at, at)
        at = r["offset"] + r["length"]
    assert at == len(data)


def test_plain_and_members():
    records = [_record(i, b"x" * i) for i in range(5)]
    for data in (b"".join(records), b"".join(map(gzip_member, records)), EMPTY_MEMBER.join(map(gzip_member, records))):
        assert [i for i in _ids(data) if i] == [f"urn:page:{i}" for i in range(5)]


def test_salvage_of_damage():
    records = [_record(i, bytes([65 + i]) * 50) for i in range(6)]
    plain = bytearray(b"".join(records))
    at = len(records[0]) + len(records[1]) + len(records[2]) - 30
    plain[at] ^= 1  # a payload's byte: its digest fails
    found = list(salvage(bytes(plain)))
    assert [r["record_id"] for r in found if "record_id" in r] == [f"urn:page:{i}" for i in (0, 1, 3, 4, 5)]
    gaps = [r for r in found if r["gap_reason"]]
    assert [(g["offset"], g["length"]) for g in gaps] == [(len(records[0]) + len(records[1]), len(records[2]))] and "differs" in gaps[0]["gap_reason"]
    members = [bytearray(gzip_member(r)) for r in records]
    members[1][20] ^= 0xFF
    members[4] = members[4][:-3]
    found = list(salvage(b"junk" + b"".join(members)))
    assert [r["record_id"] for r in found if "record_id" in r] == [f"urn:page:{i}" for i in (0, 2, 3, 5)]
    assert sum(r["length"] for r in found) == 4 + sum(map(len, members))
    assert _ids(b"") == [] and _ids(b"nothing here") == [None]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400), st.integers(0, 5000), st.booleans())
def test_hostile_bytes_never_crash(junk, at, gz):
    data = b"".join((gzip_member if gz else bytes)(_record(i, b"body" * 30)) for i in range(4))
    at = at % len(data)
    data = data[:at] + junk + data[at:]
    found = list(salvage(data))
    assert sum(r["length"] for r in found) == len(data)


def _expected(rows):
    first = {}
    for i, html in rows:
        if i is not None:
            d = (html or "").encode()
            first[d] = min(first.get(d, i), i)
    out = Counter()
    for i, html in rows:
        d = (html or "").encode()
        f = first.get(d)
        revisit = f is not None and f != i
        out[i, len(d), base64.b32encode(hashlib.sha1(d).digest()).decode(), "revisit" if revisit else "response", f if revisit else None] += 1
    return out


def _round(spark, pages, path, **options):
    write_warc(pages, path, **options)
    out = read_warc(spark, path)
    assert out.where("gap_reason is not null").count() == 0
    return Counter((r[0], r[1], r[2], r[3], r[4]) for r in out.select(page_of(out.record_id), "payload_length", "payload_digest", "record_type", page_of(out.refers_to)).collect())


def test_round_trip(spark, tmp_path, small):
    rows = [(1, "u", None), (2, None, ""), (3, "u\r\nX: y", "<p>é漢</p>"), (4, "u", "<p>é漢</p>"), (4, "u", "<p>é漢</p>"), (None, "u", "solo"), (None, "u", "<p>é漢</p>"), (5, "u", "WARC/1.0\r\n\r\n" * 3), (6, "u", "x" * 300_000), (7, "u", "x" * 300_000)]
    pages = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], "page_id long, url string, html string, id string, body string, first string")
    want = _expected([(i, h) for i, _, h in rows])
    for n, gz in enumerate((True, False)):
        assert _round(spark, pages, f"file://{tmp_path}/{n}", gzip=gz, file_bytes=200_000) == want
    real = spark.read.parquet(f"{small}/pages.parquet")
    assert _round(spark, real, f"file://{tmp_path}/real") == _expected([(r["page_id"], r["html"]) for r in real.collect()])
    assert _round(spark, pages.limit(0), f"file://{tmp_path}/none") == Counter()


def test_a_damaged_archive_loses_one_record(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(20)], "page_id long, url string, html string")
    write_warc(pages, f"file://{tmp_path}/w")
    file = max(tmp_path.glob("w/part-*"), key=lambda f: f.stat().st_size)
    data = bytearray(file.read_bytes())
    hit = [r for r in salvage(bytes(data)) if "record_id" in r][1]
    data[hit["offset"] + hit["length"] // 2] ^= 0x55
    file.write_bytes(bytes(data))
    (tmp_path / "w" / f".{file.name}.crc").unlink(missing_ok=True)
    found = read_warc(spark, f"file://{tmp_path}/w").collect()
    assert sum(r["record_id"] is not None for r in found) == 19 and sum(r["gap_reason"] is not None for r in found) == 1


def test_standard_gzip_reads_the_archive():
    data = EMPTY_MEMBER.join(map(gzip_member, [_record(1), _record(2)])) + EMPTY_MEMBER
    out = b""
    while data:
        z = zlib.decompressobj(31)
        out += z.decompress(data)
        data = z.unused_data
    assert out == _record(1) + _record(2)


def test_a_header_of_any_length(spark, tmp_path):
    long = "http://x/" + "u" * 100_000
    pages = spark.createDataFrame([(1, long, "a"), (2, "u", "a"), (3, long + "é" * 60_000, "b")], "page_id long, url string, html string")
    for n, gz in enumerate((True, False)):
        assert _round(spark, pages, f"file://{tmp_path}/{n}", gzip=gz) == _expected([(1, "a"), (2, "a"), (3, "b")])
    assert {r["target_uri"] for r in read_warc(spark, f"file://{tmp_path}/0").collect()} == {long, "u", long + "é" * 60_000}
    cut = _record(1)[:-20] + b"WARC/1.0\r\nWARC-Target-URI: " + b"x" * 70_000
    assert [r["gap_reason"] for r in salvage(cut + b"\r\n\r\n" + _record(2))][-1] is None


def test_a_member_of_many_records_loses_only_what_is_damaged(spark, tmp_path):
    rng = random.Random(3)
    records = [_record(i, rng.randbytes(3000)) for i in range(40)]
    plain, at = bytearray(b"".join(records)), sum(map(len, records[:7]))
    plain[at + len(records[7]) - 100] ^= 1
    whole, other = gzip_member(bytes(plain)), gzip_member(_record(99))
    names = [f"urn:page:{i}" for i in range(40)]
    # a bad digest: the other records stay, the gap is inside the member
    found = list(salvage(whole + other))
    assert [r["record_id"] for r in found if "record_id" in r] == [*names[:7], *names[8:], "urn:page:99"]
    assert [(r["offset"], r["length"], r["inner_offset"], r["inner_length"]) for r in found if r["gap_reason"]] == [(0, len(whole), at, len(records[7]))]
    # an archive cut within a record, and damage within a member: what was inflated before stays, and so does the next member
    for level in (0, 3):
        sound = gzip_member(b"".join(records), level)
        for data, least, last in ((sound[: len(sound) // 2], 18, []), (sound[: len(sound) // 2] + b"\xff" * 200 + other, 18, ["urn:page:99"])):
            found = list(salvage(data))
            ids = [r["record_id"] for r in found if "record_id" in r and r["record_id"] != "urn:page:99"]
            assert ids[:least] == names[:least] and len(ids) == len({*ids}) and [r["record_id"] for r in found if r.get("record_id") == "urn:page:99"] == last
            spans = sorted({(r["offset"], r["length"]) for r in found})
            assert [a for a, _ in spans] == [0, *(a + n for a, n in spans[:-1])] and sum(spans[-1]) == len(data) and any(r["gap_reason"] for r in found)
    (tmp_path / "one.warc.gz").write_bytes(whole)
    rows = read_warc(spark, f"file://{tmp_path}/one.warc.gz").collect()
    assert sum(r["record_id"] is not None for r in rows) == 39 and [r["inner_offset"] for r in rows if r["gap_reason"]] == [at]
