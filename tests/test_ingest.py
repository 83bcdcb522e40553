import gzip
import hashlib
import json
import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.functions import encode, eventtime, privacy
from logloom.functions.fields import convert, value_type
from logloom.operators import export, ingest, lineage, store
from logloom.operators.ingest import Masking
from logloom.plans import definitions, sqlgate
from logloom.sources import lines, synthetic


def now():
    return F.to_timestamp(F.lit("2026-09-30 12:00:00"))


KNOWN = {
    "asa": "Sep 29 08:15:00 fw01 %ASA-4-106023: Deny tcp src 10.0.0.5/443 dst 203.0.113.4/443 by access-group \"OUTSIDE_IN\"\n",
    "fortigate": "date=2026-09-29 time=08:15:00 log_id=000000001 action=deny srcip=10.0.0.5 dstip=203.0.113.4 proto=tcp srcport=443 dstport=443\n",
    "cef": "CEF:0|Edge|Wall|9.12|106023|Deny|5|src=10.0.0.5 dst=203.0.113.4 msg=Access denied\n",
    "json": '{"time":"2026-09-29T08:15:00Z","src_ip":"10.0.0.5","dst_ip":"203.0.113.4","action":"deny","protocol":"tcp"}\n',
}


@pytest.fixture
def land(tmp_path):
    def put(name: str, data: bytes) -> str:
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
        return f"file://{tmp_path}/in/{name}"

    return put


def run(spark, path, **options):
    return ingest.ingest(spark, path, ingest_time=now(), **options)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.binary(max_size=300), st.integers(1, 40))
def test_lines_keep_every_byte(spark, data, limit):
    files = spark.createDataFrame([("/x", bytearray(data))], "path string, content binary")
    rows = sorted(lines.split_lines(files, max_line_bytes=limit).collect(), key=lambda r: r["byte_offset"])
    assert b"".join(bytes(r["raw"]) for r in rows) == data
    want = data.split(b"\n")
    assert max((r["line_no"] for r in rows), default=0) == len(want) - (want[-1] == b"")
    at = 0
    for r in rows:
        assert r["byte_offset"] == at and len(r["raw"]) <= limit
        at += len(r["raw"])


def test_source_id_is_of_the_path(spark):
    got = spark.createDataFrame([("file:///a/b.log",), ("/a/b.log",), ("hdfs://h:1/a/b.log",)], "p string").select(lines.source_id(F.col("p")).alias("s")).collect()
    assert {r["s"] for r in got} == {hashlib.sha256(b"/a/b.log").hexdigest()[:16]}


def test_known_formats(spark, land):
    made = run(spark, land("known.log", "".join(KNOWN.values()).encode()))
    flat = {r["parser_name"]: r.asDict() for r in made.flat().collect()}
    assert {k: (r["event_time"], r["action"], r["src_ip"], r["dst_ip"], r["class_uid"], r["protocol"]) for k, r in flat.items()} == {
        "asa_syslog": ("2026-09-29T08:15:00Z", "deny", "10.0.0.5", "203.0.113.4", 4001, None), "fortigate_kv": ("2026-09-29T08:15:00Z", "deny", "10.0.0.5", "203.0.113.4", 4001, None),
        "cef_generic": ("2026-09-30T12:00:00Z", "deny", None, None, 2004, None), "json_generic": ("2026-09-29T08:15:00Z", "deny", "10.0.0.5", None, 4001, None),
    }
    assert json.loads(flat["json_generic"]["unmapped_json"]) == {"dst_ip": "203.0.113.4", "protocol": "tcp", "time": "2026-09-29T08:15:00Z"}
    assert json.loads(flat["cef_generic"]["event_json"])["time_source"] == "ingest_fallback"
    assert json.loads(flat["json_generic"]["flags_json"]) == {"duplicate_count": 0, "duplicate_of": None, "masked": False, "tz_assumed": False}
    assert json.loads(flat["asa_syslog"]["flags_json"])["tz_assumed"] is True
    assert made.flat().count() == 4 and made.quarantine.count() == 0


def test_nothing_disappears(spark, land):
    data = b"bad\xffutf8\n" + b"{broken\n" + b"unknown\r\n" + b"x" * 90 + b"\n" + KNOWN["json"].encode() + b'{"src_ip":"999.1.1.1"}\n' + b"[1]\n"
    made = run(spark, land("mixed.log", data), max_line_bytes=200)
    counts = made.counts().first()
    assert counts.asDict() == {"records": 7, "events": 1, "quarantined": 6, "headers": 0}
    assert Counter(r["reason_code"] for r in made.quarantine.collect()) == {"invalid_utf8": 1, "no_parser_match": 4, "parser_error": 1}


def test_oversized_lines_are_one_record(spark, land):
    data = b"A" * 51 + b"\nshort\n"
    made = run(spark, land("big.log", data), max_line_bytes=16)
    rows = {r["reason_code"]: r for r in made.quarantine.collect()}
    assert rows["line_too_large"]["byte_offset"] == 0 and len(rows["line_too_large"]["raw_sha256"]) == 4
    assert b"".join(bytes(r["raw"]) for r in made.raw.orderBy("byte_offset").collect()) == data
    assert made.counts().first()["records"] == 2


def test_csv_with_header(spark, land):
    data = b"Timestamp,src_ip,dst-ip,action,protocol,username,vendor_code\n2026-09-29T08:15:00Z,10.0.0.5,203.0.113.4,Deny,tcp,alice,\n2026-09-29T08:15:01Z,10.0.0.6,203.0.113.5,Allow,udp,\"bo,b\",X7\nshort,row\n2026-09-29T08:15:01Z,10.0.0.999,203.0.113.5,Allow,udp,c,X7\n"
    made = run(spark, land("t.csv", data), masking=Masking(users=True, salt="s"))
    rows = {r["line_no"]: r for r in made.flat().collect()}
    assert sorted(rows) == [2, 3] and rows[2]["parser_name"] == "csv_header" and rows[2]["action"] == "deny" and rows[2]["event_time"] == "2026-09-29T08:15:00Z"
    event = json.loads(rows[3]["event_json"])
    assert event["protocol_name"] == "udp" and event["user_name"] == "sha256:" + hashlib.sha256(b"s:bo,b").hexdigest()
    assert json.loads(rows[2]["unmapped_json"]) == {"vendor_code": ""} and json.loads(rows[3]["flags_json"])["masked"] is True
    assert Counter(r["reason_code"] for r in made.quarantine.collect()) == {"no_parser_match": 1, "parser_error": 1}
    assert made.counts().first().asDict() == {"records": 5, "events": 2, "quarantined": 2, "headers": 1}


def test_duplicates_and_masking(spark, land):
    a = '{"time":"2026-09-29T08:15:00Z","src_ip":"10.0.0.5","action":"deny"}\n'
    b = a.replace("10.0.0.5", "10.0.0.9")
    plain = sorted(run(spark, land("d.log", (a + b + a).encode())).events.select("source.line_no", "event_id", "flags").collect())
    assert [r["flags"]["duplicate_count"] for r in plain] == [0, 0, 1] and plain[2]["flags"]["duplicate_of"] == plain[0]["event_id"]
    hidden = sorted(run(spark, land("d.log", (a + b + a).encode()), masking=Masking(addresses=True)).events.select("source.line_no", "event_id", "flags", "event.src_endpoint.ip").collect())
    assert [r["flags"]["duplicate_count"] for r in hidden] == [0, 1, 2] and {r["ip"] for r in hidden} == {"10.0.0.0"} and all(r["flags"]["masked"] for r in hidden)
    with pytest.raises(ValueError):
        Masking(users=True)


def test_event_times(spark):
    cases = [
        ({"time": "2026-09-29T08:15:00+02:00"}, None, "2026-09-29T06:15:00Z", False), ({"date": "2026-09-29", "time": "8:05:09"}, None, "2026-09-29T08:05:09Z", True), ({"ts": "Sep  9 01:02:03"}, None, "2026-09-09T01:02:03Z", True),
        ({"ts": "Feb 29 01:02:03"}, None, "2026-09-30T12:00:00Z", True), ({}, "2026-09-29 08:15", "2026-09-29T08:15:00Z", True), ({"date": "2026-01-02"}, "03:04:05", "2026-01-02T03:04:05Z", True), ({"date": "soon"}, "03:04:05", "2026-09-30T03:04:05Z", True),
        ({}, "2026-09-29", "2026-09-29T00:00:00Z", True), ({"time": "25:00:00", "date": "2026-09-29"}, "x", "2026-09-30T12:00:00Z", True), ({"time": "20260929"}, None, "2026-09-29T00:00:00Z", True), ({"time": "2026-13-01"}, None, "2026-09-30T12:00:00Z", True),
    ]
    df = spark.createDataFrame([(i, u.get("time"), u.get("date"), u.get("ts"), e) for i, (u, e, _, _) in enumerate(cases)], "i int, time string, date string, ts string, e string")
    got = eventtime.resolve(df, {k: F.col(k) for k in ("time", "date", "ts")}, F.col("e"), now()).orderBy("i").collect()
    assert [(r["_time"], r["_assumed"]) for r in got] == [(t, a) for _, _, t, a in cases]


def test_conversions(spark):
    df = spark.createDataFrame([("10.0.0.1", "ipv4"), ("10.0.0.01", "ipv4"), ("1.2.3", "ipv4"), ("42", "int"), ("+7", "int"), ("1_000", "int"), ("4.2", "int"), ("2026-09-29T08:15:00Z", "timestamp"), ("08:15:00", "timestamp"), ("2026", "timestamp"), ("x", "free_text")], "v string, k string")
    for kind in ("ipv4", "int", "timestamp", "free_text"):
        bad = [r["v"] for r in df.where(F.col("k") == kind).where(convert(kind, F.col("v"))[1].isNotNull()).collect()]
        assert bad == {"ipv4": ["10.0.0.01", "1.2.3"], "int": ["4.2"], "timestamp": ["2026"], "free_text": []}[kind]
    kinds = [r[0] for r in spark.createDataFrame([("10.0.0.1",), ("-5",), ("2026-09-29",), ("1:2:3",), ("word",)], "v string").select(value_type(F.col("v"))).collect()]
    assert kinds == ["ipv4", "int", "timestamp", "timestamp", "free_text"]


def test_masks(spark):
    got = spark.createDataFrame([("10.1.2.3",), ("2001:db8:1:2:3::4",), ("word",), (None,)], "a string").select(privacy.mask_address(F.col("a"))).collect()
    assert [r[0] for r in got] == ["10.1.2.0", "2001:db8:1:2::", "word", None]


def test_drafts_are_not_loaded(tmp_path):
    import yaml

    for state in definitions.STATES:
        (tmp_path / f"{state}.yaml").write_text(yaml.safe_dump(definitions.BUILTIN[0] | {"state": state}))
    assert [d["state"] for d in definitions.load(tmp_path)] == ["active", "verified"]
    with pytest.raises(definitions.InvalidParser):
        definitions.validate(definitions.BUILTIN[0] | {"version": 0})


def test_exports_hold_the_envelope(spark, land, tmp_path):
    import base64

    made = run(spark, land("known.log", "".join(KNOWN.values()).encode())).events
    text = {f: [r[0] for r in export.lines(made, f).collect()] for f in ("ndjson", "cef", "syslog")}
    want = sorted(text["ndjson"])
    envelopes = [json.loads(x) for x in want]
    assert all(x == json.dumps(e, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for x, e in zip(want, envelopes, strict=True))
    cef = sorted(base64.b64decode(x.split(" cs1=")[1].split(" ")[0].replace("\\=", "=")).decode() for x in text["cef"])
    syslog = sorted(base64.b64decode(json.loads(x.split(" - - ")[1])["envelope_base64"]).decode() for x in text["syslog"])
    assert cef == want and syslog == want
    assert export.export(made, f"file://{tmp_path}/out", "ndjson") == 4
    with pytest.raises(ValueError):
        export.export(made, f"file://{tmp_path}/out", "ndjson", max_line=100)
    assert spark.read.text(f"file://{tmp_path}/out").count() == 4


def test_store_lineage_and_sql(spark, land, tmp_path):
    made = run(spark, land("known.log", "".join(KNOWN.values()).encode() * 3))
    at = f"file://{tmp_path}"
    flat = made.flat()
    assert store.write_events(flat, f"{at}/events") == store.write_events(flat.orderBy("raw"), f"{at}/events")
    assert spark.read.parquet(f"{at}/events").count() == 12 and store.write_events(flat.limit(0), f"{at}/events") is None
    store.write_raw(made.raw, f"{at}/raw")
    raw = spark.read.parquet(f"{at}/raw")
    assert sorted(r["sequence"] for r in raw.collect()) == list(range(12))
    assert lineage.verify_store(raw).count() == 0 and lineage.orphans(flat, raw).count() == 0
    traced = lineage.trace(flat, raw).collect()
    assert len(traced) == 12 and all(r["found"] and r["hash_ok"] and r["text_ok"] for r in traced)
    one = flat.first()
    assert lineage.trace_event(flat, raw, one["event_id"]).first()["found"]
    assert store.read_record(spark, f"{at}/raw", one["source_id"], one["byte_offset"]) == one["raw"].encode()
    faulty = raw.where("sequence <> 4").withColumn("raw", F.when(F.col("sequence") == 7, F.lit(b"zz")).otherwise(F.col("raw")))
    assert Counter(r["error"] for r in lineage.verify_store(faulty).collect()) == {"sequence gap or repeat": 1, "bytes differ from size or digest": 1, "offsets leave a gap": 1}
    assert sqlgate.query_path(spark, f"{at}/events", "SELECT count(*) AS n FROM events").first()["n"] == 12
    assert sqlgate.query_path(spark, f"{at}/nowhere", "SELECT * FROM events").count() == 0
    assert sqlgate.recent(flat, 5).count() == 5


_CALL = "reflect('java.lang.System', 'getProperty', 'user.home')"
REFUSED = [
    f"SELECT {', '.join(f'{i} AS c{i}' for i in range(30))}, {_CALL} AS x FROM events", f"SELECT upper({_CALL}) FROM events", f"SELECT java_method{_CALL.removeprefix('reflect')} FROM events", f"SELECT try_reflect{_CALL.removeprefix('reflect')} FROM events",
    f"SELECT ReFlect{_CALL.removeprefix('reflect')} FROM events", f"SELECT `reflect`{_CALL.removeprefix('reflect')} FROM events", f"SELECT system.builtin.{_CALL} FROM events", f"SELECT transform(array(1), x -> {_CALL}) FROM events", f"SELECT 1 FROM events WHERE EXISTS (SELECT {_CALL})",
    f"SELECT 1 FROM events ORDER BY {_CALL}", f"SELECT count(*) FILTER (WHERE {_CALL} = 'a') FROM events", f"SELECT sum(1) OVER (PARTITION BY {_CALL}) FROM events", f"SELECT sum(1) OVER w FROM events WINDOW w AS (PARTITION BY {_CALL})", f"SELECT 1 FROM events GROUP BY {_CALL} HAVING {_CALL} = 'a'",
    f"SELECT * FROM events JOIN LATERAL (SELECT {_CALL} AS x) t ON true", f"SELECT * FROM events LATERAL VIEW explode(array({_CALL})) t AS x", f"SELECT CASE WHEN raw IN (SELECT {_CALL}) THEN 1 END FROM events", f"SELECT * FROM explode(array({_CALL}))", f"SELECT raw FROM events QUALIFY {_CALL} = 'a'",
    "SELECT * FROM (WITH secret AS (SELECT 1) SELECT * FROM secret) JOIN secret ON true", "SELECT * FROM IDENTIFIER('other')", "SELECT IDENTIFIER('reflect')('a', 'b') FROM events", "SELECT TRANSFORM(raw) USING 'cat' FROM events", "SELECT * FROM db.events", "SELECT * FROM events VERSION AS OF 1", "SELECT input_file_name() FROM events",
    "SELECT from_protobuf(raw, 'm', '/etc/passwd') FROM events", "SELECT no_such_function(raw) FROM events", "SELECT :p FROM events", "SELECT (raw FROM events", "SELECT * FROM read_files('/etc')", "SELECT current_user() FROM events", "SELECT * FROM events |> WHERE raw = 'a'", "SELECT * FROM events UNION ALL SELECT * FROM csv.`/etc/hosts`",
]
ACCEPTED = [
    "SELECT raw LIKE '%reflect%' AS a, action = 'Command' AS b, 'java_method' AS c, \"InsertInto\" AS d FROM events", "SELECT event_id AS reflect FROM events", "SELECT action, count(*) AS n FROM events GROUP BY ALL ORDER BY ALL", "SELECT DISTINCT action FROM events WHERE raw RLIKE 'a' AND NOT (byte_offset BETWEEN 1 AND 2) OR src_ip IN ('a', 'b') AND dst_ip IS NOT NULL",
    "SELECT src_ip, row_number() OVER (PARTITION BY src_ip ORDER BY event_time DESC ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM events QUALIFY n = 1 ORDER BY src_ip LIMIT 5 OFFSET 1", "SELECT event_json:src_endpoint.ip, get_json_object(event_json, '$.a'), CAST(line_no AS DOUBLE) / 2, line_no::string, try_cast(raw AS INT), interval 1 day FROM events",
    "SELECT transform(split(raw, ' '), x -> upper(x) || '!')[0], named_struct('a', 1).a, map('a', 1)['a'], extract(YEAR FROM to_timestamp(event_time)), trim(BOTH 'x' FROM raw), position('a' IN raw) FROM events", "SELECT * EXCEPT (raw) FROM events TABLESAMPLE (10 PERCENT)", "SELECT a, b FROM events PIVOT (count(raw) FOR action IN ('deny' AS a, 'accept' AS b))",
    "SELECT action, count(*) FROM events GROUP BY GROUPING SETS ((action), ()) HAVING count(*) > 1", "SELECT raw FROM events INTERSECT ALL SELECT raw FROM events EXCEPT SELECT 'a' UNION SELECT 'b'", "SELECT sum(x) OVER w FROM (SELECT line_no AS x FROM events) WINDOW w AS (ORDER BY x)", "SELECT /*+ BROADCAST(e) */ e.raw FROM events e LEFT SEMI JOIN events f ON e.event_id <=> f.event_id",
    "SELECT (SELECT max(line_no) FROM events), EXISTS (SELECT 1 FROM events WHERE line_no = 1), action IN (SELECT action FROM EVENTS) FROM Events", "SELECT * FROM events, LATERAL (SELECT line_no + 1 AS m) t", "SELECT approx_count_distinct(src_ip), percentile_approx(line_no, 0.5), md5(raw), date_trunc('hour', to_timestamp(event_time)) FROM events GROUP BY 4", "SELECT a FROM VALUES (1), (2) AS t(a)",
]


def test_qualify_in_text(spark):
    from logloom.plans.rewrites import qualified

    spark.range(20).selectExpr("id", "id % 3 AS k", "'a QUALIFY ) (' AS note").createOrReplaceTempView("numbered")
    run = lambda sql: sorted(tuple(r) for r in spark.sql(qualified(sql)).collect())
    assert run("SELECT id, k FROM numbered QUALIFY row_number() OVER (PARTITION BY k ORDER BY id DESC) = 1") == [(17, 2), (18, 0), (19, 1)]
    assert run("SELECT id, count(*) OVER (PARTITION BY k) AS n FROM numbered WHERE note = 'a QUALIFY ) (' QUALIFY n = 6 ORDER BY id LIMIT 2") == [(2, 6), (5, 6)]
    assert run("SELECT count(*) AS n FROM (SELECT id FROM numbered qualify id = max(id) OVER (PARTITION BY k)) UNION ALL SELECT k FROM numbered QUALIFY id = max(id) OVER ()") == [(1,), (3,)]
    assert run("SELECT k, sum(id) AS s FROM numbered GROUP BY k QUALIFY rank() OVER (ORDER BY sum(id) DESC) = 1") == [(1, 70)]
    assert qualified("SELECT 'qualify' AS x") == "SELECT 'qualify' AS x"


def test_asof_of_unknown_keys_and_times(spark):
    from logloom.plans.rewrites import asof_join

    left = spark.createDataFrame([(1, "a", 5), (2, None, 5), (3, "a", None), (4, "b", 1), (4, "b", 1)], "i int, k string, t int").selectExpr("i", "k", "timestamp_seconds(t) AS t")
    right = spark.createDataFrame([("a", 1, 10), ("a", 1, 11), ("a", None, 12), (None, 1, 13), ("b", 2, 14), ("b", None, 15)], "k string, t int, v int").selectExpr("k", "timestamp_seconds(t) AS t", "v")
    for seconds in (None, 2):
        assert sorted((r["i"], r["right_v"]) for r in asof_join(left, right, "k", "t", "t", ["v"], seconds).collect()) == [(1, 11), (2, None), (3, None), (4, None), (4, None)]


@pytest.mark.parametrize("sql", ["DROP TABLE events", "SELECT 1; SELECT 2", "WITH a AS (SELECT 1) SELECT * FROM a", "SELECT * FROM text.`/etc/hostname`", "SELECT (SELECT max(value) FROM text.`/etc/hostname`) FROM events", "SELECT * FROM events WHERE raw IN (SELECT value FROM csv.`/etc/hosts`)", "SELECT reflect('java.lang.System', 'exit', 1) FROM events", "SELECT * FROM other", "SELECT * FROM events JOIN parquet.`/x` p ON 1 = 1", *REFUSED])
def test_gate_rejects(spark, sql):
    with pytest.raises(sqlgate.RejectedQuery):
        sqlgate.check(spark, sql)


@pytest.mark.parametrize("sql", ["select 1", "SELECT a.action FROM events a JOIN events b ON a.event_id = b.event_id", "SELECT * FROM (WITH c AS (SELECT * FROM events) SELECT * FROM c)", "SELECT x FROM events LATERAL VIEW explode(split(raw, ' ')) t AS x", "SELECT id FROM range(5)", *ACCEPTED])
def test_gate_accepts(spark, sql):
    sqlgate.check(spark, sql)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=80), min_size=1, max_size=8))
def test_hostile_text_never_crashes(spark, texts):
    rows = [("/x", "s", i + 2, i * 1000, bytearray(t.encode("utf-8", "replace"))) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "path string, source_id string, line_no bigint, byte_offset bigint, raw binary")
    c = ingest.ingest_lines(df, ingest_time=now(), csv=False).counts().first()
    assert c["records"] == len(texts) == c["events"] + c["quarantined"]


def test_generator_is_independent_of_partitions(spark):
    for form in ("fortigate", "asa", "json", "cef"):
        a = sorted(r["line"] for r in synthetic.generate(spark, 50, form).collect())
        assert a == sorted(r["line"] for r in synthetic.generate(spark, 50, form).repartition(7).collect())


def test_splits_give_the_lines_of_whole_files(spark, tmp_path):
    """Offsets, numbers and bytes do not depend on where Spark splits the files."""
    rng = random.Random(3)
    (tmp_path / "in").mkdir()
    for k, end in enumerate((b"", b"tail", None, b"\n\n\r\n")):
        body = b"".join(bytes(rng.choice(b"ab \xff\x00\r\xc3") for _ in range(rng.choice([0, 3, 20, 100, 3000]))) + b"\n" for _ in range(60))
        (tmp_path / "in" / f"f {k}+%20é.log").write_bytes(b"" if end is None else body + end)
    columns = ["path", "source_id", "line_no", "byte_offset", "raw", "chunk", "oversized"]
    want = Counter(tuple(r) for r in lines.split_lines(spark.read.format("binaryFile").load(f"file://{tmp_path}/in"), max_line_bytes=512).select(columns).collect())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert Counter(tuple(r) for r in lines.read_lines(spark, f"file://{tmp_path}/in", 512).select(columns).collect()) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "c.log.gz").write_bytes(gzip.compress(b"a\nb\n"))
    with pytest.raises(Exception, match="compressed"):
        lines.read_lines(spark, f"file://{tmp_path}/c.log.gz").collect()


def test_sequences_go_on_and_reruns_replace(spark, tmp_path):
    at = f"file://{tmp_path}"
    for k in range(2):
        (tmp_path / f"{k}.log").write_bytes(b"".join(b"line %d\n" % i for i in range(k * 5 + 3)))
        made = ingest.ingest(spark, f"{at}/{k}.log")
        store.write_raw(made.raw, f"{at}/raw")
        for _ in range(2):
            store.write_quarantine(made.quarantine, f"{at}/quarantine")
    raw = spark.read.parquet(f"{at}/raw")
    assert sorted(r["sequence"] for r in raw.collect()) == list(range(11)) and lineage.verify_store(raw).count() == 0
    assert spark.read.parquet(f"{at}/quarantine").count() == 11


def test_a_failed_export_leaves_the_old_one(spark, tmp_path):
    log, out = tmp_path / "a.log", tmp_path / "out"
    log.write_text('{"time":"2026-09-29T08:15:00Z","src_ip":"10.0.0.1","action":"deny"}\n')
    events = ingest.ingest(spark, f"file://{log}").events
    assert export.export(events, f"file://{out}", "ndjson") == 1
    before = {f.name: f.read_bytes() for f in out.glob("part-*")}
    broken = events.withColumn("raw", F.when(F.rand() >= 0, F.raise_error(F.lit("lost")).cast("string")))
    for bad, options in ((broken, {}), (events, {"max_line": 5})):
        with pytest.raises(Exception):
            export.export(bad, f"file://{out}", "ndjson", **options)
    assert {f.name: f.read_bytes() for f in out.glob("part-*")} == before and sorted(f.name for f in tmp_path.iterdir()) == ["a.log", "out"]
    assert export.export(events, f"file://{out}", "cef") == 1 and {f.name for f in out.glob("part-*")}.isdisjoint(before)


def test_json_in_ascii_and_control_characters(spark):
    values = ["café 🙂 \U0010ffff", "\x00\x0b\x0e\x1f\x7f\u0085 ", "\\u001F \\\\u000B", 'a"b/c\\', "\\\x1f", "plain"]
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", F.to_json(F.struct("v")).alias("j"))
    for r in df.select("v", encode.ascii_json(F.col("j")).alias("a"), encode.plain_json(F.col("j")).alias("p")).collect():
        assert r["a"] == json.dumps({"v": r["v"]}, separators=(",", ":")) and r["p"] == json.dumps({"v": r["v"]}, separators=(",", ":"), ensure_ascii=False)


def _one(spark, land, fields, line, **options):
    base = next(d for d in definitions.BUILTIN if d["name"] == "json_generic")
    own = [{"name": n, "type": t, "ocsf_path": p, "confidence": 0.9} for n, t, p in fields]
    parser = base | {"templates": [base["templates"][0] | {"fields": own}]}
    made = ingest.ingest(spark, land("open.log", (line + "\n").encode()), definitions=[parser], **options)
    found = made.flat().first()
    return (json.loads(found["event_json"]), json.loads(found["unmapped_json"]), json.loads(found["flags_json"])["masked"]) if found else made.quarantine.first()["reason_code"]


def test_open_paths(spark, land):
    line = '{"a":"x","b":5,"c":"10.1.2.3","d":"bob","e":"y"}'
    event, rest, _ = _one(spark, land, [("a", "free_text", "event.device.hostname"), ("b", "int", "event.device.os.bits"), ("c", "ipv4", "event.src_endpoint.nat.ip"), ("d", "free_text", "event.user.name"), ("e", "free_text", "event.zone")], line)
    assert event["device"] == {"hostname": "x", "os": {"bits": 5}} and event["src_endpoint"] == {"nat": {"ip": "10.1.2.3"}} and event["user"] == {"name": "bob"} and event["zone"] == "y" and rest == {}
    # of fields at one place, or at a place inside another's, the later one counts; one that isn't there leaves what is
    event, _, _ = _one(spark, land, [("a", "free_text", "event.x"), ("e", "free_text", "event.x"), ("nope", "free_text", "event.x"), ("d", "free_text", "event.y"), ("a", "free_text", "event.y.z"), ("b", "int", "event.z.q"), ("d", "free_text", "event.z")], line)
    assert (event["x"], event["y"], event["z"]) == ("y", {"z": "x"}, "bob")
    # values where numbers, texts or objects have to be
    for path, kind, name in (("event.src_endpoint.port", "free_text", "a"), ("event.severity", "int", "b"), ("event.src_endpoint", "free_text", "a"), ("event.message.text", "free_text", "a"), ("event", "free_text", "a")):
        assert _one(spark, land, [(name, kind, path)], line) == "invalid_envelope"
    assert "device" not in _one(spark, land, [("a", "free_text", "device.hostname")], line)[0]


def test_masks_at_any_depth(spark, land):
    line = '{"dst_ip":"2001:db8::1:2:3","net":{"src_ip":"10.9.9.9","Zip":"192.168.7.7","n":1.5,"l":[true,null,{"ip":"10.1.1.1"},"10.1.1.1"]},"ip":["10.2.2.2","no"],"dst_port":443,"user":"al","clip":"x"}'
    hide = Masking(addresses=True, users=True, salt="s")
    event, rest, masked = _one(spark, land, [("user", "free_text", "event.user.user_name"), ("dst_ip", "free_text", "event.nat.ip")], line, masking=hide)
    assert masked and rest == {"net": {"src_ip": "10.9.9.0", "Zip": "192.168.7.0", "n": 1.5, "l": [True, None, {"ip": "10.1.1.0"}, "10.1.1.1"]}, "ip": ["10.2.2.0", "no"], "dst_port": 443, "clip": "x"}
    assert event["nat"] == {"ip": "2001:db8::"} and event["user"]["user_name"] == "sha256:" + hashlib.sha256(b"s:al").hexdigest()
    assert _one(spark, land, [], '{"ip":"10.0.0.0","a":"10.0.0.1"}', masking=Masking(addresses=True))[1:] == ({"ip": "10.0.0.0", "a": "10.0.0.1"}, False)
