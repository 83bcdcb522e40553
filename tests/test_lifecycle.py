import json
import re
from collections import Counter

import pytest
import yaml

from logloom import cli, queries
from logloom.operators import monitor, verify
from logloom.plans import learn
from logloom.plans.definitions import BUILTIN, validate
from logloom.plans.drain import Drain
from logloom.streaming.ingest import ingest_stream

UNSEEN = [f"event_time=2026-09-30T08:10:0{i}Z source_ip=10.40.0.{5 + i} destination_ip=198.51.100.{9 + i} action=deny proto=tcp session={s}" for i, s in enumerate(("alpha", "beta", "gamma"))]


def test_drain_clusters():
    d = Drain()
    assert [d.add(x).number for x in ("user alice logged in", "user bob logged in", "disk full", "user carol logged out")] == [1, 1, 2, 3]
    assert d.clusters[1].template == "user <*> logged in"
    capped = Drain(most=3)
    for i in range(10):
        capped.add("word " * (i + 1))
    assert len(capped.clusters) == 3


def test_learned_pairs(spark):
    made = learn.learn(spark, UNSEEN, "northstar", created_from="x")
    kinds = {f["name"]: (f["type"], f["path"]) for f in made.fields}
    assert made.clusters == 1 and made.definition["state"] == "draft" and made.definition["templates"][0]["event_class"] == "Network Activity"
    assert kinds == {"event_time": ("timestamp", "event.time"), "source_ip": ("ipv4", "event.src_endpoint.ip"), "destination_ip": ("ipv4", "event.dst_endpoint.ip"), "action": ("enum", "event.action"), "proto": ("enum", "event.protocol_name"), "session": ("free_text", None)}
    assert made.review()["unmapped_fields"] == ["session"]


def test_learned_text(spark):
    made = learn.learn(spark, ["link eth0 went down", "link eth1 went down"], "links")
    t = made.definition["templates"][0]
    assert made.clusters == 1 and t["regex"] == r"^link\s+(?P<field_1>\S+)\s+went\s+down$" and t["fields"] == [] and t["event_class"] == "Detection Finding"
    for bad in ([], [""], ["x" * 70_000]):
        with pytest.raises(ValueError):
            learn.learn(spark, bad, "links")


def test_names_and_pairs():
    assert learn.group_names(["a-b", "a_b", "1x", ""]) == ["a_b", "a_b_2", "field_1x", "field_"]
    assert learn.group_names(["a", "a_2", "a", "é", "x y"]) == ["a", "a_2", "a_3", "_", "x_y"]
    assert learn.line_pattern(learn.mined_words(["<134>", "a*", "<*>", "<*>"])[0]) == r"^<134>\s+a\*\s+(?P<field_1>\S+)\s+(?P<field_2>\S+)$"
    assert learn.pairs_of("a=1 b='x y'") == [("a", "1"), ("b", "x y")] and learn.pairs_of("a=1 b") == [] and learn.pairs_of("a='") == []


def _cases(spark, rows):
    return spark.createDataFrame(rows, "raw string, expected_template_id string, required_fields array<string>")


def test_verification_and_states(spark):
    draft = learn.learn(spark, UNSEEN, "northstar").definition
    name = draft["templates"][0]["id"]
    good = verify.verify(_cases(spark, [(x, name, ["source_ip"]) for x in UNSEEN] + [("noise", None, [])]), draft)
    assert good["valid"] and good["coverage"] == 1.0 and good["cases_checked"] == 4
    bad = verify.summary(verify.score(_cases(spark, [(UNSEEN[0], "other", []), (UNSEEN[1], None, ["session"])]), draft)).first().asDict()
    assert not bad["valid"] and bad["overmerged_cases"] == 2 and bad["missing_required_fields"] == 1
    for refused in ([(UNSEEN[0], "other", [])], [(UNSEEN[0], name, ["session"])], [("x", None, ["action"])], []):
        with pytest.raises(ValueError):
            verify.verify(_cases(spark, refused), draft)
    assert verify.verify(_cases(spark, [("x", None, [])]), draft | {"templates": [draft["templates"][0] | {"regex": "(?=x)"}]})["regex_safe"] is False
    with pytest.raises(ValueError):
        verify.verify(_cases(spark, [("x", None, [])]), draft | {"state": "verified"})
    verified = verify.transition(draft, "verified", reference="r.json")
    active = verify.transition(verified, "active", report=good)
    drifting = verify.transition(active, "drifting")
    assert verify.transition(drifting, "superseded")["state"] == "superseded" and verify.transition(drifting, "active")["state"] == "active"
    for d, state, options in ((draft, "active", {}), (draft, "verified", {}), (verified, "active", {"report": bad}), (active, "verified", {})):
        with pytest.raises(ValueError):
            verify.transition(d, state, **options)


def test_drift(spark):
    definition = next(d for d in BUILTIN if d["name"] == "json_generic")
    rows = [(0, '{"src_ip":"10.0.0.1","action":"deny"}'), (1, "noise"), (2, '{"src_ip":"999.0.0.1"}'), (3, "")]
    df = spark.createDataFrame(rows, "n int, line string")
    r = monitor.report(df, [definition], "json_generic", 0.9, 0.99).first()
    assert (r["total"], r["matched"], r["coverage"], r["mean_confidence"], r["parse_errors"]) == (4, 1, 0.25, 0.85, 1)
    assert r["drift_reasons"] == ["coverage_below_threshold", "mean_confidence_below_threshold", "parser_errors_present"] and r["drifting"]
    assert [x["n"] for x in monitor.unmatched(df, [definition], "json_generic", "n").collect()] == [1, 2]
    assert not monitor.report(df.where("n = 0"), [definition], "json_generic").first()["drifting"]
    assert monitor.report(df.limit(0), [definition], "json_generic").first()["mean_confidence"] == 0.0
    assert len(monitor.batch_digest(df, "n").first()[0]) == 64


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    at = f"file://{tmp_path}"
    line = '{"time":"2026-09-29T08:15:00Z","src_ip":"10.0.0.%d","action":"deny"}\n'
    for turn in range(2):
        (folder / f"{turn}.log").write_text("".join(line % (i + turn) for i in range(5)) + "noise\n")
        q = ingest_stream(spark, f"{at}/in", f"{at}/events", f"{at}/quarantine", f"{at}/checkpoint", csv=False)
        q.awaitTermination(120)
        q.stop()
    assert spark.read.parquet(f"{at}/events").count() == 10 and spark.read.parquet(f"{at}/quarantine").count() == 2


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    log = tmp_path / "a.log"
    log.write_text("\n".join(UNSEEN) + "\n" + '{"time":"2026-09-29T08:15:00Z","src_ip":"10.0.0.1","action":"deny"}\n')
    data = f"file://{tmp_path}/data"

    def call(*argv, data=data, parsers=None):
        code = cli.main(["--data", data, *(["--parsers", str(parsers)] if parsers else []), *map(str, argv)])
        return code, json.loads(out) if (out := capsys.readouterr().out.strip()) else None

    code, made = call("run", f"file://{log}")
    assert code == 0 and (made["records"], made["events"], made["quarantined"]) == (4, 1, 3)
    assert call("query", "SELECT count(*) AS n FROM events")[1] == [{"n": 1}] and call("query", "DROP TABLE x")[0] == 1
    event = call("query", "SELECT event_id FROM events")[1][0]["event_id"]
    assert call("trace", event)[1][0]["hash_ok"] and call("verify-store")[1]["valid"]
    parsers = tmp_path / "parsers"
    parsers.mkdir()
    samples = tmp_path / "unseen.log"
    samples.write_text("\n".join(UNSEEN) + "\n")
    assert call("learn", samples, "northstar", parsers)[1]["cluster_count"] == 1 and call("learn", samples, "northstar", parsers)[0] == 1
    draft = parsers / "northstar.yaml"
    name = validate(yaml.safe_load(draft.read_text()))["templates"][0]["id"]
    cases = tmp_path / "cases.jsonl"
    cases.write_text("".join(json.dumps({"raw": x, "expected_template_id": name, "required_fields": ["action"]}) + "\n" for x in UNSEEN) + json.dumps({"raw": "x", "expected_template_id": None}) + "\n")
    assert call("verify", draft, f"file://{cases}", tmp_path / "r.json")[1]["valid"] and call("activate", draft, tmp_path / "r.json")[1]["state"] == "active"
    assert call("parsers", parsers=parsers)[1] == [{"name": "northstar", "source_format": "key_value", "state": "active", "version": 1}]
    assert call("run", f"file://{samples}", data=f"{data}2", parsers=parsers)[1]["events"] == 3
    assert call("monitor", draft, f"file://{log}", "--out", tmp_path)[1]["drifting"] and yaml.safe_load(draft.read_text())["state"] == "drifting"
    assert call("export", f"file://{log}", f"file://{tmp_path}/out", "--form", "cef")[1] == {"exported": 1}
    assert len(list(tmp_path.glob("northstar-*-monitor.json"))) == 1 and (tmp_path / "northstar-v1-verification.html").exists()
    assert call("export", f"file://{log}", f"file://{tmp_path}/nd")[1] == {"exported": 1}
    event = max((tmp_path / "nd").glob("part-*"), key=lambda f: f.stat().st_size)
    assert call("verify-event", f"file://{event}", "--store", f"{data}/raw")[1] == {"valid": True, "errors": []}
    (tmp_path / "bad.json").write_text(event.read_text().replace("10.0.0.1", "10.0.0.2"))
    assert call("verify-event", f"file://{tmp_path}/bad.json")[1]["errors"] == ["raw SHA-256 mismatch"]
    assert call("run", f"file://{log}")[0] == 0 and call("verify-store")[1] == {"valid": True, "fault_count": 0, "first_faults": [], "orphans": 0}
    assert call("bench", "--n", 200, "--out", tmp_path / "bench.md")[1]["stored_events"] == 200 and (tmp_path / "bench.md").exists()
    assert call("version")[1]["version"] and call("health")[1]["status"] == "ok"


def test_as_of_and_range(spark):
    from logloom.plans.rewrites import asof_join, qualify, range_join
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    left = spark.createDataFrame([(1, "a", 10), (2, "a", 5), (3, "b", 7), (4, "a", 99)], "id int, k string, s int").withColumn("at", F.timestamp_seconds("s"))
    right = spark.createDataFrame([("a", 6, 60), ("a", 10, 100), ("b", 8, 80)], "k string, s int, v int").withColumn("at", F.timestamp_seconds("s"))
    for slices in (None, 3):
        got = {r["id"]: r["right_v"] for r in asof_join(left, right, "k", "at", "at", ["v"], slices).collect()}
        assert got == {1: 100, 2: None, 3: None, 4: 100}
    points, ranges = spark.range(20).withColumn("x", F.col("id") * 1.5), spark.createDataFrame([(0, 2.0, 9.0), (1, 4.5, 4.5), (2, -3.0, 100.0)], "r int, lo double, hi double")
    want = Counter((i, r) for i in range(20) for r, lo, hi in ((0, 2, 9), (1, 4.5, 4.5), (2, -3, 100)) if lo <= i * 1.5 < hi)
    assert Counter((r["id"], r["r"]) for r in range_join(points, ranges, "x", "lo", "hi", 4.0).collect()) == want
    assert qualify(left, F.row_number().over(Window.partitionBy("k").orderBy("s")), "_w = 1").count() == 2


def test_server(spark, tmp_path):
    import socket
    import threading
    import urllib.error
    import urllib.request

    from logloom.server import Service, serve

    server = serve(Service(spark, tmp_path, max_upload=2000), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def call(path, data=None, **headers):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, data, {k.replace("_", "-"): v for k, v in headers.items()}), timeout=120) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        assert call("/health") == (200, {"status": "ok"}) and call("/events") == (200, []) and call("/nothing")[0] == 404
        assert [p["name"] for p in call("/parsers")[1]] == ["asa_syslog", "cef_generic", "fortigate_kv", "json_generic"]
        line = b'{"time":"2026-09-29T08:15:00Z","src_ip":"10.0.0.1","action":"deny"}\nnoise\n'
        status, made = call("/ingest", line, Content_Type="text/plain", X_Filename="../../x y.log")
        assert status == 200 and (made["records_seen"], made["events_written"], made["quarantined"]) == (2, 1, 1) and made["upload_file"].endswith("-upload.log")
        assert call("/ingest", b"x" * 3000, Content_Type="text/plain")[0] == 413 and call("/ingest", line, Content_Type="text/html")[0] == 415 and call("/ingest", b"", Content_Type="text/plain")[0] == 400
        assert call("/ingest", iter([line[:40], line[40:]]), Content_Type="text/plain", X_Filename="a.log")[1]["records_seen"] == 2
        assert call("/ingest", iter([b"x" * 1500] * 2), Content_Type="text/plain")[0] == 413
        kept = sorted((tmp_path / "incoming").glob("*.log"))
        with socket.create_connection(server.server_address) as s:  # a client that goes away
            s.sendall(b"POST /ingest HTTP/1.1\r\nContent-Type: text/plain\r\nContent-Length: 500\r\n\r\n" + line)
            s.shutdown(socket.SHUT_WR)
            assert b" 400 " in s.recv(100)
        assert sorted((tmp_path / "incoming").glob("*.log")) == kept and len(kept) == 2 and not list((tmp_path / "incoming").glob("_*"))
        assert call("/events?limit=0")[0] == 422 and len(call("/events?limit=5")[1]) == 2
    finally:
        server.shutdown()
        server.server_close()


def test_bounds_and_names(spark):
    from logloom.operators.reports import check_bounds, safe_name

    df = spark.createDataFrame([("x" * 10,)] * 3, "line string")
    assert check_bounds(df, "learn") == 3
    for bad in (df.limit(0), spark.createDataFrame([("x" * 70_000,)], "line string")):
        with pytest.raises(ValueError):
            check_bounds(bad, "learn")
    assert safe_name("a b/c") == "a_b_c" and safe_name("1x") == "parser_1x" and safe_name("") == "parser"


def test_late_shapes_get_templates(spark, monkeypatch):
    rows = [(i, f"src=10.0.0.{i % 9} action=deny") for i in range(12_000)] + [(12_000, "src=1 late=yes"), (12_001, "user bob7 logged in from host9"), (12_002, "user al logged in from host9 twice"), (12_003, None)]
    rows += [(13_000 + i, f"unit {a}{b} started") for i, (a, b) in enumerate((a, b) for a in "abcdefghijklm" for b in "nopqrstuvwxyz")]
    lines = spark.createDataFrame(rows, "event_id long, line string")
    monkeypatch.setattr(queries, "event_lines", lambda *_: lines)
    for make in (lambda: [r["regex"] for r in queries.drain_clusters(spark, "").collect()], lambda: [t["regex"] for t in learn.learn_all(spark, lines, "learned", batch=50)]):
        made = make()
        assert len(made) == len({*made}) and [x for _, x in rows if x is not None and not any(re.match(r, x) for r in made)] == []
