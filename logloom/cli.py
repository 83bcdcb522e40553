"""Command line: run, query, export, health, learn, verify, activate, monitor, trace, verify-event, verify-store, serve, bench, parsers, version."""

from __future__ import annotations

import argparse
import json
import sys
import time
import uuid
from pathlib import Path

import yaml

from logloom.session import session

VERSION = "0.1.0"


def _store(args, name: str) -> str:
    return f"{args.data}/{name}"


def run(args, spark) -> dict:
    from logloom.operators.ingest import Masking, ingest
    from logloom.operators.store import write_events, write_quarantine, write_raw
    from logloom.plans.definitions import load

    made = ingest(spark, args.file, definitions=load(args.parsers), masking=Masking(addresses=args.mask_ips, users=args.hash_users, salt=args.salt))
    made.classified.persist()
    try:
        write_raw(made.raw, _store(args, "raw"))
        batch = write_events(made.flat(), _store(args, "events"))
        write_quarantine(made.quarantine, _store(args, "quarantine"))
        return {"batch": batch} | made.counts().first().asDict()
    finally:
        made.classified.unpersist()


def query(args, spark) -> list:
    from logloom.plans.sqlgate import query_path

    return [r.asDict(True) for r in query_path(spark, _store(args, "events"), args.sql).collect()]


def export(args, spark) -> dict:
    from logloom.operators.export import export as write
    from logloom.operators.ingest import ingest
    from logloom.plans.definitions import load

    return {"exported": write(ingest(spark, args.file, definitions=load(args.parsers)).events, args.out, args.form)}


def health(args, spark) -> dict:
    from logloom.plans.definitions import load

    return {"status": "ok", "version": VERSION, "parsers": len(load(args.parsers))}


def learn(args, spark) -> dict:
    from logloom.plans.learn import MAX_BYTES
    from logloom.plans.learn import learn as draft

    if Path(args.file).stat().st_size > MAX_BYTES:
        raise ValueError(f"samples have at most {MAX_BYTES} bytes")
    made = draft(spark, [x for x in Path(args.file).read_text(encoding="utf-8").splitlines() if x.strip()], args.name, created_from=args.file)
    out = Path(args.out) / f"{args.name}.yaml"
    with out.open("x", encoding="utf-8") as f:
        yaml.safe_dump(made.definition, f, sort_keys=False)
    with (Path(args.out) / "review.jsonl").open("a", encoding="utf-8") as f:
        f.write(json.dumps(made.review(), sort_keys=True) + "\n")
    return made.review()


def _parser(path: str) -> dict:
    from logloom.plans.definitions import validate

    return validate(yaml.safe_load(Path(path).read_text(encoding="utf-8")))


def _save(path: str, definition: dict) -> None:
    temporary = Path(path).with_suffix(".tmp")
    temporary.write_text(yaml.safe_dump(definition, sort_keys=False), encoding="utf-8")
    temporary.replace(path)


def verify(args, spark) -> dict:
    from logloom.operators.verify import transition
    from logloom.operators.verify import verify as check

    from logloom.operators.reports import check_bounds, verification_report

    cases = spark.read.schema("raw string, expected_template_id string, required_fields array<string>").json(args.cases).na.fill("").selectExpr("raw", "nullif(expected_template_id, '') expected_template_id", "coalesce(required_fields, array()) required_fields")
    definition = _parser(args.parser)
    check_bounds(cases, "verify", "raw")
    report = check(cases, definition)
    Path(args.report).write_text(json.dumps(report, sort_keys=True, indent=2), encoding="utf-8")
    verification_report(report, Path(args.report).parent)
    if report["valid"]:
        _save(args.parser, transition(definition, "verified", reference=args.report))
    return report


def activate(args, spark) -> dict:
    from logloom.operators.verify import transition

    _save(args.parser, out := transition(_parser(args.parser), "active", report=json.loads(Path(args.report).read_text(encoding="utf-8"))))
    return {"parser_name": out["name"], "state": out["state"]}


def monitor(args, spark) -> dict:
    from pyspark.sql import functions as F

    from logloom.operators.monitor import batch_digest, report, unmatched
    from logloom.operators.reports import check_bounds, monitor_report
    from logloom.operators.verify import transition
    from logloom.plans.learn import learn as draft
    from logloom.sources.lines import byte_lines

    definition = _parser(args.parser)
    lines = spark.read.format("binaryFile").load(args.file).select(F.posexplode(byte_lines(F.decode("content", "UTF-8"))).alias("line_no", "line"))
    check_bounds(lines, "monitor")
    out = report(lines, [definition], definition["name"], args.min_coverage, args.min_confidence).first().asDict()
    if args.out:
        monitor_report(out, definition["name"], batch_digest(lines, "line_no").first()[0], args.out)
    if out["drifting"]:
        rest = [r["line"] for r in unmatched(lines, [definition], definition["name"], "line_no").collect()]
        if rest and args.out:
            made = draft(spark, rest, f"{definition['name']}-draft", created_from=args.file).definition
            at = Path(args.out) / f"{definition['name']}-draft.yaml"
            if at.exists() and yaml.safe_load(at.read_text(encoding="utf-8")) != made:
                raise ValueError(f"{at} is another draft; it is not replaced")
            _save(str(at), made)
        if definition["state"] == "active":
            _save(args.parser, transition(definition, "drifting"))
    return out


def trace(args, spark) -> list:
    from logloom.operators.lineage import trace_event

    return [r.asDict(True) for r in trace_event(spark.read.parquet(_store(args, "events")), spark.read.parquet(_store(args, "raw")), args.event_id).collect()]


def verify_event(args, spark) -> dict:
    """An envelope as JSON: its constraints, its digest, and with --store the raw line that it came from."""
    from pyspark.sql import functions as F

    from logloom.operators.ingest import valid
    from logloom.operators.store import read_record

    schema = "event_id string, ingest_time string, source struct<id:string,file:string,byte_offset:bigint,line_no:bigint>, raw string, raw_sha256 string, parser struct<name:string,version:bigint,confidence:double>, event struct<time:string,class_uid:bigint,class_name:string,action:string>"
    row = spark.read.schema(schema).json(args.event).select("*", valid().alias("valid"), (F.sha2(F.col("raw").cast("binary"), 256) == F.col("raw_sha256")).alias("same")).first()
    errors = [] if row and row["valid"] else ["envelope breaks a constraint"]
    if row and not row["same"]:
        errors.append("raw SHA-256 mismatch")
    if row and args.store:
        try:
            if read_record(spark, args.store, row["source"]["id"], row["source"]["byte_offset"]) != row["raw"].encode():
                errors.append("raw store differs")
        except (KeyError, ValueError) as e:
            errors.append(str(e))
    return {"valid": not errors, "errors": errors}


def serve(args, spark) -> dict:
    from logloom.server import Service
    from logloom.server import serve as make

    server = make(Service(spark, args.data if ":" in args.data else Path(args.data), args.parsers), args.host, args.port)
    try:
        server.serve_forever()
    finally:
        server.server_close()
    return {"stopped": True}


def verify_store(args, spark) -> dict:
    from logloom.operators.lineage import orphans
    from logloom.operators.lineage import verify_store as faults

    raw = spark.read.parquet(_store(args, "raw"))
    every = faults(raw)
    n = every.count()
    lost = orphans(spark.read.parquet(_store(args, "events")), raw).count()
    return {"valid": not n and not lost, "fault_count": n, "first_faults": [r.asDict() for r in every.orderBy("sequence").limit(100).collect()], "orphans": lost}


def bench(args, spark) -> dict:
    """Lines of a generated file, from reading them to stored tables; the report beside the data."""
    from logloom.operators import store
    from logloom.operators.ingest import ingest
    from logloom.operators.reports import benchmark_report
    from logloom.sources.synthetic import generate

    at = _store(args, f"bench-{uuid.uuid4().hex}")
    generate(spark, args.n, args.form).select("line").coalesce(1).write.text(f"{at}/log")
    began = time.time()
    made = ingest(spark, f"{at}/log")
    made.classified.persist()
    try:
        store.write_raw(made.raw, f"{at}/raw")
        store.write_events(made.flat(), f"{at}/events")
        store.write_quarantine(made.quarantine, f"{at}/quarantine")
    finally:
        made.classified.unpersist()
    took = time.time() - began
    out = {"form": args.form, "records": args.n, "stored_events": spark.read.parquet(f"{at}/events").count(), "seconds": round(took, 3), "events_per_second": round(args.n / took, 1)}
    if args.out:
        benchmark_report(out, args.out)
    return out


def parsers(args, spark) -> list:
    from logloom.plans.definitions import STATES, load

    return [{"name": d["name"], "version": d["version"], "state": d["state"], "source_format": d["source_format"]} for d in load(args.parsers, STATES)]


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="logloom")
    p.add_argument("--data", default="data")
    p.add_argument("--parsers")
    sub = p.add_subparsers(dest="command", required=True)
    options = {
        run: [("file",), ("--mask-ips",), ("--hash-users",), ("--salt", "")], query: [("sql",)], export: [("file",), ("out",), ("--form", "ndjson")], learn: [("file",), ("name",), ("out",)], verify: [("parser",), ("cases",), ("report",)],
        activate: [("parser",), ("report",)], monitor: [("parser",), ("file",), ("--out", ""), ("--min-coverage", 0.9), ("--min-confidence", 0.8)], trace: [("event_id",)], verify_event: [("event",), ("--store", "")], verify_store: [], health: [], serve: [("--host", "127.0.0.1"), ("--port", 8000)], bench: [("--n", 100_000), ("--form", "fortigate"), ("--out", "")], parsers: [],
    }
    for f, found in options.items():
        s = sub.add_parser(f.__name__.replace("_", "-"))
        for name, *default in found:
            s.add_argument(name, **({"type": type(default[0]), "default": default[0]} if default else {"action": "store_true"} if name.startswith("--") else {}))
        s.set_defaults(call=f)
    sub.add_parser("version").set_defaults(call=lambda args, spark: {"version": VERSION})
    args = p.parse_args(argv)
    try:
        print(json.dumps(args.call(args, session() if args.command != "version" else None), sort_keys=True, default=str))
    except (ValueError, KeyError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
