"""Schemas of the engine's tables."""

from __future__ import annotations

LINE = "path string, source_id string, line_no bigint, byte_offset bigint, raw binary, chunk int, oversized boolean"
RAW_INDEX = "sequence bigint, raw_size bigint, sha256 string, source_id string, source_file string, byte_offset bigint, line_no bigint, raw binary"
QUARANTINE = "reason_code string, detail string, source_id string, source_file string, byte_offset bigint, line_no bigint, raw_sha256 array<string>"

ENDPOINT = "struct<ip:string,port:bigint>"
EVENT = f"struct<action:string,activity_id:bigint,class_name:string,class_uid:bigint,dst_endpoint:{ENDPOINT},message:string,protocol_name:string,severity:string,src_endpoint:{ENDPOINT},time:string,time_source:string,user_name:string>"
FLAGS = "struct<duplicate_count:bigint,duplicate_of:string,masked:boolean,tz_assumed:boolean>"

#: The flat event table, in its column order.
EVENT_COLUMNS = [
    ("event_id", "string"), ("ingest_time", "string"), ("source_id", "string"), ("source_file", "string"), ("byte_offset", "bigint"), ("line_no", "bigint"),
    ("raw", "string"), ("raw_sha256", "string"), ("parser_name", "string"), ("parser_version", "bigint"), ("parser_confidence", "double"), ("event_time", "string"),
    ("class_uid", "bigint"), ("class_name", "string"), ("activity_id", "bigint"), ("action", "string"), ("src_ip", "string"), ("dst_ip", "string"), ("protocol", "string"),
    ("event_json", "string"), ("unmapped_json", "string"), ("flags_json", "string"),
]
EVENTS = ", ".join(f"{n} {t}" for n, t in EVENT_COLUMNS)

#: Ids of the event classes.
CLASS_UIDS = {"Authentication": 3002, "Detection Finding": 2004, "Network Activity": 4001}

#: The reasons why a record is set aside.
REASONS = ("line_too_large", "invalid_utf8", "parser_error", "no_parser_match", "invalid_envelope")

#: Where a parser may put a field: event paths and the columns that hold them.
PATHS = {
    "event.time": "time", "event.action": "action", "event.severity": "severity", "event.message": "message", "event.user_name": "user_name", "event.protocol_name": "protocol_name",
    "event.src_endpoint.ip": "src_ip", "event.src_endpoint.port": "src_port", "event.dst_endpoint.ip": "dst_ip", "event.dst_endpoint.port": "dst_port",
}
