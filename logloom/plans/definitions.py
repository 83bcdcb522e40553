"""Parser definitions: their form, validation, and the ones that come with the engine."""

from __future__ import annotations

import copy
import re
from pathlib import Path

import yaml

from logloom.functions.fields import TYPES
from logloom.schemas import CLASS_UIDS

STATES = ("draft", "verified", "active", "drifting", "superseded")
LOADED = ("verified", "active")
FORMATS = ("syslog3164", "key_value", "cef", "json", "csv", "text")
NAME = re.compile(r"[A-Za-z][A-Za-z0-9_-]{0,63}")


class InvalidParser(ValueError):
    pass


def validate(definition: dict) -> dict:
    """The definition, if it has the form of a parser; else InvalidParser."""

    def need(ok: bool, what: str) -> None:
        if not ok:
            raise InvalidParser(what)

    need(isinstance(definition, dict), "a parser definition must be a mapping")
    missing = {"name", "version", "state", "source_format", "envelope", "templates", "unmapped_policy"} - definition.keys()
    need(not missing, f"missing: {sorted(missing)}")
    need(isinstance(definition["name"], str) and bool(definition["name"]), "name must be a text")
    need(isinstance(definition["version"], int) and not isinstance(definition["version"], bool) and definition["version"] >= 1, "version must be 1 or more")
    need(definition["state"] in STATES, f"state must be one of {STATES}")
    need(isinstance(definition["templates"], list) and bool(definition["templates"]), "templates must be a list with something in it")
    for t in definition["templates"]:
        need(isinstance(t, dict) and {"id", "regex", "fields", "event_class", "activity"} <= t.keys(), "a template needs id, regex, fields, event_class and activity")
        for f in t["fields"]:
            need({"name", "type", "ocsf_path", "confidence"} <= f.keys(), "a field needs name, type, ocsf_path and confidence")
            need(f["type"] in TYPES, f"type must be one of {TYPES}")
            need(0 <= f["confidence"] <= 1, "confidence must be from 0 to 1")
    return definition


def _field(name: str, kind: str, path: str, confidence: float) -> dict:
    return {"name": name, "type": kind, "ocsf_path": path, "confidence": confidence}


def _parser(name: str, source_format: str, template: str, regex: str, fields: list[dict], event_class: str, activity: str, timestamp: str) -> dict:
    return {
        "name": name, "version": 1, "state": "verified", "source_format": source_format,
        "envelope": {"header_regex": None, "timestamp_format": timestamp, "tz": "UTC"},
        "templates": [{"id": template, "regex": regex, "fields": fields, "event_class": event_class, "activity": activity}],
        "unmapped_policy": "retain", "created_from": "", "verify_report_ref": None,
    }


# Names, patterns, paths, confidences and classes of the parsers for four well-known formats.
BUILTIN = [
    _parser(
        "asa_syslog", "syslog3164", "asa_deny",
        r"^(?P<ts>[A-Z][a-z]{2}\s+\d+\s+\d{2}:\d{2}:\d{2})\s+(?P<host>\S+)\s+%ASA-\d+-\d+:\s+(?P<action>Deny|Allow)\s+(?P<proto>tcp|udp)\s+src\s+(?P<src_ip>\d+\.\d+\.\d+\.\d+)\/(?P<src_port>\d+)\s+dst\s+(?P<dst_ip>\d+\.\d+\.\d+\.\d+)\/(?P<dst_port>\d+)",
        [_field("action", "enum", "event.action", 0.98), _field("src_ip", "ipv4", "event.src_endpoint.ip", 0.99), _field("dst_ip", "ipv4", "event.dst_endpoint.ip", 0.99)],
        "Network Activity", "deny", "%b %d %H:%M:%S",
    ),
    _parser(
        "cef_generic", "cef", "cef_rule",
        r"^CEF:0\|(?P<device>[^|]+)\|(?P<product>[^|]+)\|(?P<version>[^|]+)\|(?P<event_code>[^|]+)\|(?P<action>[^|]+)\|(?P<severity>\d)\|(?P<rest>.*)$",
        [_field("action", "free_text", "event.action", 0.9), _field("severity", "free_text", "event.severity", 0.8)],
        "Detection Finding", "observe", "%Y-%m-%d %H:%M:%S",
    ),
    _parser(
        "fortigate_kv", "key_value", "fortigate_rule",
        r"^date=(?P<date>\d{4}-\d{2}-\d{2})\s+time=(?P<time>\d{2}:\d{2}:\d{2})\s+log_id=(?P<log_id>\d+)\s+action=(?P<action>deny|accept)\s+srcip=(?P<src_ip>\d+\.\d+\.\d+\.\d+)\s+dstip=(?P<dst_ip>\d+\.\d+\.\d+\.\d+)\s+proto=(?P<proto>tcp|udp)\s+srcport=(?P<src_port>\d+)\s+dstport=(?P<dst_port>\d+)$",
        [_field("action", "enum", "event.action", 0.96), _field("src_ip", "ipv4", "event.src_endpoint.ip", 0.98), _field("dst_ip", "ipv4", "event.dst_endpoint.ip", 0.98)],
        "Network Activity", "accept", "%Y-%m-%d %H:%M:%S",
    ),
    _parser(
        "json_generic", "json", "json_rule", r"^\s*\{.*\}\s*$",
        [_field("action", "free_text", "event.action", 0.85), _field("src_ip", "ipv4", "event.src_endpoint.ip", 0.9)],
        "Network Activity", "record", "%Y-%m-%dT%H:%M:%SZ",
    ),
]


def load(folder: str | Path | None = None, states: tuple[str, ...] = LOADED) -> list[dict]:
    """The parsers of a folder of YAML files by file name, or the ones that come with the engine; only those in the given states."""
    found = copy.deepcopy(BUILTIN) if folder is None else [yaml.safe_load(p.read_text(encoding="utf-8")) for p in sorted(Path(folder).glob("*.yaml"))]
    return [d for d in map(validate, found) if d["state"] in states]


def class_uid(name: str) -> int:
    if name not in CLASS_UIDS:
        raise InvalidParser(f"unknown event class: {name}")
    return CLASS_UIDS[name]
