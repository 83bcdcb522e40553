"""Parsers as one expression: each line gets the result of the first template that matches, values and errors alike."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.encode import sorted_map
from logloom.functions.fields import convert
from logloom.functions.once import once
from logloom.functions.regex import optional_groups, to_java
from logloom.schemas import PATHS

PARSED = "struct<parser_name:string,parser_version:bigint,template_id:string,confidence:double,event_class:string,activity:string,error:string,time:string,action:string,severity:string,message:string,user_name:string,protocol_name:string,src_ip:string,src_port:bigint,dst_ip:string,dst_port:bigint,unmapped:map<string,string>,unmapped_json:string,open:map<string,variant>,invalid:string>"
#: Columns of the event that hold numbers; the others hold texts.
NUMBERS = ("src_port", "dst_port")


def trimmed(line: Column) -> Column:
    """The record without the line end."""
    return F.regexp_replace(line, r"[\r\n]+\z", "")


def _captures_udf(pattern: str):
    """Captures with null for groups that took no part; for patterns that have such groups only."""
    compiled = re.compile(re.sub(r"\(\?<(?=[A-Za-z_])", "(?P<", pattern))

    @F.pandas_udf("array<string>")
    def captures(lines: pd.Series) -> pd.Series:
        def one(line):
            m = compiled.search(line)
            return m and [m[n] for n in compiled.groupindex]

        return lines.map(one, na_action="ignore")

    return captures


def event_path(path: str) -> tuple[str, ...] | None:
    """The parts of a path inside the event; None for one that isn't (such values are in no event)."""
    parts = tuple(path.split("."))
    return parts[1:] if parts[0] == "event" else None


def open_paths(definitions: list[dict]) -> list[tuple[str, ...]]:
    """The paths of the parsers' fields that no column of the event holds, in order."""
    found = {event_path(f["ocsf_path"]) for d in definitions for t in d["templates"] for f in t["fields"] if f["ocsf_path"] not in PATHS}
    return sorted(found - {None})


class _Mapped:
    """What a template's fields give: values by column or open path, later fields over earlier ones where both are there, errors in the fields' order."""

    def __init__(self) -> None:
        self.leaves: dict[str, Column] = {}
        self.open: dict[tuple[str, ...], Column] = {}
        self.errors: list[Column] = []
        self.invalid: list[Column] = []
        self.confidence = F.lit(1.0)

    def add(self, field: dict, present: Column, value: Column, error: Column) -> None:
        value, path = F.when(present, value), event_path(field["ocsf_path"])
        self.errors.append(F.when(present, error))
        self.confidence = F.least(self.confidence, F.when(present, F.lit(float(field["confidence"]))))
        if path == () or (path and any(path[: len(p)] == p and path != p or p[: len(path)] == path and p != path for p in map(event_path, PATHS))):
            # a value where the event, or one of its columns or objects, has to be
            bad = path == () or len(path) > 1 or path[0] in ("src_endpoint", "dst_endpoint", "severity", "message", "protocol_name")
            if bad:
                self.invalid.append(F.when(present, F.lit(f"{field['ocsf_path']} has the wrong type")))
        if not path:
            return
        for other in [p for p in self.open if p != path and (p[: len(path)] == path or path[: len(p)] == p)]:
            self.open[other] = F.when(~present, self.open[other])
        if leaf := PATHS.get(field["ocsf_path"]):
            number = field["type"] == "int"
            if leaf in NUMBERS and not number or number and leaf in ("severity", "message", "protocol_name", "src_ip", "dst_ip"):
                self.invalid.append(F.when(value.isNotNull(), F.lit(f"{field['ocsf_path']} has the wrong type")))
            value = value.try_cast("bigint") if leaf in NUMBERS else F.when(present, F.lit(None).cast("string")) if leaf == "action" and number else value.cast("string")
            self.leaves[leaf] = F.coalesce(value, self.leaves[leaf]) if leaf in self.leaves else value
        else:
            made = value.cast("variant")
            self.open[path] = F.coalesce(made, self.open[path]) if path in self.open else made

    def first(self, found: list[Column]) -> Column:
        return (F.coalesce(*found) if found else F.lit(None)).cast("string")


def _result(definition: dict, template: dict, mapped: _Mapped, unmapped: Column, unmapped_json: Column) -> Column:
    kind = lambda name: "bigint" if name in NUMBERS else "string"
    leaf = lambda name: mapped.leaves.get(name, F.lit(None)).cast(kind(name))
    pairs = [x for p, v in sorted(mapped.open.items()) for x in (F.lit(".".join(p)), v)]
    extra = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.lit(None)
    return F.struct(
        F.lit(definition["name"]).alias("parser_name"), F.lit(definition["version"]).cast("bigint").alias("parser_version"), F.lit(template["id"]).alias("template_id"), mapped.confidence.alias("confidence"),
        F.lit(template["event_class"]).alias("event_class"), F.lit(template["activity"]).alias("activity"), mapped.first(mapped.errors).alias("error"),
        *[leaf(n).alias(n) for n in ("time", "action", "severity", "message", "user_name", "protocol_name", "src_ip", "src_port", "dst_ip", "dst_port")], unmapped.alias("unmapped"), unmapped_json.alias("unmapped_json"),
        extra.cast("map<string,variant>").alias("open"), mapped.first(mapped.invalid).alias("invalid"),
    )


def _matches(definition: dict, template: dict, line: Column) -> Column:
    hit = line.rlike(to_java(template["regex"])[0])
    return F.coalesce(hit & F.from_json(line, "map<string,string>").isNotNull() if definition["source_format"] == "json" else hit, F.lit(False))


def _captures(template: dict, line: Column) -> Column:
    """All captures by one run of the pattern: the whole line is replaced by them, with a separator between."""
    pattern, _, numbers = to_java(template["regex"])
    if optional_groups(template["regex"]):
        return _captures_udf(template["regex"])(line)
    whole = rf"(?d)\A(?s:.*?)(?:{pattern.removeprefix('(?d)')})(?s:.*)\z"
    return F.split(F.regexp_replace(line, F.lit(whole), F.lit("\x01".join(f"${n}" for n in numbers))), "\x01", -1)


def _by_regex(definition: dict, template: dict, line: Column) -> Column:
    """The result from the captures in _parts; a capture that holds the separator is taken by itself."""
    pattern, names, numbers = to_java(template["regex"])
    part = lambda i: F.get(F.col("_parts"), F.lit(i))
    if optional_groups(template["regex"]):
        group = {n: part(i) for i, n in enumerate(names)}
    else:
        group = {n: F.when(F.size("_parts") == len(names), part(i)).otherwise(F.regexp_extract(line, pattern, k)) for i, (n, k) in enumerate(zip(names, numbers, strict=True))}
    mapped = _Mapped()
    used = set()
    for f in template["fields"]:
        if f["name"] in group:
            c = group[f["name"]]
            mapped.add(f, c.isNotNull(), *convert(f["type"], c))
            used.add(f["name"])
    rest = sorted(n for n in names if n not in used)
    pairs = [x for n in rest for x in (F.lit(n), group[n])]
    unmapped = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if rest else F.expr("map()").cast("map<string,string>")
    json = F.to_json(F.struct(*[group[n].alias(n) for n in rest])) if rest else F.lit("{}")
    return _result(definition, template, mapped, unmapped, json)


def _by_json(definition: dict, template: dict, line: Column) -> Column:
    texts, typed = F.col("_texts"), F.col("_typed")
    mapped = _Mapped()
    names = []
    for f in template["fields"]:
        kind = F.schema_of_variant(F.try_element_at(typed, F.lit(f["name"])))
        mapped.add(f, F.map_contains_key(texts, F.lit(f["name"])), *convert(f["type"], F.try_element_at(texts, F.lit(f["name"])), kind == "STRING", kind == "BIGINT"))
        names.append(f["name"])
    rest = lambda k, _: ~k.isin(*names) if names else F.lit(True)
    return _result(definition, template, mapped, sorted_map(F.map_filter(texts, rest)), F.to_json(sorted_map(F.map_filter(typed, rest)), {"ignoreNullFields": "false"}))


def _first(cases: list[tuple[Column, Column]], other: Column) -> Column:
    return reduce(lambda rest, x: F.when(x[0], x[1]).otherwise(rest), reversed(cases), other)


def parse(df: DataFrame, definitions: list[dict], line: str = "line", into: str = "parsed") -> DataFrame:
    """df with a struct column (PARSED), null where no template matches. A conversion that fails gives an error, no later template is tried.

    A line is matched until the first pattern that fits, whose captures are then taken by one more run.
    """
    tried = [(i, d, t) for i, (d, t) in enumerate((d, t) for d in definitions for t in d["templates"])]
    if not tried:
        return df.withColumn(into, F.lit(None).cast(PARSED))
    text, hit = trimmed(F.col(line)), F.col("_hit")
    regex, json = [x for x in tried if x[1]["source_format"] != "json"], [x for x in tried if x[1]["source_format"] == "json"]
    out = once(df, {"_hit": _first([(_matches(d, t, text), F.lit(i)) for i, d, t in tried], F.lit(None).cast("int"))})
    is_json = hit.isin(*[i for i, _, _ in json]) if json else F.lit(False)
    out = once(out, {"_parts": _first([(hit == i, _captures(t, text)) for i, _, t in regex], F.lit(None).cast("array<string>")), "_texts": F.when(is_json, F.from_json(text, "map<string,string>")), "_typed": F.when(is_json, F.from_json(text, "map<string,variant>"))})
    results = [(hit == i, (_by_json if d["source_format"] == "json" else _by_regex)(d, t, text).cast(PARSED)) for i, d, t in tried]
    return once(out, {into: _first(results, F.lit(None).cast(PARSED))}).drop("_hit", "_parts", "_texts", "_typed")


def match_count(definitions: list[dict], line: Column) -> Column:
    """How many templates' patterns match the line."""
    found = [F.coalesce(trimmed(line).rlike(to_java(t["regex"])[0]), F.lit(False)).cast("int") for d in definitions for t in d["templates"]]
    return reduce(lambda a, b: a + b, found, F.lit(0))
