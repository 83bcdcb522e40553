"""Export of events as NDJSON, CEF or syslog text; all rows are checked before anything is written."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import encode

MAX_BYTES, MAX_LINE = 1 << 30, 1 << 20


def envelope_json() -> Column:
    """The envelope as canonical JSON: keys in order at every level, compact; null fields of the event are left out, those of flags stay."""
    c = F.col
    named = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    text = lambda x: encode.plain_json(F.regexp_replace(F.to_json(F.array(x)), r"\A\[|\]\z", ""))
    parts = [
        named("event", encode.plain_json(encode.canonical(c("event")))), named("event_id", text(c("event_id"))), named("flags", encode.canonical(c("flags"), nulls=True)), named("ingest_time", text(c("ingest_time"))),
        named("parser", F.to_json(F.struct(c("parser.confidence").alias("confidence"), c("parser.name").alias("name"), c("parser.version").alias("version")))), named("raw", text(c("raw"))), named("raw_sha256", text(c("raw_sha256"))),
        named("source", F.to_json(F.struct(c("source.byte_offset").alias("byte_offset"), c("source.file").alias("file"), c("source.id").alias("id"), c("source.line_no").alias("line_no")))), named("unmapped", c("unmapped_json")),
    ]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def cef_line(event_id: Column, json: Column, class_uid: Column, class_name: Column, severity: Column, fields: dict[str, Column], vendor: str = "logloom", product: str = "Event", version: str = "1.0", label: str = "EnvelopeBase64") -> Column:
    """fields: rt, act, src, dst, spt, dpt by key; null or empty ones are left out."""
    header = F.concat_ws("|", F.lit("CEF:0"), encode.cef_header(F.lit(vendor)), encode.cef_header(F.lit(product)), encode.cef_header(F.lit(version)), encode.cef_header(F.coalesce(class_uid.cast("string"), F.lit("0"))), encode.cef_header(F.coalesce(class_name, F.lit("Event"))), encode.cef_severity(severity))
    ordered = [("externalId", event_id), *[(k, fields[k]) for k in ("rt", "act", "src", "dst") if k in fields], ("cs1Label", F.lit(label)), ("cs1", encode.base64_text(json)), *[(k, fields[k].cast("string")) for k in ("spt", "dpt") if k in fields]]
    pairs = [F.when(v != "", F.concat(F.lit(k + "="), encode.cef_extension(v))) for k, v in ordered]
    return F.concat(header, F.lit("|"), F.concat_ws(" ", *pairs))


def syslog_line(event_id: Column, json: Column, time: Column, raw_sha256: Column, app: str = "logloom") -> Column:
    message = F.to_json(F.struct(encode.base64_text(json).alias("envelope_base64"), event_id.alias("event_id"), raw_sha256.alias("raw_sha256")))
    return F.concat(F.lit("<134>1 "), time, F.lit(f" {app} {app} - - "), message)


def lines(events: DataFrame, form: str) -> DataFrame:
    """(value) per envelope in the form ndjson, cef or syslog."""
    json, c = envelope_json(), F.col
    if form == "ndjson":
        value = json
    elif form == "cef":
        fields = {"rt": c("event.time"), "act": c("event.action"), "src": c("event.src_endpoint.ip"), "dst": c("event.dst_endpoint.ip"), "spt": c("event.src_endpoint.port"), "dpt": c("event.dst_endpoint.port")}
        value = cef_line(c("event_id"), json, c("event.class_uid"), c("event.class_name"), c("event.severity"), fields)
    elif form == "syslog":
        value = syslog_line(c("event_id"), json, F.coalesce(F.nullif(c("event.time"), F.lit("")), c("ingest_time")), c("raw_sha256"))
    else:
        raise ValueError("form is ndjson, cef or syslog")
    return events.select(value.alias("value"))


def _replace(spark: SparkSession, made: str, path: str) -> None:
    """Puts the folder ``made`` in the place of ``path`` by renames; if the last one fails, the old folder is put back."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    new, now, old = place(made), place(path), place(f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")
    fs = now.getFileSystem(spark._jsc.hadoopConfiguration())
    there = fs.exists(now)
    if there and not fs.rename(now, old):
        raise OSError(f"can't replace {path}")
    if not fs.rename(new, now):
        if there:
            fs.rename(old, now)
        raise OSError(f"can't write {path}")
    if there:
        fs.delete(old, True)


def export(events: DataFrame, path: str, form: str, max_bytes: int = MAX_BYTES, max_line: int = MAX_LINE) -> int:
    """Writes the lines as text under path, all or nothing: a missing value, a line that is too long or too much altogether raises before anything is written.

    The lines are written beside the path and take its place when they are complete, so a write that fails leaves an older export as it was.
    """
    spark = events.sparkSession
    out = lines(events, form).persist()
    beside = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    try:
        n, bad, longest, total = out.agg(F.count(F.lit(1)), F.count_if(F.col("value").isNull()), F.max(F.octet_length("value")), F.sum(F.octet_length("value") + 1)).first()
        if bad:
            raise ValueError(f"{bad} envelopes are incomplete")
        if (longest or 0) > max_line or (total or 0) > max_bytes:
            raise ValueError("export is beyond its limits")
        out.write.text(beside)
        _replace(spark, beside, path)
        return n
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(beside)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        out.unpersist()
