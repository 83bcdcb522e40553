"""Ingestion as one flow: lines, parse, envelope, mask, validate, link duplicates; what fails is set aside with a reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.functions import encode, eventtime, privacy
from logloom.functions.once import once
from logloom.plans import definitions as defs
from logloom.plans.compile import open_paths, parse
from logloom.schemas import CLASS_UIDS, EVENT_COLUMNS
from logloom.sources import csvlines
from logloom.sources.lines import MAX_LINE_BYTES, read_lines

#: Files whose CSV headers, a row for each that has one, are broadcast.
MOST_FILES = 100_000
_LEAVES = ("time", "action", "severity", "message", "user_name", "protocol_name", "src_ip", "src_port", "dst_ip", "dst_port")


@dataclass(frozen=True)
class Masking:
    """Truncation of addresses (prefix lengths), and hashing of user names with a salt."""

    addresses: bool = False
    ipv4_prefix: int = 24
    ipv6_prefix: int = 64
    users: bool = False
    salt: str = ""

    def __post_init__(self) -> None:
        if self.users and not self.salt:
            raise ValueError("hashing user names needs a salt")


def event_id(source: Column, offset: Column, sha: Column) -> Column:
    return F.sha2(F.concat_ws(":", source, offset.cast("string"), sha).cast("binary"), 256)


def class_uid(name: Column) -> Column:
    out = F.lit(None).cast("bigint")
    for k, v in CLASS_UIDS.items():
        out = F.when(name == k, F.lit(v).cast("bigint")).otherwise(out)
    return out


def classify(lines: DataFrame, definitions: list[dict], csv: bool = True, max_line_bytes: int = MAX_LINE_BYTES, files: int | None = None) -> DataFrame:
    """lines with line (text), parsed, and reason and detail of what is set aside (null for events; reason header for a CSV header).

    ``lines`` has path, line_no and raw, and may have oversized. ``files``: how many paths there are, if that is known; the
    headers of up to MOST_FILES are broadcast, so that lines aren't shuffled by path.
    """
    text = F.col("raw").cast("string")
    over = F.col("oversized") if "oversized" in lines.columns else F.length("raw") > max_line_bytes
    out = lines.withColumn("_over", over).withColumn("_utf8", F.is_valid_utf8(text)).withColumn("line", F.when(F.col("_utf8") & ~F.col("_over"), text))
    out = parse(out, definitions)
    header = F.lit(False)
    if csv:
        plain = F.regexp_replace("line", r"[\r\n]+\z", "")
        # headers are looked for among first lines; only lines of files that have one go to the splitter
        first = out.where((F.col("line_no") == 1) & F.col("parsed").isNull() & F.col("line").isNotNull())
        heads = first.select(F.col("path").alias("_path"), csvlines.header_of(csvlines.split_csv(plain)).alias("header")).where("header is not null")
        heads = F.broadcast(heads) if files is not None and files <= MOST_FILES else heads
        out = out.join(heads, F.col("path") == F.col("_path"), "left").drop("_path")
        out = out.withColumn("values", csvlines.split_csv(F.when(F.col("header").isNotNull() & F.col("parsed").isNull(), plain)))
        out = csvlines.parse_rows(out)
        header = F.col("header").isNotNull() & (F.col("line_no") == 1)
        out = out.withColumn("parsed", F.coalesce("parsed", F.when(~header, F.col("csv")))).drop("csv", "values")
    reason = F.when(F.col("_over"), "line_too_large").when(~F.col("_utf8"), "invalid_utf8").when(header, "header").when(F.col("parsed").isNull(), "no_parser_match").when(F.col("parsed.error").isNotNull(), "parser_error")
    detail = F.when(F.col("_over"), F.lit(f"line exceeds {max_line_bytes} bytes")).when(~F.col("_utf8"), "record is not valid UTF-8").when(F.col("parsed").isNull(), "no verified parser matched").otherwise(F.col("parsed.error"))
    return out.withColumn("reason", reason).withColumn("detail", F.when(reason.isNotNull(), detail)).drop("_over", "_utf8", "header")


def _tree(values: dict[tuple[str, ...], Column]) -> Column:
    """Nested structs of the values by their paths, keys in order, null without any value. Where a path is both a value and an object in different parsers, it is a variant of what the row has."""
    heads = sorted({p[0] for p in values})
    fields, present = [], F.lit(False)
    for head in heads:
        own = values.get((head,))
        inner = {p[1:]: v for p, v in values.items() if len(p) > 1 and p[0] == head}
        found = _tree(inner) if inner else own
        if inner and own is not None:
            found = F.coalesce(own, F.try_parse_json(F.to_json(found)))
        fields.append(found.alias(head))
        present = present | found.isNotNull()
    return F.when(present, F.struct(*fields))


def envelopes(classified: DataFrame, ingest_time: Column, zone: str = "UTC", masking: Masking = Masking(), open_paths: list[tuple[str, ...]] = ()) -> DataFrame:
    """The events' envelopes: event_id, ingest_time, source, raw, raw_sha256, parser, event, unmapped, unmapped_json, flags, invalid.

    The event has its fixed fields and the parsers' ``open_paths``, at their places, as variants.
    """
    p = lambda n: F.col(f"parsed.{n}")
    rows = classified.where("reason is null")
    u = {k: F.try_element_at(p("unmapped"), F.lit(k)) for k in ("time", "date", "ts")}
    rows = eventtime.resolve(rows, u, p("time"), ingest_time, zone).withColumn("_sha", F.sha2(F.col("raw"), 256))
    sha = F.col("_sha")
    values = {n: p(n) for n in _LEAVES}
    extra = {path: F.try_element_at(p("open"), F.lit(".".join(path))) for path in open_paths}
    unmapped, unmapped_json, masked = p("unmapped"), p("unmapped_json"), F.lit(False)
    if masking.addresses or masking.users:
        hide = (masking.ipv4_prefix, masking.ipv6_prefix) if masking.addresses else (None, None)
        salt = masking.salt if masking.users else None
        before, seen = dict(values), dict(extra)
        if masking.addresses:
            values |= {n: privacy.mask_address(values[n], *hide) for n in ("src_ip", "dst_ip")}
        if salt:
            values["user_name"] = privacy.hash_user(values["user_name"], salt)
        extra = {path: privacy.mask_variant(v, path[-1], *hide, salt) for path, v in extra.items()}
        rows = once(rows, {"_hidden": privacy.mask_json(p("unmapped_json"), *hide, salt)})
        masked = F.col("_hidden").isNotNull()
        for a, b in [(before[n], values[n]) for n in ("src_ip", "dst_ip", "user_name")] + [(F.to_json(seen[x]), F.to_json(extra[x])) for x in extra if extra[x] is not seen[x]]:
            masked = masked | F.coalesce(a != b, F.lit(False))
        unmapped_json = F.coalesce("_hidden", unmapped_json)
        unmapped = F.when(F.col("_hidden").isNotNull(), F.from_json("_hidden", "map<string,string>")).otherwise(unmapped)
    own = {
        ("action",): F.lower(F.coalesce(values["action"], p("activity"))), ("activity_id",): F.lit(0).cast("bigint"), ("class_name",): p("event_class"), ("class_uid",): class_uid(p("event_class")), ("dst_endpoint", "ip"): values["dst_ip"], ("dst_endpoint", "port"): values["dst_port"],
        ("message",): values["message"], ("protocol_name",): values["protocol_name"], ("severity",): values["severity"], ("src_endpoint", "ip"): values["src_ip"], ("src_endpoint", "port"): values["src_port"], ("time",): F.col("_time"), ("time_source",): F.col("_source"), ("user_name",): values["user_name"],
    }
    event = _tree({path: v for path, v in extra.items() if not any(path[: len(o)] == o or o[: len(path)] == path for o in own)} | own)
    file = F.element_at(F.split(F.col("path"), "/"), -1)
    return rows.select(F.explode(F.array(F.struct(
        event_id(F.col("source_id"), F.col("byte_offset"), sha).alias("event_id"), eventtime.render(ingest_time).alias("ingest_time"), F.struct(F.col("source_id").alias("id"), file.alias("file"), F.col("byte_offset"), F.col("line_no")).alias("source"),
        F.col("line").alias("raw"), sha.alias("raw_sha256"), F.struct(p("parser_name").alias("name"), p("parser_version").alias("version"), p("confidence").alias("confidence")).alias("parser"),
        event.alias("event"), unmapped.alias("unmapped"), encode.plain_json(unmapped_json).alias("unmapped_json"), masked.alias("_masked"), F.col("_assumed"), F.col("path"), p("invalid").alias("_invalid"),
    ))).alias("e")).select("e.*").withColumn("invalid", F.coalesce("_invalid", F.when(~valid(), F.lit("envelope breaks a constraint")))).drop("_invalid")


def valid() -> Column:
    """The envelope's constraints as one predicate."""
    c = F.col
    return F.coalesce(
        (c("event_id") != "") & (c("source.byte_offset") >= 0) & (c("source.line_no") >= 1) & c("raw_sha256").rlike(r"\A[a-f0-9]{64}\z") & (c("parser.version") >= 1) & c("parser.confidence").between(0, 1)
        & c("event.time").isNotNull() & c("event.class_name").isNotNull() & c("event.class_uid").isNotNull() & c("event.action").isNotNull(),
        F.lit(False),
    )


def link_duplicates(rows: DataFrame) -> DataFrame:
    """flags for valid envelopes: equal events (after masking) of a file are linked to the first of them by offset."""
    key = F.sha2(F.to_json("event").cast("binary"), 256)
    w = Window.partitionBy("path", "_key").orderBy("source.byte_offset")
    rows = rows.withColumn("_key", key).withColumn("_n", F.row_number().over(w).cast("bigint")).withColumn("_first", F.first("event_id").over(w))
    flags = F.struct((F.col("_n") - 1).alias("duplicate_count"), F.when(F.col("_n") > 1, F.col("_first")).alias("duplicate_of"), F.col("_masked").alias("masked"), F.col("_assumed").alias("tz_assumed"))
    return rows.withColumn("flags", flags).drop("_key", "_n", "_first", "_masked", "_assumed", "path", "invalid")


def flatten(events: DataFrame) -> DataFrame:
    """Envelopes as the flat event table, its JSON in ASCII. protocol is that of event.network, which only an open path can fill."""
    c = F.col
    network = dict(events.select("event.*").dtypes).get("network", "")
    protocol = F.try_variant_get(c("event.network.protocol"), "$", "string") if network.startswith("struct<") and "protocol:" in network else F.lit(None)
    columns = {
        "event_id": c("event_id"), "ingest_time": c("ingest_time"), "source_id": c("source.id"), "source_file": c("source.file"), "byte_offset": c("source.byte_offset"), "line_no": c("source.line_no"), "raw": c("raw"), "raw_sha256": c("raw_sha256"),
        "parser_name": c("parser.name"), "parser_version": c("parser.version"), "parser_confidence": c("parser.confidence"), "event_time": c("event.time"), "class_uid": c("event.class_uid"), "class_name": c("event.class_name"), "activity_id": c("event.activity_id"),
        "action": c("event.action"), "src_ip": c("event.src_endpoint.ip"), "dst_ip": c("event.dst_endpoint.ip"), "protocol": protocol, "event_json": encode.ascii_json(encode.canonical(c("event"))), "unmapped_json": encode.ascii_json(c("unmapped_json")), "flags_json": encode.canonical(c("flags"), nulls=True),
    }
    return events.select(*[columns[n].cast(t).alias(n) for n, t in EVENT_COLUMNS])


@dataclass
class Ingested:
    """raw: every line or chunk; events: envelopes; quarantine: what was set aside. records = events + quarantine + headers."""

    raw: DataFrame
    events: DataFrame
    quarantine: DataFrame
    classified: DataFrame

    def flat(self) -> DataFrame:
        return flatten(self.events)

    def counts(self) -> DataFrame:
        """One row: records, events, quarantined, headers. An oversized line is one record."""
        n = lambda c: F.count_if(c)
        first = self.classified.where((F.col("reason") != "line_too_large") | F.col("reason").isNull() | (F.coalesce(F.col("chunk"), F.lit(0)) == 0)) if "chunk" in self.classified.columns else self.classified
        return first.agg(F.count(F.lit(1)).alias("records"), n(F.col("reason").isNull()).alias("events"), n(F.col("reason").isNotNull() & (F.col("reason") != "header")).alias("quarantined"), n(F.coalesce(F.col("reason") == "header", F.lit(False))).alias("headers"))


def ingest_lines(lines: DataFrame, definitions: list[dict] | None = None, ingest_time: Column | None = None, zone: str = "UTC", masking: Masking = Masking(), csv: bool = True, max_line_bytes: int = MAX_LINE_BYTES, files: int | None = None) -> Ingested:
    """lines: path, source_id, line_no, byte_offset, raw (binary), and chunk and oversized if there may be chunks."""
    definitions = defs.load() if definitions is None else definitions
    now = F.current_timestamp() if ingest_time is None else ingest_time
    classified = classify(lines, definitions, csv, max_line_bytes, files)
    made = envelopes(classified, now, zone, masking, open_paths(definitions))
    events = link_duplicates(made.where("invalid is null"))
    aside = classified.where("reason is not null and reason <> 'header'")
    file = F.element_at(F.split(F.col("path"), "/"), -1)
    aside = aside.groupBy(F.col("reason").alias("reason_code"), F.col("detail"), "source_id", file.alias("source_file"), "line_no", "path").agg(F.min("byte_offset").alias("byte_offset"), F.transform(F.array_sort(F.collect_list(F.struct("byte_offset", F.sha2("raw", 256).alias("s")))), lambda x: x["s"]).alias("raw_sha256")).drop("path")
    bad = made.where("invalid is not null").select(F.lit("invalid_envelope").alias("reason_code"), F.col("invalid").alias("detail"), F.col("source.id").alias("source_id"), F.col("source.file").alias("source_file"), F.col("source.byte_offset").alias("byte_offset"), F.col("source.line_no").alias("line_no"), F.array("raw_sha256").alias("raw_sha256"))
    raw = lines.select("path", "source_id", "line_no", "byte_offset", F.length("raw").cast("bigint").alias("raw_size"), F.sha2("raw", 256).alias("sha256"), "raw")
    return Ingested(raw, events, aside.unionByName(bad), classified)


def ingest(spark: SparkSession, path: str | list[str], **options) -> Ingested:
    """Ingests log files: every byte is kept in raw, every record is an event, set aside, or a CSV header."""
    lines = read_lines(spark, path, options.get("max_line_bytes", MAX_LINE_BYTES))
    return ingest_lines(lines, files=len(lines.inputFiles()), **options)
