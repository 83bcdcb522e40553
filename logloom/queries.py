"""The engine's queries over the test tables, and the same in SQL for DuckDB. Log lines are rendered from rows alike in both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.functions import encode, eventtime, privacy
from logloom.functions.fields import convert
from logloom.operators import export as exporting
from logloom.operators import ingest, lineage, monitor, verify
from logloom.plans import definitions as defs
from logloom.plans import learn, sqlgate
from logloom.plans.compile import match_count, parse
from logloom.session import spread
from logloom.sources import csvlines, lines, synthetic

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
INGEST = "2026-09-30 12:00:00"
DENY = ("error", "click")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def only(name: str) -> list[dict]:
    return [d for d in defs.load() if d["name"] == name]


def ingest_time() -> Column:
    return F.to_timestamp(F.lit(INGEST))


# Lines of the events table, and their SQL.
_DENY_SQL = "event_type IN ('error', 'click')"
_FORTI_SQL = f"""'date=' || strftime(ts, '%Y-%m-%d') || ' time=' || strftime(ts, '%H:%M:%S') || ' log_id=' || event_id || ' action=' || CASE WHEN {_DENY_SQL} THEN 'deny' ELSE 'accept' END
 || ' srcip=10.0.' || ((user_id // 256) % 256) || '.' || (user_id % 256) || ' dstip=203.0.' || ((event_id // 256) % 256) || '.' || (event_id % 256)
 || ' proto=' || CASE WHEN event_id % 2 = 0 THEN 'tcp' ELSE 'udp' END || ' srcport=' || (1024 + event_id % 50000) || ' dstport=' || CASE WHEN event_id % 3 = 0 THEN 443 ELSE 53 END"""
_ASA_SQL = f"""strftime(ts, '%b') || ' ' || day(ts) || ' ' || strftime(ts, '%H:%M:%S') || ' fw01 %ASA-4-106023: ' || CASE WHEN {_DENY_SQL} THEN 'Deny' ELSE 'Allow' END || CASE WHEN event_id % 2 = 0 THEN ' tcp' ELSE ' udp' END
 || ' src 10.0.' || ((user_id // 256) % 256) || '.' || (user_id % 256) || '/' || (1024 + event_id % 50000) || ' dst 203.0.' || ((event_id // 256) % 256) || '.' || (event_id % 256) || '/443 by access-group "OUTSIDE_IN"'"""
_JSON_SQL = f"""'{{"time":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","src_ip":"10.0.' || ((user_id // 256) % 256) || '.' || (user_id % 256) || '","action":"' || CASE WHEN {_DENY_SQL} THEN 'deny' ELSE 'accept' END
 || '","dst_port":' || CASE WHEN event_id % 3 = 0 THEN 443 ELSE 53 END || ',"protocol":"' || CASE WHEN event_id % 2 = 0 THEN 'tcp' ELSE 'udp' END || '"}}'"""
_CEF_SQL = "'CEF:0|Edge|Wall|7.0|' || o_orderkey || '|' || CASE WHEN o_orderstatus = 'F' THEN 'Deny' ELSE 'Accept' END || '|' || (o_orderkey % 10) || '|src=10.0.0.' || (o_orderkey % 256) || ' dst=203.0.113.4 proto=tcp spt=443 dpt=443 msg=flow'"


def event_lines(spark: SparkSession, sf_dir: str, form: str = "fortigate") -> DataFrame:
    c = F.col
    return spread(table(spark, sf_dir, "events")).withColumn("line", getattr(synthetic, form)(c("ts"), c("event_id"), c("event_type").isin(*DENY), c("user_id")))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "orders")).withColumn("line", synthetic.cef(F.col("o_orderkey"), F.col("o_orderstatus") == "F", F.col("o_orderkey") % 10))


def _regex(name: str) -> str:
    return only(name)[0]["templates"][0]["regex"].replace("'", "''")


def _names(name: str) -> str:
    from logloom.functions.regex import group_names

    return "[" + ", ".join(f"'{n}'" for n in group_names(only(name)[0]["templates"][0]["regex"])) + "]"


def raw_lines(df: DataFrame, path: Column, offset: Column, number: Column) -> DataFrame:
    return df.select(path.alias("path"), lines.source_id(path).alias("source_id"), number.cast("bigint").alias("line_no"), offset.cast("bigint").alias("byte_offset"), F.col("line").cast("binary").alias("raw"))


@query(f"SELECT event_id, g.date AS date, g.time AS time, g.log_id AS log_id, g.action AS action, g.src_ip AS src_ip, g.dst_ip AS dst_ip, g.proto AS proto, g.src_port AS src_port, g.dst_port AS dst_port, 0.96::DOUBLE AS confidence FROM (SELECT event_id, regexp_extract({_FORTI_SQL}, '{_regex('fortigate_kv')}', {_names('fortigate_kv')}) AS g FROM events)")
def parse_fortigate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = parse(event_lines(spark, sf_dir), only("fortigate_kv"))
    u = lambda k: F.col(f"parsed.unmapped.{k}").alias(k)
    return out.select("event_id", u("date"), u("time"), u("log_id"), "parsed.action", "parsed.src_ip", "parsed.dst_ip", u("proto"), u("src_port"), u("dst_port"), "parsed.confidence")


@query(f"SELECT event_id, g.ts AS ts, g.host AS host, g.action AS action, g.proto AS proto, g.src_ip AS src_ip, g.src_port AS src_port, g.dst_ip AS dst_ip, g.dst_port AS dst_port, 0.98::DOUBLE AS confidence FROM (SELECT event_id, regexp_extract({_ASA_SQL}, '{_regex('asa_syslog')}', {_names('asa_syslog')}) AS g FROM events)")
def parse_asa(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = parse(event_lines(spark, sf_dir, "asa"), only("asa_syslog"))
    u = lambda k: F.col(f"parsed.unmapped.{k}").alias(k)
    return out.select("event_id", u("ts"), u("host"), "parsed.action", u("proto"), "parsed.src_ip", u("src_port"), "parsed.dst_ip", u("dst_port"), "parsed.confidence")


@query(f"SELECT o_orderkey, g.device AS device, g.event_code AS event_code, g.action AS action, g.severity AS severity, g.rest AS rest, 0.8::DOUBLE AS confidence FROM (SELECT o_orderkey, regexp_extract({_CEF_SQL}, '{_regex('cef_generic')}', {_names('cef_generic')}) AS g FROM orders)")
def parse_cef(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = parse(order_lines(spark, sf_dir), only("cef_generic"))
    u = lambda k: F.col(f"parsed.unmapped.{k}").alias(k)
    return out.select("o_orderkey", u("device"), u("event_code"), "parsed.action", "parsed.severity", u("rest"), "parsed.confidence")


@query(f"""SELECT event_id, j->>'$.action' AS action, j->>'$.src_ip' AS src_ip, 0.85::DOUBLE AS confidence,
 '{{"dst_port":' || (j->>'$.dst_port') || ',"protocol":"' || (j->>'$.protocol') || '","time":"' || (j->>'$.time') || '"}}' AS unmapped_json FROM (SELECT event_id, ({_JSON_SQL})::JSON AS j FROM events)""")
def parse_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(event_lines(spark, sf_dir, "json"), only("json_generic")).select("event_id", "parsed.action", "parsed.src_ip", "parsed.confidence", "parsed.unmapped_json")


_MIXED_SQL = f"SELECT {_FORTI_SQL} AS line FROM events UNION ALL SELECT {_ASA_SQL} FROM events UNION ALL SELECT {_JSON_SQL} FROM events UNION ALL SELECT {_CEF_SQL} FROM orders UNION ALL SELECT text FROM documents"
_ROUTE_SQL = f"CASE WHEN regexp_matches(line, '{_regex('asa_syslog')}') THEN 'asa_deny' WHEN regexp_matches(line, '{_regex('cef_generic')}') THEN 'cef_rule' WHEN regexp_matches(line, '{_regex('fortigate_kv')}') THEN 'fortigate_rule' WHEN regexp_matches(line, '{_regex('json_generic')}') THEN 'json_rule' END"


def mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [*(event_lines(spark, sf_dir, f).select("line") for f in ("fortigate", "asa", "json")), order_lines(spark, sf_dir).select("line"), table(spark, sf_dir, "documents").select(F.col("text").alias("line"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@query(f"SELECT template_id, count(*) AS n FROM (SELECT {_ROUTE_SQL} AS template_id FROM ({_MIXED_SQL})) GROUP BY template_id")
def first_match_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(mixed_lines(spark, sf_dir), defs.load()).groupBy(F.col("parsed.template_id").alias("template_id")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN strlen(line) > 8192 THEN 'line_too_large' WHEN line LIKE '%"src_ip":"10.0.0.7"%' THEN NULL WHEN {_ROUTE_SQL} IS NULL THEN 'no_parser_match'
 WHEN regexp_matches(line, '999[.]') THEN 'parser_error' END AS reason FROM ({_MIXED_SQL} UNION ALL SELECT '{{"src_ip":"999.0.0.' || event_id || '"}}' FROM events WHERE event_id % 7 = 0)) GROUP BY reason""")
def quarantine_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = table(spark, sf_dir, "events").where("event_id % 7 = 0").select(F.concat(F.lit('{"src_ip":"999.0.0.'), F.col("event_id").cast("string"), F.lit('"}')).alias("line"))
    rows = raw_lines(mixed_lines(spark, sf_dir).unionAll(bad), F.lit("/logs/mixed"), F.lit(0), F.lit(2))
    return ingest.classify(rows, defs.load(), csv=False, max_line_bytes=8192).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, lower(c_mktsegment) AS action, c_name AS user_name, '{\"balance\":\"' || c_custkey % 100 || '\",\"nation\":\"' || c_nationkey || '\"}' AS unmapped_json, 0.9::DOUBLE AS confidence FROM customer")
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = table(spark, sf_dir, "customer").withColumn("line", F.concat_ws(",", F.lower("c_mktsegment"), c("c_name"), c("c_nationkey").cast("string"), F.concat(F.lit('"'), (c("c_custkey") % 100).cast("string"), F.lit('"'))))
    header = csvlines.header_of(F.array(*[F.lit(x) for x in ("Action", "User-Name", "nation", "balance")]))
    out = csvlines.parse_rows(rows.withColumn("header", header).withColumn("values", csvlines.split_csv("line")))
    return out.select("c_custkey", "csv.action", "csv.user_name", "csv.unmapped_json", "csv.confidence")


@query(f"SELECT event_id, sha256(line) AS raw_sha256, sha256(substr(sha256('/logs/' || event_type), 1, 16) || ':' || (event_id * 200) || ':' || sha256(line)) AS id FROM (SELECT *, {_FORTI_SQL} AS line FROM events)")
def event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = F.sha2(F.col("line").cast("binary"), 256)
    source = lines.source_id(F.concat(F.lit("file:///logs/"), F.col("event_type")))
    return event_lines(spark, sf_dir).select("event_id", sha.alias("raw_sha256"), ingest.event_id(source, F.col("event_id") * 200, sha).alias("id"))


@query(f"""SELECT event_type AS path, line_no::BIGINT AS line_no, (coalesce(sum(strlen(line) + 1) OVER (PARTITION BY event_type ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS byte_offset, sha256(line || chr(10)) AS raw_sha256
 FROM (SELECT event_type, {_ASA_SQL} AS line, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS line_no FROM events)""")
def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_lines(spark, sf_dir, "asa").groupBy("event_type").agg(F.array_sort(F.collect_list(F.struct("event_id", "line"))).alias("x"))
    files = rows.select(F.col("event_type").alias("path"), F.concat(F.array_join(F.transform("x", lambda r: r["line"]), "\n"), F.lit("\n")).cast("binary").alias("content"))
    return lines.split_lines(files).select("path", "line_no", "byte_offset", F.sha2("raw", 256).alias("raw_sha256"))


# A text of 29 February has no year that would allow it.
_LEAP_DAY = "event_id % 40 = 2"


@query(f"""SELECT event_id, CASE event_id % 8 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 2 THEN CASE WHEN {_LEAP_DAY} THEN '2026-09-30T12:00:00Z' ELSE '2026' || strftime(CASE WHEN strftime(ts, '%m-%d') = '02-29' THEN ts - INTERVAL 1 DAY ELSE ts END, '-%m-%dT%H:%M:%SZ') END
 WHEN 3 THEN strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%SZ') WHEN 4 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 5 THEN '2026-09-30T' || strftime(ts, '%H:%M:%SZ') WHEN 6 THEN strftime(ts, '%Y-%m-%dT00:00:00Z') ELSE '2026-09-30T12:00:00Z' END AS event_time,
 event_id % 8 NOT IN (0, 3) AS tz_assumed, CASE WHEN event_id % 8 = 7 OR event_id % 8 = 2 AND {_LEAP_DAY} THEN 'ingest_fallback' END AS time_source
 FROM events""")
def event_time_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, f = F.col("event_id") % 8, lambda p: F.date_format("ts", p)
    iso, clock, day = f("yyyy-MM-dd'T'HH:mm:ss"), f("HH:mm:ss"), f("yyyy-MM-dd")
    u = {"time": F.when(k == 0, F.concat(iso, F.lit("Z"))).when(k == 1, clock).when(k == 7, "soon"), "date": F.when(k.isin(1, 4), day).when(k == 7, "today"), "ts": F.when(k == 2, F.concat(f("MMM"), F.lit("  "), F.dayofmonth("ts").cast("string"), F.lit(" "), clock))}
    event = F.when(k == 3, F.concat(iso, F.lit(".5+02:00"))).when(k.isin(4, 5), clock).when(k == 6, day).when(k == 7, "later")
    u["ts"] = F.when(F.expr(_LEAP_DAY), F.concat(F.lit("Feb 29 "), clock)).otherwise(u["ts"])
    rows = table(spark, sf_dir, "events").withColumn("ts", F.expr("CASE WHEN event_id % 8 = 2 AND date_format(ts, 'MM-dd') = '02-29' THEN ts - INTERVAL 1 DAY ELSE ts END"))
    return eventtime.resolve(rows, u, event, ingest_time()).select("event_id", F.col("_time").alias("event_time"), F.col("_assumed").alias("tz_assumed"), F.col("_source").alias("time_source"))


@query("SELECT event_id, '10.' || (user_id % 256) || '.' || (event_id % 256) || '.0' AS net24, '10.' || (user_id % 256) || '.0.0' AS net16, '10.' || (user_id % 256) || '.' || (event_id % 256) || '.' || (event_id % 256 // 64 * 64) AS net26 FROM events")
def mask_ipv4(spark: SparkSession, sf_dir: str) -> DataFrame:
    ip = F.concat(F.lit("10."), (F.col("user_id") % 256).cast("string"), F.lit("."), (F.col("event_id") % 256).cast("string"), F.lit("."), (F.col("event_id") % 256).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", privacy.mask_ipv4(ip, 24).alias("net24"), privacy.mask_ipv4(ip, 16).alias("net16"), privacy.mask_ipv4(ip, 26).alias("net26"))


@query("SELECT event_id, '2001:db8:' || CASE WHEN user_id % 65536 = 0 THEN ':' ELSE format('{:x}', user_id % 65536) || '::' END AS masked FROM events")
def mask_ipv6(spark: SparkSession, sf_dir: str) -> DataFrame:
    ip = F.concat(F.lit("2001:db8:"), F.hex(F.col("user_id") % 65536), F.lit(":"), F.hex(F.col("event_id") % 65536), F.lit("::1"))
    return table(spark, sf_dir, "events").select("event_id", privacy.mask_address(ip, v6=48).alias("masked"))


@query("SELECT event_id, 'sha256:' || sha256('pepper:user' || user_id) AS user_name FROM events")
def hash_usernames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", privacy.hash_user(F.concat(F.lit("user"), F.col("user_id").cast("string")), "pepper").alias("user_name"))


# Ingested events: a file for each event_type, offsets of 200 bytes a line.
def ingested(spark: SparkSession, sf_dir: str, masking: ingest.Masking = ingest.Masking(), repeats: bool = False) -> ingest.Ingested:
    c = F.col
    if repeats:
        rows = table(spark, sf_dir, "events").withColumn("line", synthetic.fortigate(F.date_trunc("month", "ts"), c("user_id") % 4, c("event_type").isin(*DENY), c("user_id")))
    else:
        rows = event_lines(spark, sf_dir)
    made = raw_lines(rows, F.concat(F.lit("/logs/"), c("event_type")), c("event_id") * 200, c("event_id") + 1)
    return ingest.ingest_lines(made, ingest_time=ingest_time(), masking=masking, csv=False)


_INGESTED_SQL = f"""WITH l AS (SELECT *, {_FORTI_SQL} AS line FROM events),
 r AS (SELECT *, substr(sha256('/logs/' || event_type), 1, 16) AS source_id, event_id * 200 AS byte_offset, event_id + 1 AS line_no, sha256(line) AS raw_sha256, regexp_extract(line, '{_regex('fortigate_kv')}', {_names('fortigate_kv')}) AS g, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS event_time FROM l),
 e AS (SELECT *, sha256(source_id || ':' || byte_offset || ':' || raw_sha256) AS id,
  '{{"action":"' || g.action || '","activity_id":0,"class_name":"Network Activity","class_uid":4001,"dst_endpoint":{{"ip":"' || g.dst_ip || '"}},"src_endpoint":{{"ip":"' || g.src_ip || '"}},"time":"' || event_time || '"}}' AS event_json,
  '{{"date":"' || g.date || '","dst_port":"' || g.dst_port || '","log_id":"' || g.log_id || '","proto":"' || g.proto || '","src_port":"' || g.src_port || '","time":"' || g.time || '"}}' AS unmapped_json,
  '{{"duplicate_count":0,"duplicate_of":null,"masked":false,"tz_assumed":true}}' AS flags_json FROM r),
 j AS (SELECT *, '{{"event":' || event_json || ',"event_id":"' || id || '","flags":' || flags_json || ',"ingest_time":"2026-09-30T12:00:00Z","parser":{{"confidence":0.96,"name":"fortigate_kv","version":1}},"raw":"' || line || '","raw_sha256":"' || raw_sha256
  || '","source":{{"byte_offset":' || byte_offset || ',"file":"' || event_type || '","id":"' || source_id || '","line_no":' || line_no || '}},"unmapped":' || unmapped_json || '}}' AS json FROM e)"""


@query(_INGESTED_SQL + """ SELECT id AS event_id, '2026-09-30T12:00:00Z' AS ingest_time, source_id, event_type AS source_file, byte_offset, line_no, line AS raw, raw_sha256, 'fortigate_kv' AS parser_name, 1::BIGINT AS parser_version, 0.96::DOUBLE AS parser_confidence,
 event_time, 4001::BIGINT AS class_uid, 'Network Activity' AS class_name, 0::BIGINT AS activity_id, g.action AS action, g.src_ip AS src_ip, g.dst_ip AS dst_ip, NULL::VARCHAR AS protocol, event_json, unmapped_json, flags_json FROM j""")
def flatten_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingested(spark, sf_dir).flat()


@query(_INGESTED_SQL + " SELECT json AS value FROM j")
def export_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exporting.lines(ingested(spark, sf_dir).events, "ndjson")


@query(_INGESTED_SQL + """ SELECT 'CEF:0|logloom|Event|1.0|4001|Network Activity|5|externalId=' || id || ' rt=' || event_time || ' act=' || g.action || ' src=' || g.src_ip || ' dst=' || g.dst_ip || ' cs1Label=EnvelopeBase64 cs1=' || replace(to_base64(encode(json)), '=', '\\=') AS value FROM j""")
def export_cef(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exporting.lines(ingested(spark, sf_dir).events, "cef")


@query(_INGESTED_SQL + """ SELECT '<134>1 ' || event_time || ' logloom logloom - - {"envelope_base64":"' || to_base64(encode(json)) || '","event_id":"' || id || '","raw_sha256":"' || raw_sha256 || '"}' AS value FROM j""")
def export_syslog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exporting.lines(ingested(spark, sf_dir).events, "syslog")


_REPEATS_SQL = _FORTI_SQL.replace("event_id", "(user_id % 4)").replace("strftime(ts, '%Y-%m-%d')", "strftime(date_trunc('month', ts), '%Y-%m-%d')").replace("strftime(ts, '%H:%M:%S')", "'00:00:00'")


@query(f"""WITH l AS (SELECT *, {_REPEATS_SQL} AS line, event_id AS n FROM events), e AS (SELECT *, sha256(substr(sha256('/logs/' || event_type), 1, 16) || ':' || (n * 200) || ':' || sha256(line)) AS id FROM l)
 SELECT id AS event_id, (row_number() OVER w - 1)::BIGINT AS duplicate_count, CASE WHEN row_number() OVER w > 1 THEN first_value(id) OVER w END AS duplicate_of FROM e WINDOW w AS (PARTITION BY event_type, line ORDER BY n)""")
def duplicate_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingested(spark, sf_dir, repeats=True).events.select("event_id", "flags.duplicate_count", "flags.duplicate_of")


@query(_INGESTED_SQL + """ SELECT id AS event_id, regexp_replace(g.src_ip, '[0-9]+$', '0') AS src_ip, regexp_replace(g.dst_ip, '[0-9]+$', '0') AS dst_ip, (regexp_replace(g.src_ip, '[0-9]+$', '0') <> g.src_ip OR regexp_replace(g.dst_ip, '[0-9]+$', '0') <> g.dst_ip) AS masked FROM j""")
def masked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ingested(spark, sf_dir, ingest.Masking(addresses=True))
    return made.events.select("event_id", "event.src_endpoint.ip", "event.dst_endpoint.ip", "flags.masked").toDF("event_id", "src_ip", "dst_ip", "masked")


@query(f"SELECT count(*)::BIGINT AS records, count_if({_ROUTE_SQL} IS NOT NULL)::BIGINT AS events, count_if({_ROUTE_SQL} IS NULL)::BIGINT AS quarantined, 0::BIGINT AS headers FROM ({_MIXED_SQL})")
def ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_lines(mixed_lines(spark, sf_dir), F.lit("/logs/mixed"), F.lit(0), F.lit(2))
    return ingest.ingest_lines(rows, ingest_time=ingest_time(), csv=False, max_line_bytes=1 << 30).counts()


def raw_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ingested(spark, sf_dir).raw.withColumn("sequence", F.floor(F.col("byte_offset") / 200).cast("bigint"))
    return made.drop("path")


@query("""WITH r AS (SELECT event_id AS s, lag(event_id) OVER (ORDER BY event_id) AS p FROM events WHERE event_id % 97 <> 5)
 SELECT s AS sequence, 'sequence gap or repeat' AS error FROM r WHERE p IS NOT NULL AND s - p <> 1 UNION ALL SELECT s, 'bytes differ from size or digest' FROM r WHERE s % 101 = 0 UNION ALL SELECT s, 'offsets leave a gap' FROM r WHERE coalesce((p + 1) * 20, 0) <> s * 20""")
def seq_gap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    right = F.lpad(c("event_id").cast("string"), 20, "0")
    rows = table(spark, sf_dir, "events").where("event_id % 97 <> 5").select(c("event_id").alias("sequence"), F.lit("s").alias("source_id"), (c("event_id") * 20).alias("byte_offset"), (c("event_id") + 1).alias("line_no"), F.lit(20).cast("bigint").alias("raw_size"), F.sha2(right.cast("binary"), 256).alias("sha256"), F.when(c("event_id") % 101 == 0, F.lpad(F.lit("x"), 20, "0")).otherwise(right).cast("binary").alias("raw"))
    return lineage.verify_store(rows)


@query(_INGESTED_SQL + " SELECT id AS event_id, event_id % 11 <> 3 AS found, event_id % 11 <> 3 AND event_id % 13 <> 4 AS hash_ok, event_id % 11 <> 3 AND event_id % 13 <> 4 AS text_ok FROM j")
def trace_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = raw_index(spark, sf_dir).where("sequence % 11 <> 3").withColumn("raw", F.when(F.col("sequence") % 13 == 4, F.lit(b"?")).otherwise(F.col("raw")))
    return lineage.trace(ingested(spark, sf_dir).flat(), index).select("event_id", "found", "hash_ok", "text_ok")


@query(_INGESTED_SQL + " SELECT id AS event_id, byte_offset FROM j WHERE event_id % 11 = 3")
def orphan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.orphans(ingested(spark, sf_dir).flat(), raw_index(spark, sf_dir).where("sequence % 11 <> 3")).select("event_id", "byte_offset")


@query("SELECT o_orderkey, CASE lower(substr(o_orderpriority, 3)) WHEN 'high' THEN '8' WHEN 'low' THEN '2' ELSE '5' END AS severity, least(greatest(o_orderkey - 5, 0), 10)::VARCHAR AS numeric_severity FROM orders")
def cef_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.substring("o_orderpriority", 3, 100)
    return table(spark, sf_dir, "orders").select("o_orderkey", encode.cef_severity(name).alias("severity"), encode.cef_severity(name, F.col("o_orderkey") - 5).alias("numeric_severity"))


@query(f"""WITH m AS (SELECT {_ROUTE_SQL} AS t FROM (SELECT {_FORTI_SQL} AS line FROM events UNION ALL SELECT text FROM documents))
 SELECT count(*)::BIGINT AS total, count_if(t = 'fortigate_rule')::BIGINT AS matched, count_if(t = 'fortigate_rule') / count(*) AS coverage, 0.96::DOUBLE AS mean_confidence, 0::BIGINT AS parse_errors, 'coverage_below_threshold,mean_confidence_below_threshold' AS reasons, true AS drifting FROM m""")
def drift_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_lines(spark, sf_dir).select("line").unionAll(table(spark, sf_dir, "documents").select("text"))
    out = monitor.report(rows, only("fortigate_kv"), "fortigate_kv", min_coverage=0.95, min_confidence=0.97)
    return out.select("total", "matched", "coverage", F.round("mean_confidence", 9).alias("mean_confidence"), "parse_errors", F.array_join("drift_reasons", ",").alias("reasons"), "drifting")


@query(f"""SELECT event_type, count_if({_ROUTE_SQL} = 'asa_deny') / count(*) AS coverage FROM (SELECT event_type, CASE WHEN event_id % 10 = 0 THEN 'broken ' || event_id ELSE {_ASA_SQL} END AS line FROM events) GROUP BY event_type""")
def parser_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_lines(spark, sf_dir, "asa").withColumn("line", F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("broken "), F.col("event_id").cast("string"))).otherwise(F.col("line")))
    return monitor.matched(rows, only("asa_syslog"), "asa_syslog").groupBy("event_type").agg((F.count_if("matched") / F.count(F.lit(1))).alias("coverage"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = F.col, lambda x: x.cast("string")
    fields = {"id": s(c("event_id")), "when": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "address": F.concat(F.lit("10.0."), s(c("user_id") % 300), F.lit(".1")), "kind": c("event_type"), "mixed": F.when(c("event_id") % 3 == 0, s(c("event_id"))).otherwise(F.lit("n/a")), "clock": F.date_format("ts", "HH:mm:ss")}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in fields.items()]))
    return table(spark, sf_dir, "events").select("event_id", pairs.alias("p")).select(F.col("p.field").alias("field"), F.col("p.value").alias("value"), "event_id", F.when(F.col("p.field") == "kind", "event.action").alias("path"))


_SAMPLES_SQL = """SELECT 'id' AS field, event_id::VARCHAR AS value, event_id FROM events UNION ALL SELECT 'when', strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), event_id FROM events UNION ALL SELECT 'address', '10.0.' || (user_id % 300) || '.1', event_id FROM events
 UNION ALL SELECT 'kind', event_type, event_id FROM events UNION ALL SELECT 'mixed', CASE WHEN event_id % 3 = 0 THEN event_id::VARCHAR ELSE 'n/a' END, event_id FROM events UNION ALL SELECT 'clock', strftime(ts, '%H:%M:%S'), event_id FROM events"""


@query(f"""WITH s AS ({_SAMPLES_SQL}), t AS (SELECT *, CASE WHEN regexp_full_match(value, '((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])[.]){{3}}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])') THEN 'ipv4' WHEN regexp_full_match(value, '[+-]?[0-9]+') THEN 'int'
 WHEN try_strptime(value, ['%Y-%m-%dT%H:%M:%SZ', '%H:%M:%S']) IS NOT NULL THEN 'timestamp' ELSE 'free_text' END AS kind FROM s),
 c AS (SELECT field, kind, count(*) AS n, min(event_id) AS seen FROM t GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, seen) AS r, sum(n) OVER (PARTITION BY field) AS total FROM c),
 d AS (SELECT field, count(DISTINCT value) AS distinct_values FROM s GROUP BY field)
 SELECT field, CASE WHEN field = 'kind' THEN 'enum' ELSE kind END AS type, CASE WHEN field = 'kind' THEN 1.0::DOUBLE ELSE n / total END AS confidence, total::BIGINT AS samples, distinct_values FROM b JOIN d USING (field) WHERE r = 1""")
def infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.infer_types(_samples(spark, sf_dir), "field", "value", "event_id", "path")


@query("SELECT 'status' AS field, count(DISTINCT o_orderstatus) AS distinct_values, count(DISTINCT o_orderstatus) <= 8 AS is_enum FROM orders UNION ALL SELECT 'priority', count(DISTINCT o_orderpriority), count(DISTINCT o_orderpriority) <= 8 FROM orders UNION ALL SELECT 'customer', count(DISTINCT o_custkey), count(DISTINCT o_custkey) <= 8 FROM orders")
def enum_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("at"), F.explode(F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"), F.lit("customer"), F.col("o_custkey").cast("string"))).alias("field", "value")).withColumn("path", F.lit("event.action"))
    return learn.infer_types(rows, "field", "value", "at", "path").select("field", "distinct_values", (F.col("type") == "enum").alias("is_enum"))


_EXAMPLES = [("kv", "srcip", "event.src_endpoint.ip"), ("kv", "proto", "event.protocol_name"), ("kv", "act", "event.action"), ("json", "srcip", "event.src_endpoint.ip"), ("json", "act", "event.message"), ("cef", "act", "event.action"), ("cef", "dst", "event.dst_endpoint.ip"), ("csv", "act", "event.message"), ("csv", "zone", "")]


@query(f"""WITH x(f, name, path) AS (VALUES {', '.join(map(str, _EXAMPLES))}), k(alias, synonym) AS (VALUES {', '.join(map(str, sorted(learn.synonym_map().items())))}),
 v AS (SELECT x.f, x.name, x.path, o.path AS guess, count(*) AS n FROM x JOIN x o ON x.name = o.name AND x.f <> o.f GROUP BY ALL), b AS (SELECT *, rank() OVER (PARTITION BY f, name ORDER BY n DESC) AS r FROM v),
 g AS (SELECT f, name, CASE WHEN count(*) > 1 THEN '' ELSE any_value(guess) END AS guess FROM b WHERE r = 1 GROUP BY f, name)
 SELECT count_if(coalesce(g.guess, k.synonym, '') = x.path)::BIGINT AS correct, count(*)::BIGINT AS total FROM x LEFT JOIN g USING (f, name) LEFT JOIN k ON k.alias = x.name""")
def loo_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.leave_one_format_out(spark.createDataFrame(_EXAMPLES, "format string, field string, path string"), learn.synonyms(spark))


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    raw = F.when(k == 4, F.concat(F.lit("noise "), F.col("event_id").cast("string"))).otherwise(F.col("line"))
    expected = F.when(k.isin(0, 1, 2), "fortigate_rule").when(k == 3, "other_rule")
    return event_lines(spark, sf_dir).select("event_id", raw.alias("raw"), expected.alias("expected_template_id"), F.array(F.lit("src_ip"), F.lit("action")).alias("required_fields"))


@query("SELECT count(*)::BIGINT AS cases_checked, count_if(event_id % 5 <> 4)::BIGINT AS positive_cases, count_if(event_id % 5 < 3)::BIGINT AS covered_cases, count_if(event_id % 5 = 3)::BIGINT AS overmerged_cases, 2 * count_if(event_id % 5 = 4)::BIGINT AS missing_required_fields, 0::BIGINT AS ambiguous_cases, 0::BIGINT AS errors, count_if(event_id % 5 < 3) / count_if(event_id % 5 <> 4) AS coverage, false AS valid FROM events")
def verify_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.summary(verify.score(_cases(spark, sf_dir), only("fortigate_kv")[0]))


@query(f"SELECT matches, count(*) AS n FROM (SELECT (regexp_matches(line, 'action=deny'))::BIGINT + (regexp_matches(line, 'proto=tcp'))::BIGINT + (regexp_matches(line, '{_regex('fortigate_kv')}'))::BIGINT AS matches FROM (SELECT {_FORTI_SQL} AS line FROM events)) GROUP BY matches")
def ambiguous_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = only("fortigate_kv")[0]
    trial = base | {"templates": [base["templates"][0], *({"id": p, "regex": p, "fields": [], "event_class": "Network Activity", "activity": "record"} for p in ("action=deny", "proto=tcp"))]}
    return event_lines(spark, sf_dir).select(match_count([trial], F.col("line")).cast("bigint").alias("matches")).groupBy("matches").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 'invalid integer: ' || event_id || 'x' END AS int_error, CASE WHEN event_id % 4 <> 1 THEN event_id::BIGINT END AS int_value, CASE WHEN user_id % 300 > 255 THEN 'invalid IPv4 address: 10.0.0.' || (user_id % 300) END AS ip_error FROM events")
def convert_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.concat(F.col("event_id").cast("string"), F.when(F.col("event_id") % 4 == 1, "x").otherwise(""))
    value, error = convert("int", number)
    _, ip = convert("ipv4", F.concat(F.lit("10.0.0."), (F.col("user_id") % 300).cast("string")))
    return table(spark, sf_dir, "events").select("event_id", error.alias("int_error"), value.alias("int_value"), ip.alias("ip_error"))


@query(_INGESTED_SQL + " SELECT id AS event_id, '2026-09-30T12:00:00Z' AS ingest_time, event_type AS source_file, 'fortigate_kv' AS parser_name, 1::BIGINT AS parser_version, event_json, raw_sha256 FROM j ORDER BY id LIMIT 100")
def recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sqlgate.recent(ingested(spark, sf_dir).flat(), 100)


@query(_INGESTED_SQL + " SELECT g.action AS action, count(*) AS n, count(DISTINCT g.src_ip) AS sources FROM j GROUP BY 1")
def gated_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sqlgate.query(spark, ingested(spark, sf_dir).flat(), "SELECT action, count(*) AS n, count(DISTINCT src_ip) AS sources FROM events GROUP BY action")


@query()
def drain_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates of all lines, by their distinct shapes."""
    made = learn.learn_all(spark, event_lines(spark, sf_dir), "learned")
    return spark.createDataFrame([(t["id"], t["regex"], t["event_class"]) for t in made], "id string, regex string, event_class string")


@query("""WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents), e AS (SELECT *, list_concat([0], list_filter(range(1, octet_length(raw) + 1), lambda i: raw[i:i] = '\\x0A'::BLOB), CASE WHEN octet_length(raw) > 0 AND raw[-1:] <> '\\x0A'::BLOB THEN [octet_length(raw)] ELSE [] END) AS cuts FROM b),
 l AS (SELECT doc_id, unnest(range(1, len(cuts))) AS line_no, cuts FROM e), s AS (SELECT doc_id, line_no, cuts[line_no] AS pos, cuts[line_no + 1] - cuts[line_no] AS size FROM l), c AS (SELECT *, unnest(range(0, (size - 1) // 512 + 1)) AS chunk FROM s)
 SELECT doc_id::VARCHAR AS path, line_no::BIGINT AS line_no, (pos + chunk * 512)::BIGINT AS byte_offset, chunk::INT AS chunk, size > 512 AS oversized, least(512, size - chunk * 512)::INT AS size FROM c""")
def oversized_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    return lines.split_lines(files, max_line_bytes=512).select("path", "line_no", "byte_offset", "chunk", "oversized", F.length("raw").alias("size"))


def _json_parser(*fields: tuple[str, str, str]) -> list[dict]:
    base = only("json_generic")[0]
    own = [{"name": n, "type": t, "ocsf_path": p, "confidence": 0.9} for n, t, p in fields]
    return [base | {"templates": [base["templates"][0] | {"fields": base["templates"][0]["fields"] + own}]}]


def _json_events(spark: SparkSession, sf_dir: str, definitions: list[dict], masking: ingest.Masking = ingest.Masking(), line: Column | None = None) -> ingest.Ingested:
    c = F.col
    rows = event_lines(spark, sf_dir, "json") if line is None else event_lines(spark, sf_dir, "json").withColumn("line", line)
    return ingest.ingest_lines(raw_lines(rows, F.lit("/logs/open"), c("event_id") * 500, c("event_id") + 1), definitions, ingest_time=ingest_time(), masking=masking, csv=False)


@query("""SELECT event_id * 500 AS byte_offset, CASE WHEN event_id % 2 = 0 THEN 'tcp' ELSE 'udp' END AS protocol, '{"time":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '"}' AS unmapped_json,
 '{"action":"' || CASE WHEN event_type IN ('error', 'click') THEN 'deny' ELSE 'accept' END || '","activity_id":0,"class_name":"Network Activity","class_uid":4001,"device":{"port":' || CASE WHEN event_id % 3 = 0 THEN 443 ELSE 53 END || '},"network":{"protocol":"'
 || CASE WHEN event_id % 2 = 0 THEN 'tcp' ELSE 'udp' END || '"},"src_endpoint":{"ip":"10.0.' || ((user_id // 256) % 256) || '.' || (user_id % 256) || '"},"time":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '"}' AS event_json FROM events""")
def open_event_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that a parser puts at places of its own in the event."""
    made = _json_events(spark, sf_dir, _json_parser(("dst_port", "int", "event.device.port"), ("protocol", "free_text", "event.network.protocol")))
    return made.flat().select("byte_offset", "protocol", "unmapped_json", "event_json")


@query("""SELECT event_id % 2 = 0 AS is_event, CASE WHEN event_id % 2 = 1 THEN 'invalid_envelope' END AS reason_code, CASE WHEN event_id % 2 = 1 THEN 'event.dst_endpoint.port has the wrong type' END AS detail, count(*) AS n FROM events GROUP BY event_id % 2""")
def invalid_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text in a port: the record is set aside, and no other."""
    line = F.when(F.col("event_id") % 2 == 1, F.col("line")).otherwise(F.regexp_replace("line", ',"protocol":"[a-z]*"', ""))
    made = _json_events(spark, sf_dir, _json_parser(("protocol", "free_text", "event.dst_endpoint.port")), line=line)
    rows = made.events.select(F.lit(True).alias("is_event"), F.lit(None).cast("string").alias("reason_code"), F.lit(None).cast("string").alias("detail")).unionByName(made.quarantine.select(F.lit(False).alias("is_event"), "reason_code", "detail"))
    return rows.groupBy("is_event", "reason_code", "detail").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id * 500 AS byte_offset, true AS masked, '10.0.' || ((user_id // 256) % 256) || '.0' AS src_ip, '{"dst_ip":"2001:db8:1:' || format('{:x}', 1 + event_id % 4096) || '::","net":{"hops":[{"ip":"10.9.' || (event_id % 256) || '.0"},7],"ttl":64},"port":443,"user":"sha256:' || sha256('pepper:u' || user_id) || '","what":"caf\\u00e9 \\ud83d\\ude42"}' AS unmapped_json FROM events""")
def masked_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of both kinds and user names at any depth; the other values keep their types; JSON in ASCII."""
    s = lambda x: x.cast("string")
    i, user = F.col("event_id"), F.col("user_id")
    line = F.concat(
        F.lit('{"what":"café 🙂","port":443,"dst_ip":"2001:db8:1:'), F.hex(1 + i % 4096), F.lit('::7","net":{"ttl":64,"hops":[{"ip":"10.9.'), s(i % 256), F.lit(".9\"},7]},\"user\":\"u"), s(user), F.lit('","src_ip":"10.0.'), s(F.floor(user / 256) % 256), F.lit('.77"}'),
    )
    made = _json_events(spark, sf_dir, _json_parser(), ingest.Masking(addresses=True, users=True, salt="pepper"), line)
    return made.flat().select("byte_offset", F.get_json_object("flags_json", "$.masked").cast("boolean").alias("masked"), "src_ip", "unmapped_json")


@query("""SELECT c_nationkey::VARCHAR AS source_file, (1 + row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey))::BIGINT AS line_no, 'csv_header' AS parser_name, lower(c_mktsegment) AS action, c_name AS user_name, '{"balance":"' || c_custkey % 100 || '","note":"a,\\"b\\""}' AS unmapped_json FROM customer""")
def csv_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a CSV header beside files of other lines, by the flow's defaults."""
    c = F.col
    number = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).cast("bigint") + 1  # offsets pass 2^31 bytes
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("/csv/"), c("c_nationkey").cast("string")).alias("path"), number.alias("no"), F.concat_ws(",", "c_mktsegment", "c_name", (c("c_custkey") % 100).cast("string"), F.lit('"a,""b"""')).alias("line"))
    heads = table(spark, sf_dir, "nation").select(F.concat(F.lit("/csv/"), c("n_nationkey").cast("string")).alias("path"), F.lit(1).cast("bigint").alias("no"), F.lit("Action,User-Name,Balance,note").alias("line"))
    other = event_lines(spark, sf_dir).select(F.lit("/logs/fortigate").alias("path"), (c("event_id") + 1).cast("bigint").alias("no"), "line")
    made = ingest.ingest_lines(raw_lines(rows.unionByName(heads).unionByName(other), c("path"), c("no") * 500, c("no")), ingest_time=ingest_time())
    return made.events.where("parser.name = 'csv_header'").select("source.file", "source.line_no", "parser.name", "event.action", "event.user_name", "unmapped_json").toDF("source_file", "line_no", "parser_name", "action", "user_name", "unmapped_json")
