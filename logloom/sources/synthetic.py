"""Log lines rendered from numbered rows, in four formats; and from the tables of the test data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fortigate(ts: Column, i: Column, deny: Column, user: Column) -> Column:
    s = lambda c: c.cast("string")
    return F.concat(
        F.lit("date="), F.date_format(ts, "yyyy-MM-dd"), F.lit(" time="), F.date_format(ts, "HH:mm:ss"), F.lit(" log_id="), s(i), F.lit(" action="), F.when(deny, "deny").otherwise("accept"),
        F.lit(" srcip=10.0."), s(F.floor(user / 256) % 256), F.lit("."), s(user % 256), F.lit(" dstip=203.0."), s(F.floor(i / 256) % 256), F.lit("."), s(i % 256),
        F.lit(" proto="), F.when(i % 2 == 0, "tcp").otherwise("udp"), F.lit(" srcport="), s(1024 + i % 50000), F.lit(" dstport="), s(F.when(i % 3 == 0, 443).otherwise(53)),
    )


def asa(ts: Column, i: Column, deny: Column, user: Column) -> Column:
    s = lambda c: c.cast("string")
    return F.concat(
        F.date_format(ts, "MMM"), F.lit(" "), s(F.dayofmonth(ts)), F.lit(" "), F.date_format(ts, "HH:mm:ss"), F.lit(" fw01 %ASA-4-106023: "), F.when(deny, "Deny").otherwise("Allow"),
        F.when(i % 2 == 0, " tcp").otherwise(" udp"), F.lit(" src 10.0."), s(F.floor(user / 256) % 256), F.lit("."), s(user % 256), F.lit("/"), s(1024 + i % 50000), F.lit(" dst 203.0."), s(F.floor(i / 256) % 256), F.lit("."), s(i % 256), F.lit("/443 by access-group \"OUTSIDE_IN\""),
    )


def json(ts: Column, i: Column, deny: Column, user: Column) -> Column:
    s = lambda c: c.cast("string")
    return F.concat(
        F.lit('{"time":"'), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('","src_ip":"10.0.'), s(F.floor(user / 256) % 256), F.lit("."), s(user % 256), F.lit('","action":"'), F.when(deny, "deny").otherwise("accept"),
        F.lit('","dst_port":'), s(F.when(i % 3 == 0, 443).otherwise(53)), F.lit(',"protocol":"'), F.when(i % 2 == 0, "tcp").otherwise("udp"), F.lit('"}'),
    )


def cef(i: Column, deny: Column, severity: Column) -> Column:
    s = lambda c: c.cast("string")
    return F.concat(F.lit("CEF:0|Edge|Wall|7.0|"), s(i), F.lit("|"), F.when(deny, "Deny").otherwise("Accept"), F.lit("|"), s(severity), F.lit("|src=10.0.0."), s(i % 256), F.lit(" dst=203.0.113.4 proto=tcp spt=443 dpt=443 msg=flow"))


def generate(spark: SparkSession, n: int, form: str = "fortigate", start: str = "2026-09-29 08:00:00") -> DataFrame:
    """n numbered lines of a format; everything follows from the number, so the rows don't depend on the partitions."""
    i = F.col("id")
    ts = F.to_timestamp(F.lit(start)) + F.make_dt_interval(secs=(i % 86400).cast("decimal(18,6)"))
    deny, user = i % 5 < 2, (i * 2654435761) % 65536
    line = {"fortigate": lambda: fortigate(ts, i, deny, user), "asa": lambda: asa(ts, i, deny, user), "json": lambda: json(ts, i, deny, user), "cef": lambda: cef(i, deny, i % 10)}[form]()
    return spark.range(n).select("id", line.alias("line"))
