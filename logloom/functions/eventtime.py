"""The time of an event from its fields, first success first, as an ISO-8601 text of whole seconds in UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.fields import DATE, iso_instant, valid_clock
from logloom.functions.once import once

ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def render(ts: Column) -> Column:
    return F.date_format(ts, ISO_SECONDS)


def _at(date: Column, clock: Column) -> Column:
    pieces = F.split(clock, ":")
    two = lambda i: F.lpad(F.try_element_at(pieces, F.lit(i)), 2, "0")
    return F.when(date.rlike(DATE) & valid_clock(clock), F.try_to_timestamp(F.concat(date, F.lit(" "), two(1), F.lit(":"), two(2), F.lit(":"), two(3)), F.lit("yyyy-MM-dd HH:mm:ss")))


def _syslog(ts: Column, year: Column) -> Column:
    """Mon d HH:MM:SS in the given year; 29 February is no date, as the text has no year that would allow it."""
    pieces = F.split(F.trim(ts), r"[ \t]+")
    item = lambda i: F.try_element_at(pieces, F.lit(i))
    ok = ts.rlike(r"\A[ \t]*[A-Za-z]{3}[ \t]+[0-9]{1,2}[ \t]+[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}\z") & ~((F.lower(item(1)) == "feb") & (item(2).try_cast("int") > 28))
    months = F.array(*[F.lit(m) for m in ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")])
    month = F.array_position(months, F.lower(item(1))).cast("int")
    date = F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(item(2), 2, "0"))
    return F.when(ok & (month > 0), _at(date, item(3)))


def resolve(df: DataFrame, u: dict[str, Column], event_time: Column, ingest: Column, zone: str = "UTC") -> DataFrame:
    """df with (_time, _assumed, _source) from unmapped values time, date and ts, the mapped time and the ingest timestamp.

    In order: 1 u.time as ISO; 2 u.date and u.time; 3 u.ts in syslog's form with the ingest year; 4 the mapped time as ISO; 5 u.date
    and the mapped time; 6 the mapped clock with u.date, or else the ingest date; 7 the mapped date; 8 the ingest time, marked
    ingest_fallback. _assumed: the text had no zone (steps 2, 3, 5, 6 and 7 never have one), or step 8. Each step is a column of
    its own, so that none is computed twice.
    """
    c = F.col
    local = lambda x: x if zone == "UTC" else F.to_utc_timestamp(x, F.lit(zone))
    df = once(df, {"_u_time": u["time"], "_u_date": u["date"], "_u_ts": u["ts"], "_e_time": event_time})
    iso_u, naive_u = iso_instant(c("_u_time"), zone)
    iso_e, naive_e = iso_instant(c("_e_time"), zone)
    day = F.when(c("_u_date").rlike(DATE) & c("_u_date").try_cast("date").isNotNull(), c("_u_date")).otherwise(F.date_format(ingest, "yyyy-MM-dd"))
    midnight = F.when(c("_e_time").rlike(DATE), c("_e_time").try_cast("timestamp"))
    steps = [iso_u, local(_at(c("_u_date"), c("_u_time"))), local(_syslog(c("_u_ts"), F.year(ingest))), iso_e, local(_at(day, c("_e_time"))), local(midnight)]
    df = once(df, {f"_step{i}": s for i, s in enumerate(steps)})
    found = [c(f"_step{i}") for i in range(len(steps))]
    assumed = F.when(found[0].isNotNull(), naive_u).when(found[1].isNotNull() | found[2].isNotNull(), True).when(found[3].isNotNull(), naive_e).otherwise(True)
    df = once(df, {"_time": render(F.coalesce(*found, ingest)), "_assumed": assumed, "_source": F.when(F.coalesce(*found).isNull(), F.lit("ingest_fallback"))})
    return df.drop("_u_time", "_u_date", "_u_ts", "_e_time", *[f"_step{i}" for i in range(len(steps))])
