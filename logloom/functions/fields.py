"""Typed field conversions and type inference as expressions: each gives a value, and whether the value is wrong for the type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The types of parser fields.
TYPES = ("ipv4", "int", "timestamp", "enum", "free_text")

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"\A(?:{_OCTET}\.){{3}}{_OCTET}\z"
INTEGER = r"\A[+-]?[0-9]+\z"
PYTHON_INT = r"\A[ \t\n\r\f]*[+-]?[0-9]+(?:_[0-9]+)*[ \t\n\r\f]*\z"
DATE = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
CLOCK = r"\A[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}\z"
ISO = r"\A[0-9]{4}-?[0-9]{2}-?[0-9]{2}(?:.[0-9]{2}(?::[0-9]{2}(?::[0-9]{2}(?:[.,][0-9]{1,9})?)?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?\z"


def is_ipv4(c: Column) -> Column:
    return c.rlike(IPV4)


def iso_instant(text: Column, zone: str = "UTC") -> tuple[Column, Column]:
    """(timestamp or null, whether the text had no zone) of an ISO-8601 text, date alone included. The zone is used for naive ones.

    The text is brought into the form that a cast reads: date with hyphens, T, minutes, a point, a colon in the offset.
    """
    form = F.regexp_replace(text, r"\A([0-9]{4})-?([0-9]{2})-?([0-9]{2})(?:.([0-9]{2}))?", "$1-$2-$3T$4")
    form = F.regexp_replace(F.regexp_replace(form, r"T\z", ""), r"(T[0-9]{2})(?=\z|Z|[+-])", "$1:00")
    form = F.regexp_replace(F.translate(form, ",", "."), r"([+-][0-9]{2}):?([0-9]{2})\z", "$1:$2")
    naive = ~text.rlike(r"Z\z|[0-9][+-][0-9]{2}:?[0-9]{2}\z") | text.rlike(DATE)
    found = F.when(text.rlike(ISO), form.try_cast("timestamp"))
    return (F.when(naive, F.to_utc_timestamp(found, F.lit(zone))).otherwise(found) if zone != "UTC" else found), naive


def valid_clock(c: Column) -> Column:
    part = lambda i: F.try_element_at(F.split(c, ":"), F.lit(i)).try_cast("int")
    return c.rlike(CLOCK) & (part(1) < 24) & (part(2) < 60) & (part(3) < 62)


def is_timestamp(c: Column) -> Column:
    return iso_instant(c)[0].isNotNull() | F.coalesce(valid_clock(c), F.lit(False))


def convert(kind: str, text: Column, is_string: Column | None = None, is_integer: Column | None = None) -> tuple[Column, Column]:
    """(value, error message or null). text: the value as a string; is_string and is_integer: its type in JSON, if it comes from there."""
    string = F.lit(True) if is_string is None else is_string
    integer = F.lit(False) if is_integer is None else is_integer
    if kind == "ipv4":
        return text, F.when(~string, F.lit("IPv4 fields must be strings")).when(~is_ipv4(text), F.concat(F.lit("invalid IPv4 address: "), text))
    if kind == "int":
        value = F.regexp_replace(F.trim(text), "_", "").try_cast("bigint")
        return value, F.when(~string & ~integer, F.lit("integer fields must be strings or integers")).when(~text.rlike(PYTHON_INT) | value.isNull(), F.concat(F.lit("invalid integer: "), text))
    if kind == "timestamp":
        return text, F.when(~string, F.lit("timestamp fields must be strings")).when(~is_timestamp(text), F.concat(F.lit("invalid timestamp value: "), text))
    if kind in ("enum", "free_text"):
        return text, F.when(~string, F.lit(f"{kind} fields must be strings"))
    return F.lit(None).cast("string"), F.lit(f"unsupported parser field type: {kind}")


def value_type(c: Column) -> Column:
    """The type of a sample value: ipv4, else int, else timestamp, else free_text."""
    return F.when(is_ipv4(c), "ipv4").when(c.rlike(INTEGER), "int").when(is_timestamp(c), "timestamp").otherwise("free_text")
