"""Canonical JSON, and the escapes and severities of CEF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sorted_map(m: Column) -> Column:
    """The map with its keys in order."""
    return F.map_from_entries(F.transform(F.array_sort(F.map_keys(m)), lambda k: F.struct(k, F.element_at(m, k))))


def canonical(c: Column, nulls: bool = False) -> Column:
    """Compact JSON. Structs must have their fields, and maps their keys, in order; null fields are left out unless ``nulls``."""
    return F.to_json(c, {"ignoreNullFields": str(not nulls).lower()})


_CONTROL = r"\\u00[01][A-F]"


def plain_json(c: Column) -> Column:
    """JSON text with the escapes of control characters in lower case, as other encoders write them."""
    out = c
    for letter in "ABCDEF":
        # an even number of backslashes before: the escape is one, not an escaped backslash and what follows
        out = F.regexp_replace(out, rf"((?<!\\)(?:\\\\)*)\\u00([01]){letter}", rf"$1\\u00$2{letter.lower()}")
    return F.when(c.rlike(_CONTROL), out).otherwise(c)


def ascii_json(c: Column) -> Column:
    """JSON text with every character beyond printable ASCII as escapes of its UTF-16 units."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))

    def escaped(ch: Column) -> Column:
        n = F.ascii(ch).cast("bigint")
        pair = F.concat(unit(F.lit(0xD800).cast("bigint") + F.shiftright(n - 0x10000, 10)), unit(F.lit(0xDC00).cast("bigint") + (n - 0x10000) % 1024))
        return F.when(n < 127, ch).when(n < 0x10000, unit(n)).otherwise(pair)

    text = plain_json(c)
    return F.when(c.rlike(r"[^\x00-\x7E]"), F.array_join(F.transform(F.split(text, ""), escaped), "")).otherwise(text)


def base64_text(c: Column) -> Column:
    """Base64 of the UTF-8 text without line breaks, whatever the session's setting."""
    return F.regexp_replace(F.base64(F.encode(c, "UTF-8")), "[\\r\\n]", "")


def cef_header(c: Column) -> Column:
    c = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.translate(c, "\r\n", "  ")


def cef_extension(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ("=", "\\="), ("\r", "\\r"), ("\n", "\\n")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


#: Names of severities and their numbers; any other name is 5.
SEVERITIES = {"critical": 10, "fatal": 10, "emergency": 10, "high": 8, "error": 8, "medium": 5, "warning": 5, "low": 2, "informational": 2, "info": 2}


def cef_severity(name: Column, number: Column | None = None) -> Column:
    """The CEF severity of a name, or of a number (0 to 10, if the value is one) where that isn't null. A number written as text is a name."""
    out = F.lit("5")
    for level in sorted(set(SEVERITIES.values())):
        out = F.when(F.lower(name).isin(*[k for k, v in SEVERITIES.items() if v == level]), F.lit(str(level))).otherwise(out)
    return out if number is None else F.when(number.isNotNull(), F.least(F.greatest(number, F.lit(0)), F.lit(10)).cast("string")).otherwise(out)
