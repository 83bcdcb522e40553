"""CSV lines: strict splitting, header detection, and rows by the header's names."""

from __future__ import annotations

import csv
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions.encode import sorted_map
from logloom.functions.fields import convert
from logloom.plans.compile import PARSED

# Header names and the event columns and types that they stand for.
COLUMNS = {
    "time": {"kind": "timestamp", "names": ["time", "timestamp", "event_time", "datetime"]},
    "src_ip": {"kind": "ipv4", "names": ["src", "srcip", "src_ip", "source_ip", "source_address"]},
    "dst_ip": {"kind": "ipv4", "names": ["dst", "dstip", "dst_ip", "destination_ip", "destination_address"]},
    "src_port": {"kind": "int", "names": ["sport", "srcport", "src_port"]},
    "dst_port": {"kind": "int", "names": ["dport", "dstport", "dst_port"]},
    "protocol_name": {"kind": "free_text", "names": ["proto", "protocol", "protocol_name"]},
    "action": {"kind": "free_text", "names": ["action", "result"]},
    "message": {"kind": "free_text", "names": ["msg", "message", "description"]},
    "severity": {"kind": "free_text", "names": ["severity"]},
    "user_name": {"kind": "free_text", "names": ["username", "user", "user_name"]},
}
KNOWN = [n for c in COLUMNS.values() for n in c["names"]]


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_csv(lines: pd.Series) -> pd.Series:
    """The values of a CSV line by strict rules; null if they are broken. (Spark's reader pads short rows and takes empty values as null.)"""

    def one(line):
        try:
            return next(csv.reader([line], strict=True))
        except (csv.Error, StopIteration):
            return None

    return lines.map(one, na_action="ignore")


def header_of(values: Column) -> Column:
    """The header's normalised names if the values are a header: two or more, none empty, all different, two or more known; else null."""
    names = F.transform(values, lambda v: F.translate(F.lower(F.trim(v)), "- ", "__"))
    known = F.size(F.filter(names, lambda n: n.isin(*KNOWN)))
    return F.when((F.size(names) >= 2) & (F.size(F.array_distinct(names)) == F.size(names)) & ~F.array_contains(names, "") & (known >= 2), names)


def parse_rows(df: DataFrame, header: str = "header", values: str = "values", into: str = "csv") -> DataFrame:
    """df with a struct column (PARSED): the values by the header's names; null if there is no header or another number of values.

    Of names for the same column the last with a value counts; an empty value is no value; other columns stay unmapped.
    """
    h, v = F.col(header), F.col(values)
    pairs = F.map_from_arrays(h, v)
    found: dict[str, tuple[Column, Column]] = {}
    for leaf, c in COLUMNS.items():
        text = F.try_element_at(F.filter(F.zip_with(h, v, lambda n, x: F.when(n.isin(*c["names"]) & (x != ""), x)), lambda x: x.isNotNull()), F.lit(-1))
        value, error = convert(c["kind"], text)
        found[leaf] = value, F.when(text.isNotNull(), error)
    unmapped = sorted_map(F.map_filter(pairs, lambda k, _: ~k.isin(*KNOWN)))
    leaves = ("time", "action", "severity", "message", "user_name", "protocol_name", "src_ip", "src_port", "dst_ip", "dst_port")
    result = F.struct(
        F.lit("csv_header").alias("parser_name"), F.lit(1).cast("bigint").alias("parser_version"), F.lit("csv_header").alias("template_id"), F.lit(0.9).alias("confidence"), F.lit("Network Activity").alias("event_class"), F.lit("record").alias("activity"),
        reduce(lambda a, b: F.coalesce(a, b), [e for _, e in found.values()]).cast("string").alias("error"), *[found[x][0].alias(x) for x in leaves], unmapped.alias("unmapped"), F.to_json(unmapped).alias("unmapped_json"),
        F.lit(None).cast("map<string,variant>").alias("open"), F.lit(None).cast("string").alias("invalid"),
    )
    return df.withColumn(into, F.when(h.isNotNull() & v.isNotNull() & (F.size(h) == F.size(v)), result.cast(PARSED)))
