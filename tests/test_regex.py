import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.functions.regex import UnsafePattern, group_names, lint, optional_groups, to_java
from logloom.plans.definitions import BUILTIN


@pytest.mark.parametrize("pattern", [r"(?=a)b", r"(?!a)b", r"(?<=a)b", r"(?<!a)b", r"(a)\1", r"(?P<x>a)(?P=x)", r"a++", r"(?>a)", r"a\Z", "(", "a\\"])
def test_lint_rejects(pattern):
    assert lint(pattern)
    with pytest.raises(UnsafePattern):
        to_java(pattern)


@pytest.mark.parametrize("pattern", [r"a\+\+b", r"[(?=]x", r"(?P<a_b>\d+)(?:x|y)$", r"[]a]+", r"a{2,3}?", r"\[+"])
def test_lint_accepts(pattern):
    assert lint(pattern) == []


def test_translation():
    java, names, numbers = to_java(r"^(x)(?P<a_b>\s+)(?P<c>[^\s\d]+)$")
    assert names == ["a_b", "c"] and numbers == [2, 3]
    assert java == r"(?d)^(x)([\t\n\f\r ]+)([^\t\n\f\r 0-9]+)\z"
    assert group_names(r"(?P<a>x)(?<b>y)") == ["a", "b"]
    assert optional_groups(r"(?P<a>x)?y") and optional_groups(r"(?P<a>x)|(?P<b>y)") and not optional_groups(r"(?P<a>x*)(?:y)?")


def test_builtin_patterns_match_python(spark):
    """Captures of the translated patterns on near misses are those of the original patterns."""
    seeds = [
        "Sep 29 08:15:00 fw01 %ASA-4-106023: Deny tcp src 10.0.0.5/443 dst 203.0.113.4/443 by x",
        "CEF:0|A|B|9.12|106023|Deny|5|src=10.0.0.5 msg=x",
        "date=2026-09-29 time=08:15:00 log_id=000000001 action=deny srcip=10.0.0.5 dstip=203.0.113.4 proto=tcp srcport=443 dstport=443",
        '{"time":"2026"}',
    ]
    lines = {s for s in seeds} | {s[:i] + c + s[i + 1 :] for s in seeds for i in range(0, len(s), 3) for c in ("\t", "|", "\r", " ", "é")} | {s + e for s in seeds for e in ("\n", "\r", " ", "x")}
    df = spark.createDataFrame([(x,) for x in sorted(lines)], "line string")
    for d in BUILTIN:
        pattern = d["templates"][0]["regex"]
        java, names, numbers = to_java(pattern)
        got = df.select("line", F.col("line").rlike(java).alias("m"), *[F.regexp_extract("line", java, n).alias(f"g{n}") for n in numbers]).collect()
        compiled = re.compile(re.sub(r"\\d", "[0-9]", pattern.replace("$", r"\Z")).replace(r"\s", r"[\t\n\f\r ]").replace(r"\S", r"[^\t\n\f\r ]"))
        for r in got:
            m = compiled.search(r["line"])
            assert r["m"] == bool(m), (pattern, r["line"])
            assert not m or [r[f"g{n}"] for n in numbers] == [m[n] for n in names]


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from(list("ab()[]\\?*+{}|^$dswP<>=!:-12")), max_size=12))
def test_lint_never_crashes(pattern):
    if not lint(pattern):
        to_java(pattern)
