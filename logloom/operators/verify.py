"""Verification of a draft parser on labelled cases, and the states that a parser goes through."""

from __future__ import annotations

import copy

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.regex import lint
from logloom.plans.compile import event_path, match_count, parse
from logloom.schemas import PATHS

# The states that may follow a state.
NEXT = {"draft": {"verified"}, "verified": {"active"}, "active": {"drifting"}, "drifting": {"active", "superseded"}, "superseded": set()}


def score(cases: DataFrame, definition: dict) -> DataFrame:
    """cases (raw, expected_template_id, required_fields) with actual_template_id, regex_matches, missing, error and the flags of the counters."""
    trial = copy.deepcopy(definition) | {"state": "verified"}
    out = parse(cases.withColumn("line", F.col("raw")), [trial]).withColumn("error", F.col("parsed.error"))
    ok = F.col("parsed").isNotNull() & F.col("error").isNull()
    out = out.withColumn("actual_template_id", F.when(ok, F.col("parsed.template_id"))).withColumn("regex_matches", match_count([trial], F.col("raw")))
    has = {}
    for t in trial["templates"]:
        for f in t["fields"]:
            path = event_path(f["ocsf_path"])
            leaf = F.col(f"parsed.{PATHS[f['ocsf_path']]}").cast("string") if f["ocsf_path"] in PATHS else F.try_variant_get(F.try_element_at(F.col("parsed.open"), F.lit(".".join(path or ()))), "$", "string")
            has[t["id"], f["name"]] = F.coalesce(leaf != "", F.lit(False))
    present = F.filter(F.array(*[F.when((F.col("actual_template_id") == t) & c, F.lit(n)) for (t, n), c in has.items()]) if has else F.array().cast("array<string>"), lambda x: x.isNotNull())
    out = out.withColumn("missing", F.array_except("required_fields", present))
    e, a = F.col("expected_template_id"), F.col("actual_template_id")
    return out.withColumns({"positive": e.isNotNull(), "covered": F.coalesce(e == a, F.lit(False)), "overmerged": a.isNotNull() & ~a.eqNullSafe(e), "ambiguous": F.col("regex_matches") > 1}).drop("line", "parsed")


def summary(scored: DataFrame) -> DataFrame:
    """One row of counters, with coverage 0.0 without positive cases, and valid: all cases fine. A file of negative cases alone can be valid."""
    n = lambda c: F.count_if(c)
    s = scored.agg(F.count(F.lit(1)).alias("cases_checked"), n("positive").alias("positive_cases"), n("covered").alias("covered_cases"), n("overmerged").alias("overmerged_cases"), F.coalesce(F.sum(F.size("missing")), F.lit(0)).cast("bigint").alias("missing_required_fields"), n("ambiguous").alias("ambiguous_cases"), n(F.col("error").isNotNull()).alias("errors"))
    c = F.col
    return s.withColumn("coverage", F.when(c("positive_cases") > 0, c("covered_cases") / c("positive_cases")).otherwise(0.0)).withColumn("valid", (c("covered_cases") == c("positive_cases")) & (c("overmerged_cases") == 0) & (c("missing_required_fields") == 0) & (c("ambiguous_cases") == 0) & (c("errors") == 0))


def refuse_unknown(cases: DataFrame, definition: dict) -> None:
    """ValueError if there is no case, or one that names a template that the parser lacks, or requires a field that its template lacks."""
    known = F.create_map(*[x for t in definition["templates"] for x in (F.lit(t["id"]), F.array(*[F.lit(f["name"]) for f in t["fields"]]).cast("array<string>"))])
    fields = F.try_element_at(known, F.col("expected_template_id"))
    stray = F.size(F.array_except("required_fields", F.coalesce(fields, F.array().cast("array<string>")))) > 0
    n, templates, required = cases.agg(F.count(F.lit(1)), F.count_if(F.col("expected_template_id").isNotNull() & fields.isNull()), F.count_if(stray)).first()
    if not n or templates or required:
        raise ValueError(f"of {n} cases {templates} name an unknown template and {required} require an unknown field" if n else "there are no cases")


def verify(cases: DataFrame, definition: dict) -> dict:
    """The report of a draft. Patterns that aren't linear-time fail it before any case is tried."""
    if definition["state"] != "draft":
        raise ValueError("only draft parsers can be verified")
    refuse_unknown(cases, definition)
    problems = [f"{t['id']}: {p}" for t in definition["templates"] for p in lint(t["regex"])]
    named = {"parser_name": definition["name"], "parser_version": definition["version"]}
    if problems:
        return named | {"regex_safe": False, "valid": False, "coverage": 0.0, "errors": problems}
    return named | {"regex_safe": True} | summary(score(cases, definition)).first().asDict()


def transition(definition: dict, state: str, report: dict | None = None, reference: str | None = None) -> dict:
    """The definition in its next state. To verified needs a report's reference; to active a valid report of the same name and version, but for a return from drifting."""
    now = definition["state"]
    if state not in NEXT.get(now, set()):
        raise ValueError(f"{now} can't become {state}")
    out = copy.deepcopy(definition)
    if state == "verified":
        if not reference:
            raise ValueError("a verified parser needs the reference of its report")
        out["verify_report_ref"] = reference
    if state == "active" and now == "verified":
        if not report or report.get("valid") is not True or (report.get("parser_name"), report.get("parser_version")) != (definition["name"], definition["version"]):
            raise ValueError("activation needs a valid report of this parser and version")
    out["state"] = state
    return out
