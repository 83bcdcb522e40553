"""Drift of a parser on a batch of lines: coverage, confidence, errors, and the reasons that they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.plans.compile import parse


def matched(lines: DataFrame, definitions: list[dict], name: str, line: str = "line") -> DataFrame:
    """lines with matched (by that parser, without error), failed and confidence."""
    out = parse(lines, definitions, line)
    ok = F.col("parsed").isNotNull() & F.col("parsed.error").isNull() & (F.col("parsed.parser_name") == name)
    return out.withColumn("matched", F.coalesce(ok, F.lit(False))).withColumn("failed", F.coalesce(F.col("parsed.error").isNotNull(), F.lit(False))).withColumn("confidence", F.col("parsed.confidence"))


def drift_reasons(total: Column, hit: Column, mean: Column, errors: Column, min_coverage: float, min_confidence: float) -> Column:
    coverage = F.when(total > 0, hit / total).otherwise(0.0)
    reasons = F.array(F.when(coverage < min_coverage, "coverage_below_threshold"), F.when((hit > 0) & (mean < min_confidence), "mean_confidence_below_threshold"), F.when(errors > 0, "parser_errors_present"))
    return F.filter(reasons, lambda r: r.isNotNull())


def report(lines: DataFrame, definitions: list[dict], name: str, min_coverage: float = 0.9, min_confidence: float = 0.8, line: str = "line") -> DataFrame:
    """One row: total, matched, coverage, mean_confidence (of matched, 0.0 if none), parse_errors, drift_reasons, drifting."""
    hit = F.count_if("matched")
    counts = matched(lines, definitions, name, line).agg(F.count(F.lit(1)).alias("total"), hit.alias("matched"), F.coalesce(F.avg(F.when(F.col("matched"), F.col("confidence"))), F.lit(0.0)).alias("mean_confidence"), F.count_if("failed").alias("parse_errors"))
    reasons = drift_reasons(F.col("total"), F.col("matched"), F.col("mean_confidence"), F.col("parse_errors"), min_coverage, min_confidence)
    counts = counts.withColumn("coverage", F.when(F.col("total") > 0, F.col("matched") / F.col("total")).otherwise(0.0)).withColumn("drift_reasons", reasons)
    return counts.withColumn("drifting", F.size("drift_reasons") > 0).select("total", "matched", "coverage", "mean_confidence", "parse_errors", "drift_reasons", "drifting")


def unmatched(lines: DataFrame, definitions: list[dict], name: str, order: str, n: int = 10_000, line: str = "line") -> DataFrame:
    """The first n lines, by order, that aren't empty and that the parser doesn't match: what to learn a new parser from."""
    return matched(lines, definitions, name, line).where(~F.col("matched") & (F.trim(F.col(line)) != "")).orderBy(order).limit(n).select(order, line)


def batch_digest(lines: DataFrame, order: str, line: str = "line") -> DataFrame:
    """SHA-256 over the lines joined by line feeds in order; for batches that a driver could hold (monitoring bounds them)."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: x[line])
    return lines.agg(F.sha2(F.array_join(ordered, "\n").cast("binary"), 256).alias("digest"))
