"""Reports as files on the driver, and the bounds of inputs that are read there."""

from __future__ import annotations

import html
import json
import re
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most bytes, lines and bytes a line of inputs, by what reads them.
BOUNDS = {"monitor": (50 << 20, 1_000_000, 64 << 10), "learn": (50 << 20, 10_000, 64 << 10), "verify": (50 << 20, 100_000, 128 << 10), "bench": (100 << 20, 1_000_000, 64 << 10), "export": (1 << 30, None, 1 << 20)}


def check_bounds(lines: DataFrame, use: str, line: str = "line") -> int:
    """The number of lines; ValueError if there are none or they are beyond the bounds of that use. One aggregation, nothing is collected."""
    most, count, longest = BOUNDS[use]
    n, widest, total = lines.agg(F.count(F.lit(1)), F.max(F.octet_length(line)), F.sum(F.octet_length(line) + 1)).first()
    if not n:
        raise ValueError("the input has no lines")
    if total > most or (count and n > count) or widest > longest:
        raise ValueError(f"the input is beyond {most} bytes, {count} lines or {longest} bytes a line")
    return n


def safe_name(name: str, most: int = 64) -> str:
    """A part of a file name: at most so many ASCII letters, digits, - and _, other characters as _, beginning with a letter."""
    kept = [c if c in "-_" or (c.isascii() and c.isalnum()) else "_" for c in name[:most]]
    if not kept:
        return "parser"
    return "".join(kept if kept[0].isalpha() else ["parser_", *kept])


def write_atomic(path: Path, text: str) -> Path:
    path.parent.mkdir(parents=True, exist_ok=True)
    temporary = path.with_name(f".{path.name}.tmp")
    temporary.write_text(text, encoding="utf-8")
    temporary.replace(path)
    return path


def verification_report(report: dict, folder: str | Path) -> tuple[Path, Path]:
    """The report as JSON and as a page."""
    stem = f"{safe_name(report['parser_name'])}-v{report['parser_version']}-verification"
    text = json.dumps(report, indent=2, sort_keys=True)
    title = html.escape(f"Verification of {report['parser_name']}, version {report['parser_version']}")
    page = f'<!doctype html>\n<html><head><meta charset="utf-8"><title>{title}</title></head>\n<body><h1>{title}</h1><pre>{html.escape(text)}</pre></body></html>\n'
    return write_atomic(Path(folder) / f"{stem}.json", text + "\n"), write_atomic(Path(folder) / f"{stem}.html", page)


def monitor_report(report: dict, name: str, digest: str, folder: str | Path) -> Path:
    """The report as JSON, named by parser and batch."""
    return write_atomic(Path(folder) / f"{safe_name(name, 40)}-{digest[:16]}-monitor.json", json.dumps(report, indent=2, sort_keys=True) + "\n")


def benchmark_report(result: dict, path: str | Path) -> Path:
    text = "# Benchmark\n\nA generated file, from reading it to the stored raw lines, events and quarantine; nothing is synced per record.\n\n"
    return write_atomic(Path(path), f"{text}```json\n{json.dumps(result, indent=2, sort_keys=True)}\n```\n")
