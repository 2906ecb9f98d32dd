"""Report documents as JSON and Markdown, tables as CSV, and the history of a monitor.

Documents hold totals and stay on the driver; tables are written by the executors.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMATS = {".json": "json", ".md": "markdown", ".markdown": "markdown", ".csv": "csv"}


def json_safe(value):
    """value with plain keys, lists, and null for numbers that are not finite."""
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [json_safe(v) for v in value]
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return str(value) if isinstance(value, Path) else value


def finite_or_null(column):
    """Column: null in place of NaN and infinities."""
    x = column.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < math.inf), x)


def canonical_hash(document: dict) -> str:
    """SHA-256 of the document as compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(document, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def escape_markdown(text: str) -> str:
    """text for a cell of a Markdown table."""
    return " ".join(text.replace("|", r"\|").split("\n"))


def format_value(value) -> str:
    """A number with six decimals, other values as text; null and non-finite ones are ``unavailable``."""
    if value is None or (isinstance(value, float) and not math.isfinite(value)):
        return "unavailable"
    return f"{float(value):.6f}" if isinstance(value, (int, float)) else escape_markdown(str(value))


def value_text(column):
    """Column: ``format_value`` of a numeric column."""
    known = finite_or_null(column)
    return F.when(known.isNull(), "unavailable").otherwise(F.format_string("%.6f", known))


def cell_text(column):
    """Column: ``escape_markdown`` of a text column."""
    return F.replace(F.replace(column, F.lit("|"), F.lit(r"\|")), F.lit("\n"), F.lit(" "))


def format_of(path: str, given: str | None = None) -> str:
    """The format of a report: the given one or the one of the path's ending."""
    found = given or FORMATS.get(Path(path).suffix.lower())
    if found not in FORMATS.values():
        raise ValueError(f"no report format for {path!r}")
    return found


def markdown(document: dict, title: str = "Report") -> str:
    """The document with a section for each mapping and a table for each list of mappings."""
    lines = [f"# {title}", ""]
    for key, value in document.items():
        if isinstance(value, dict):
            lines += ["", f"## {key}", "", "| name | value |", "|---|---|", *(f"| {escape_markdown(str(k))} | {format_value(v)} |" for k, v in value.items())]
        elif isinstance(value, list) and value and isinstance(value[0], dict):
            names = list(value[0])
            lines += ["", f"## {key}", "", f"| {' | '.join(names)} |", "|" + "---|" * len(names), *("| " + " | ".join(format_value(r.get(n)) for n in names) + " |" for r in value)]
        else:
            lines.append(f"* {escape_markdown(str(key))}: {format_value(value)}")
    return "\n".join(lines) + "\n"


def write_text(path: str, text: str) -> None:
    """Write a file in one step: a reader finds the old one or the new one."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(name, target)


def save_report(document: dict, path: str, given: str | None = None, rows: DataFrame | None = None, title: str = "Report") -> None:
    """Save a report as JSON or Markdown, or its rows as CSV."""
    kind = format_of(path, given)
    if kind == "csv":
        if rows is None:
            raise ValueError("this report has no rows for CSV")
        return save_rows(rows, path)
    write_text(path, markdown(document, title) if kind == "markdown" else json.dumps(json_safe(document), indent=2, allow_nan=False) + "\n")


def save_rows(rows: DataFrame, path: str) -> None:
    """Write a table as a folder of CSV files; the committer shows all of it or nothing."""
    rows.write.mode("overwrite").option("header", True).csv(path)


HISTORY = "shift_monitor_history"


def save_history(path: str, configuration: dict, windows: list[dict]) -> None:
    save_report({"analysis_type": HISTORY, "configuration": configuration, "windows": windows}, path, "json")


def restored_history(payload: dict, configuration: dict) -> list[dict]:
    """The windows of a saved history, which must be one of the same configuration without repeated windows."""
    if not isinstance(payload, dict) or payload.get("analysis_type") != HISTORY:
        raise ValueError("this is no history of a shift monitor")
    if payload.get("configuration") != json_safe(configuration):
        raise ValueError("the history is of another configuration")
    windows = list(payload.get("windows", []))
    if len({w["window_id"] for w in windows}) < len(windows):
        raise ValueError("the history repeats a window")
    return windows
