"""Tools by name, and chains of them as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from gridwright.operators import INTENDED, LITERAL, columns, convert, dates, dedupe, errors, fill, outliers, text, units, validate
from gridwright.sources.grid import Grid, ToolResult

Tool = Callable[..., ToolResult]

TOOLS: dict[str, Tool] = {
    "remove-duplicates": dedupe.remove_duplicates,
    "fill-missing": fill.fill_missing,
    "remove-outliers": outliers.remove_outliers,
    "convert-type": convert.convert_type,
    "text-ops": text.text_ops,
    "split-column": columns.split_column,
    "merge-columns": columns.merge_columns,
    "handle-errors": errors.handle_errors,
    "date-ops": dates.date_ops,
    "normalize-text": text.normalize_text,
    "remove-empty-rows": columns.remove_empty_rows,
    "remove-empty-cols": columns.remove_empty_cols,
    "regex-replace": text.regex_replace,
    "validate-email": validate.validate_email,
    "validate-phone": validate.validate_phone,
    "validate-url": validate.validate_url,
    "detect-encoding": errors.detect_encoding,
    "date-standardize": dates.date_standardize,
    "currency-convert": units.currency_convert,
    "unit-convert": units.unit_convert,
    "detect-dup-key": dedupe.detect_dup_key,
    "detect-constant": columns.detect_constant,
    "invalid-values": validate.invalid_values,
    "missing-strategy": fill.missing_strategy,
}

#: Tools that look at one row at a time; these also run on streams.
STATELESS = frozenset({
    "convert-type", "text-ops", "split-column", "merge-columns", "handle-errors", "date-ops", "normalize-text", "remove-empty-rows", "regex-replace", "validate-email",
    "validate-phone", "validate-url", "detect-encoding", "date-standardize", "currency-convert", "unit-convert", "invalid-values",
})

#: Tiers whose tools are known by name only, with no definition to build from.
RESERVED = ("filter", "transform", "stats", "ml", "viz", "ai", "import", "export", "profiling", "dataeng", "productivity")


def run(grid: Grid, tool: str, params: dict[str, Any] | None = None, mode: str = LITERAL, tier: str = "clean") -> ToolResult:
    if mode not in (LITERAL, INTENDED):
        raise ValueError(f"mode: {mode!r} is neither {LITERAL} nor {INTENDED}")
    if tier in RESERVED:
        raise NotImplementedError(f"tier {tier!r} has no tools here")
    if tier != "clean":
        raise KeyError(f"unknown tier {tier!r}")
    if tool not in TOOLS:
        raise KeyError(f"unknown tool {tool!r}")
    return TOOLS[tool](grid, dict(params or {}), mode)


def chain(grid: Grid, steps: Iterable[tuple[str, dict[str, Any]]], mode: str = LITERAL) -> Grid:
    """Several tools in turn. Row-wise steps collapse into one projection, so a
    chain of them costs one scan."""
    for tool, params in steps:
        grid = run(grid, tool, params, mode).grid
    return grid
