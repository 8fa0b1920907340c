"""Text: case, stripping, Unicode normalisation, regular expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwright.functions.coerce import BLANK, is_empty, trimmed
from gridwright.functions.params import choice, text_or
from gridwright.functions.patterns import Pattern
from gridwright.operators import LITERAL
from gridwright.sources.grid import Grid, ToolResult

#: Digits of three scripts: ASCII, Extended Arabic-Indic and Arabic-Indic.
DIGITS = r"0-9\x{6f0}-\x{6f9}\x{660}-\x{669}"


def _titled(s: Column) -> Column:
    """The first character of each run of ASCII word characters in upper case."""
    runs = F.regexp_extract_all(s, F.lit("[A-Za-z0-9_]+|[^A-Za-z0-9_]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[A-Za-z0-9_]"), F.concat(F.upper(F.left(r, F.lit(1))), F.substring(r, 2, 1 << 30))).otherwise(r)), "")


OPERATIONS: dict[str, Callable[[Column], Column]] = {
    "trim": trimmed,
    "uppercase": F.upper,
    "lowercase": F.lower,
    "title_case": _titled,
    "remove_special": lambda s: F.regexp_replace(s, rf"[^a-zA-Z0-9\x{{600}}-\x{{6ff}}{BLANK}]", ""),
    "remove_numbers": lambda s: F.regexp_replace(s, f"[{DIGITS}]", ""),
    "remove_spaces": lambda s: F.regexp_replace(s, f"[{BLANK}]+", ""),
    "extract_numbers": lambda s: F.array_join(F.regexp_extract_all(s, F.lit(f"[{DIGITS}.,-]+"), F.lit(0)), " "),
}


def _rewritten(grid: Grid, i: int, change: Callable[[Column], Column]) -> tuple[Grid, Column]:
    """Cells with a value become changed text, empty ones stay; and a flag: the text differs."""
    c, t = grid.col(i), grid.type(i)
    text = grid.text(i)
    value, empty = change(text), is_empty(c, t)
    kept = c if t == T.StringType() else F.when(c.isNotNull(), text)
    return grid.set({i: F.when(empty, kept).otherwise(value)}), ~empty & (value != text)


def text_ops(grid: Grid, params: dict[str, Any], mode: str = LITERAL) -> ToolResult:
    operation = choice(params, "operation", "trim", OPERATIONS)
    out, changed = _rewritten(grid, grid.index(params["column"]), OPERATIONS[operation])

    def measures() -> dict[str, Any]:
        rows, n = grid.df.agg(F.count(F.lit(1)), F.count_if(changed)).first()
        return {"operation": operation, "rows": rows, "changed": n, "unchanged": rows - n}

    return ToolResult(f"Text operations: {params['column']}", out, measures)


def _normalizer(form: str, strip: bool) -> Callable[[Column], Column]:
    """Unicode normal forms, for which Spark has no function: Arrow batches."""

    def one(s: str) -> str:
        if s.isascii():
            return s
        s = unicodedata.normalize(form, s)
        return "".join(ch for ch in unicodedata.normalize("NFD", s) if not 0x300 <= ord(ch) <= 0x36F) if strip else s

    @F.pandas_udf("string")
    def normalize(s: pd.Series) -> pd.Series:
        return s.map(one, na_action="ignore")

    return normalize


def normalize_text(grid: Grid, params: dict[str, Any], mode: str = LITERAL) -> ToolResult:
    """operations: nfkc (or any text with it), nfc, nfd, remove_accents,
    lowercase, or all; others leave the text as it is."""
    wanted = text_or(params, "operations", "nfkc")
    everything = wanted == "all"
    form = "NFKC" if "nfkc" in wanted or everything else {"nfc": "NFC", "nfd": "NFD"}.get(wanted)
    strip = everything or wanted == "remove_accents"

    def change(s: Column) -> Column:
        if form or strip:
            s = _normalizer(form or "NFD", strip)(s)
        return F.lower(s) if everything or wanted == "lowercase" else s

    out, changed = _rewritten(grid, grid.index(params["column"]), change)
    return ToolResult(f"Normalise text: {params['column']}", out, lambda: {"operations": wanted, "changed": grid.df.select(changed.alias("x")).filter("x").count()})


FLAGS = {"case_insensitive": "i", "multiline": "m", "dotall": "s"}


def regex_replace(grid: Grid, params: dict[str, Any], mode: str = LITERAL) -> ToolResult:
    """Every match of pattern replaced. flags: case_insensitive, multiline or dotall."""
    source = params.get("pattern")
    if not source:
        raise ValueError("a pattern is needed")
    replacement = "" if params.get("replacement") is None else str(params["replacement"])
    pattern = Pattern(source, FLAGS.get(params.get("flags"), ""))
    java = pattern.replacement(replacement)
    out, changed = _rewritten(grid, grid.index(params["column"]), lambda s: F.regexp_replace(s, F.lit(pattern.java), F.lit(java)))
    return ToolResult(f"Regex replace: {params['column']}", out, lambda: {"pattern": source, "replacement": replacement, "rows_changed": grid.df.filter(changed).count()})
