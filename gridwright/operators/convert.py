"""Conversion of a column to another type."""

from __future__ import annotations

from typing import Any

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwright.functions.coerce import is_empty, is_text, text_number, to_instant, to_number, trimmed
from gridwright.functions.params import choice
from gridwright.operators import LITERAL
from gridwright.operators.dates import utc_day
from gridwright.sources.grid import Grid, ToolResult

#: Words for true (fixed values): English, and Persian for "yes" and "correct".
TRUE_WORDS = ["true", "1", "yes", "\N{ARABIC LETTER BEH}\N{ARABIC LETTER LAM}\N{ARABIC LETTER HEH}", "\N{ARABIC LETTER SAD}\N{ARABIC LETTER HAH}\N{ARABIC LETTER FARSI YEH}\N{ARABIC LETTER HAH}"]
_COMMAS = ",\N{ARABIC COMMA}"


def convert_type(grid: Grid, params: dict[str, Any], mode: str = LITERAL) -> ToolResult:
    """target_type: number, text, date, boolean or currency. Literally, empty
    text is the number 0, currency without digits is 0, and a null date is the
    first of January 1970; otherwise these are null."""
    kind = choice(params, "target_type", "number", {"number", "text", "date", "boolean", "currency"})
    i = grid.index(params["column"])
    c, t = grid.col(i), grid.type(i)
    literal = mode == LITERAL
    if kind == "number":
        if is_text(t):
            n = text_number(F.translate(c, _COMMAS, ""))
        else:
            n = None if isinstance(t, (T.BooleanType, T.TimestampType, T.TimestampNTZType, T.DateType)) else to_number(c, t)
        value = F.lit(None).cast("double") if n is None else F.when(~F.isnan(n), n)
    elif kind == "currency":
        digits = F.regexp_replace(grid.text(i, null="null"), "[^0-9.-]", "")
        value = text_number(digits)
        if not literal:
            value = F.when(digits.rlike("[0-9]"), value)
    elif kind == "text":
        value = grid.text(i)
    elif kind == "date":
        value = utc_day(grid, to_instant(c, t, null_is_epoch=literal))
    else:
        value = F.lower(trimmed(grid.text(i, null="null"))).isin(TRUE_WORDS)
    if not literal and kind in ("number", "currency", "date"):
        value = F.when(~is_empty(c, t), value)
    out = grid.set({i: value})

    def measures() -> dict[str, Any]:
        rows, good = grid.df.agg(F.count(F.lit(1)), F.count(value)).first()
        if kind in ("text", "boolean"):
            good = rows
        return {"column": params["column"], "target_type": kind, "converted": good, "failed": rows - good}

    return ToolResult(f"Convert type: {params['column']}", out, measures)
