"""Error values of spreadsheets, and signs of broken encodings."""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwright.functions.coerce import is_text, put, trimmed
from gridwright.functions.params import choice
from gridwright.operators import LITERAL
from gridwright.sources.grid import Grid, ToolResult

# The texts that spreadsheets show for errors.
ERRORS = ["#DIV/0!", "#N/A", "#NAME?", "#NULL!", "#NUM!", "#REF!", "#VALUE!", "#ERROR!"]


def _is_error(grid: Grid, i: int) -> Column:
    """Only text can hold an error value."""
    if not is_text(grid.type(i)):
        return F.lit(False)
    return F.coalesce(trimmed(F.upper(grid.col(i))).isin(ERRORS), F.lit(False))


def handle_errors(grid: Grid, params: dict[str, Any], mode: str = LITERAL) -> ToolResult:
    """strategy: fill_default (0), flag_column (null, and _has_error), drop_rows or
    isolate (null). Literally, drop_rows drops rows with nulls of any origin."""
    strategy = choice(params, "strategy", "fill_default", {"fill_default", "flag_column", "drop_rows", "isolate"})
    indices = grid.targets(params.get("column"))
    wrong = {i: _is_error(grid, i) for i in indices}
    anywhere = reduce(or_, wrong.values(), F.lit(False))
    if strategy == "fill_default":
        out = grid.set({i: put(grid.col(i), grid.type(i), e, F.lit("0"), T.StringType()) for i, e in wrong.items() if is_text(grid.type(i))})
    elif strategy == "drop_rows":
        nulls = reduce(or_, (grid.col(i).isNull() for i in indices), F.lit(False))
        out = grid.filter(~(anywhere | nulls) if mode == LITERAL else ~anywhere)
    else:
        flagged = grid.add([("_has_error", anywhere.cast("int"))]) if strategy == "flag_column" else grid
        out = flagged.set({i: F.when(~e, grid.col(i)) for i, e in wrong.items() if is_text(grid.type(i))})

    def measures() -> dict[str, Any]:
        found = grid.df.agg(*[F.count_if(e) for e in wrong.values()]).first() if wrong else ()
        return {"strategy": strategy, "errors_found": sum(found), "final_rows": out.df.count()}

    return ToolResult("Handle errors", out, measures)


#: Literally, the replacement character and letters that often are debris; as
#: intended, only pairs that UTF-8 read as Latin-1 leaves behind.
SUSPECT = {True: r"[\x{fffd}\x{c3}\x{c2}\x{e2}\x{80}]", False: r"\x{fffd}|[\x{c2}\x{c3}][\x{80}-\x{bf}]|\x{e2}[\x{80}\x{20ac}]"}


def detect_encoding(grid: Grid, params: dict[str, Any], mode: str = LITERAL) -> ToolResult:
    """Cells that look wrongly decoded, counted; with fix_encoding 'true' their
    replacement characters become question marks."""
    fix = params.get("fix_encoding") == "true" or (mode != LITERAL and params.get("fix_encoding") is True)
    indices = [i for i in grid.targets(params.get("column")) if is_text(grid.type(i))]
    suspect = {i: F.coalesce(grid.col(i).rlike(SUSPECT[mode == LITERAL]), F.lit(False)) for i in indices}
    out = grid.set({i: F.replace(grid.col(i), F.lit("\N{REPLACEMENT CHARACTER}"), F.lit("?")) for i in indices}) if fix else grid

    def measures() -> dict[str, Any]:
        found = grid.df.agg(*[F.count_if(e) for e in suspect.values()]).first() if suspect else ()
        return {"suspicious_cells": sum(found), "fixed": "yes" if fix else "no", "internal_encoding": "UTF-8"}

    return ToolResult("Detect encoding", out, measures, note="Text columns are Unicode throughout", writes=fix)
