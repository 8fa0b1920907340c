"""Splitting, merging and dropping columns; dropping empty rows; constants."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwright.functions.coerce import is_empty, is_text, trimmed
from gridwright.functions.params import float_or, given_or, int_or, text_or
from gridwright.operators import LITERAL
from gridwright.operators.dedupe import key
from gridwright.sources.grid import Grid, ToolResult


def _verbatim(text: str) -> str:
    """A pattern that matches text and nothing else."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def split_column(grid: Grid, params: dict[str, Any], mode: str = LITERAL) -> ToolResult:
    """Parts between delimiters in max_splits new columns, trimmed; missing ones
    are empty, and parts beyond them are not kept."""
    delimiter, n = text_or(params, "delimiter", ","), int_or(params, "max_splits", 2)
    parts = F.split(grid.text(grid.index(params["column"])), _verbatim(delimiter), -1)
    new = [(f"{params['column']}_{i + 1}", F.coalesce(trimmed(F.get(parts, F.lit(i))), F.lit(""))) for i in range(n)]
    return ToolResult(f"Split column: {params['column']}", grid.add(new), lambda: {"delimiter": delimiter, "new_columns": n, "rows": grid.df.count()})


def merge_columns(grid: Grid, params: dict[str, Any], mode: str = LITERAL) -> ToolResult:
    """Two columns joined by a separator in a new one; nulls read as empty text."""
    separator, name = str(given_or(params, "separator", " ")), text_or(params, "new_name", "merged")
    a, b = grid.index(params["col1"]), grid.index(params["col2"])
    out = grid.add([(name, F.concat(grid.text(a), F.lit(separator), grid.text(b)))])
    return ToolResult("Merge columns", out, lambda: {"col1": params["col1"], "col2": params["col2"], "separator": separator, "new_column": name, "rows": grid.df.count()})


def _hollow(grid: Grid, params: dict[str, Any], mode: str) -> list[Column]:
    """Per column, whether a cell is empty. Literally, the white space switch only
    decides about NaN, and only the text 'false' turns it off; otherwise cells of
    white space are values when it is off."""
    asked = params.get("consider_whitespace")
    out = []
    for i in range(len(grid.columns)):
        c, t = grid.col(i), grid.type(i)
        if mode == LITERAL:
            if asked != "false" and isinstance(t, (T.DoubleType, T.FloatType)):
                out.append(c.isNull())
            else:
                out.append(is_empty(c, t))
        elif asked in ("false", False) and is_text(t):
            out.append(c.isNull() | (c == ""))
        else:
            out.append(is_empty(c, t))
    return out


def remove_empty_rows(grid: Grid, params: dict[str, Any], mode: str = LITERAL) -> ToolResult:
    """Rows stay if less than threshold percent of their cells are empty."""
    threshold = float_or(params, "threshold", 100.0, mode != LITERAL)
    n = sum((e.cast("int") for e in _hollow(grid, params, mode)), F.lit(0))
    out = grid.filter(n / F.lit(len(grid.columns)) * 100 < threshold)

    def measures() -> dict[str, Any]:
        before, after = grid.df.count(), out.df.count()
        return {"threshold": f"{threshold:g}%", "rows_removed": before - after, "remaining": after}

    return ToolResult("Remove empty rows", out, measures)


def remove_empty_cols(grid: Grid, params: dict[str, Any], mode: str = LITERAL) -> ToolResult:
    """Columns stay if less than threshold percent of their cells are empty; in a
    grid without rows all count as empty. One aggregate decides the schema."""
    threshold = float_or(params, "threshold", 100.0, mode != LITERAL)
    row = grid.df.agg(F.count(F.lit(1)), *[F.count_if(e) for e in _hollow(grid, params, mode)]).first()
    kept = [i for i in range(len(grid.columns)) if (row[i + 1] / row[0] * 100 if row[0] else 100.0) < threshold]
    out = grid.keep(kept)
    return ToolResult("Remove empty columns", out, lambda: {"threshold": f"{threshold:g}%", "columns_removed": len(grid.columns) - len(kept), "remaining": len(kept)})


def _spelled(c: Column, t: T.DataType) -> Column:
    """A key as text that differs where the key does."""
    if isinstance(t, T.BinaryType):
        return F.hex(c)
    return (c + 0.0 if isinstance(t, (T.DoubleType, T.FloatType)) else c).cast("string")  # one zero only


def detect_constant(grid: Grid, params: dict[str, Any], mode: str = LITERAL) -> ToolResult:
    """Columns with at most threshold distinct values, as a grid of column and
    unique_values. Up to one value a minimum and maximum tell, without a shuffle;
    beyond that all columns are counted in the same two passes."""
    threshold = int_or(params, "threshold", 1, mode != LITERAL)
    keys = [key(grid, i) for i in range(len(grid.columns))]
    if threshold <= 1:
        columns = []
        for k in keys:
            columns += [F.min(k), F.max(k), F.count_if(k.isNull())]
        row = grid.df.agg(F.count(F.lit(1)), *columns).first()
        counts = []
        for i in range(len(keys)):
            low, high, nulls = row[1 + 3 * i : 4 + 3 * i]
            if not row[0]:
                counts.append(0)
            else:
                counts.append((0 if low is None else 1 if low == high or low != low and high != high else 2) + (nulls > 0))
    else:
        # Estimates far beyond the threshold, by more than twenty times their error, leave no
        # doubt; the distinct values of the other columns are few, and are counted together.
        about = grid.df.agg(*[F.approx_count_distinct(k, 0.04) for k in keys]).first()
        few = [i for i, n in enumerate(about) if n <= 10 * threshold + 1000]
        counts = [threshold + 1] * len(keys)
        if few:
            cells = [F.struct(F.lit(i).alias("i"), keys[i].isNull().alias("z"), _spelled(keys[i], grid.type(i)).alias("v")) for i in few]
            values = grid.df.select(F.explode(F.array(*cells)).alias("cell")).select("cell.i", "cell.z", "cell.v").distinct()
            per = {r[0]: r[1] for r in values.groupBy("i").count().collect()}  # a row for each column
            for i in few:
                counts[i] = per.get(i, 0)
    found = [(grid.headers[i], n) for i, n in enumerate(counts) if n <= threshold]
    table = grid.spark.createDataFrame(found, "column string, unique_values int")
    names = ", ".join(h for h, _ in found)
    detail = " | ".join(f"{h} ({n} distinct)" for h, n in found)
    return ToolResult("Constant columns", Grid.of(table), lambda: {"columns": len(keys), "constant": len(found), "variable": len(keys) - len(found), "detail": detail}, note=f"Constant columns: {names}" if found else "No constant column", writes=False)
