"""Duplicate rows and duplicate keys."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwright.functions.coerce import is_text
from gridwright.functions.params import choice, text_or
from gridwright.operators import LITERAL
from gridwright.sources.grid import POS, Grid, ToolResult


def key(grid: Grid, i: int) -> Column:
    """A column as part of a key: cells are equal if they read the same, and a
    null reads like empty text. Only text has an empty value to meet a null."""
    if is_text(grid.type(i)):
        return F.coalesce(grid.col(i), F.lit(""))
    return grid.text(i) if isinstance(grid.type(i), (T.MapType, T.ArrayType, T.StructType)) else grid.col(i)


def one_per_key(grid: Grid, keys: list[Column], last: bool = False) -> Grid:
    """The first (or last) row of each key.

    Asking for row number 1 lets every task keep one row per key before the
    shuffle, so a key that holds a third of all rows costs no more than others.
    """
    order = grid.position.desc() if last else grid.position
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return replace(grid, df=grid.df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank"))


def _counts(grid: Grid, keys: list[Column]) -> tuple[int, int]:
    """Rows and distinct keys."""
    per = grid.df.groupBy(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).count()
    row = per.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))).first()
    return row[0], row[1]


def remove_duplicates(grid: Grid, params: dict[str, Any], mode: str = LITERAL) -> ToolResult:
    """mode: all columns, or the one named by column. keep: first or last."""
    scope, keep = text_or(params, "mode", "all"), choice(params, "keep", "first", {"first", "last"})
    keys = [key(grid, i) for i in (range(len(grid.columns)) if scope == "all" else [grid.index(params["column"])])]
    if scope == "all" and not grid.ordered:
        # Every visible column is in the key: any row of a key will do.
        names = [f"__k{i}" for i in range(len(keys))]
        out = replace(grid, df=grid.df.withColumns(dict(zip(names, keys))).dropDuplicates(names).drop(*names))
    else:
        out = one_per_key(grid, keys, keep == "last")

    def measures() -> dict[str, Any]:
        rows, distinct = _counts(grid, keys)
        share = f"{100 * (rows - distinct) / rows:.1f}%" if rows else "NaN%"
        return {"rows": rows, "duplicates_removed": rows - distinct, "remaining": distinct, "pct_removed": share}

    return ToolResult("Remove duplicates", out, measures, note=f"Mode: {scope}, keep: {keep}")


def detect_dup_key(grid: Grid, params: dict[str, Any], mode: str = LITERAL) -> ToolResult:
    """action: report, flag, remove_all, keep_first or keep_last.

    Literally, key_columns names one column and keep_last keeps every row;
    otherwise it may be a list, and keep_last keeps each key's last row.
    """
    action = choice(params, "action", "report", {"report", "flag", "remove_all", "keep_first", "keep_last"})
    named = params["key_columns"]
    if mode != LITERAL:
        named = named if isinstance(named, (list, tuple)) else [n for n in str(named).split(",")]
    indices = [grid.index(n) for n in (named if isinstance(named, (list, tuple)) else [named])]
    keys = [key(grid, i) for i in indices]
    out = grid
    if action in ("flag", "remove_all"):
        # First positions are combined before the shuffle, and the join back is on
        # the position, which is unique: no key's rows ever have to meet.
        position = grid.position
        per = grid.df.groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min(POS).alias("__first"), F.count(F.lit(1)).alias("__n"))
        if action == "flag":
            joined = grid.df.join(per.select("__first"), position == F.col("__first"), "left")
            flagged = replace(grid, df=joined).add([("is_duplicate_key", F.col("__first").isNull().cast("int"))])
            out = replace(flagged, df=flagged.df.drop("__first"))
        else:
            out = replace(grid, df=grid.df.join(per.filter("__n = 1").select("__first"), position == F.col("__first"), "left_semi"))
    elif action == "keep_first" or (action == "keep_last" and mode != LITERAL):
        out = one_per_key(grid, keys, action == "keep_last")

    def measures() -> dict[str, Any]:
        rows, distinct = _counts(grid, keys)
        return {"rows": rows, "duplicate_rows": rows - distinct, "unique_keys": distinct, "action": action}

    return ToolResult("Duplicate keys", out, measures, writes=action != "report")
