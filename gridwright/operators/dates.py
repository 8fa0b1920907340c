"""Dates: parts, shifts and standard formats."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwright.functions.coerce import to_instant, to_text
from gridwright.functions.params import choice, int_or, text_or
from gridwright.operators import LITERAL
from gridwright.sources.grid import Grid, ToolResult

PARTS = {"extract_year": F.year, "extract_month": F.month, "extract_day": F.dayofmonth}
OPERATIONS = {*PARTS, "extract_weekday", "add_days", "format"}


def _utc(grid: Grid, instant: Column) -> Column:
    """Shifted so that the session's clock shows what UTC's does."""
    zone = grid.spark.conf.get("spark.sql.session.timeZone")
    return instant if zone in ("UTC", "Etc/UTC", "GMT") else F.to_utc_timestamp(instant, zone)


def utc_day(grid: Grid, instant: Column) -> Column:
    return F.date_format(_utc(grid, instant), "yyyy-MM-dd")


def date_ops(grid: Grid, params: dict[str, Any], mode: str = LITERAL) -> ToolResult:
    """A part of a date, a shifted date, or the date as text, in a new column
    (parts are numbers, null where there is no date; text is empty there)."""
    operation = choice(params, "operation", "extract_year", OPERATIONS)
    i = grid.index(params["column"])
    when = to_instant(grid.col(i), grid.type(i), null_is_epoch=mode == LITERAL)
    name = operation.replace("extract_", "", 1).replace("_", " ", 1)
    if operation in PARTS:
        value = PARTS[operation](when)
    elif operation == "extract_weekday":
        names = F.array(*[F.lit(d) for d in ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")])
        value = F.when(when.isNull(), "").otherwise(F.get(names, F.coalesce(F.dayofweek(when), F.lit(1)) - 1))
    elif operation == "add_days":
        value = F.coalesce(utc_day(grid, when + F.make_dt_interval(F.lit(int_or(params, "days", 0)))), F.lit(""))
    else:
        value = F.coalesce(utc_day(grid, when), F.lit(""))
    return ToolResult(f"Date operations: {params['column']}", grid.add([(name, value)]), lambda: {"operation": operation, "new_column": name, "rows": grid.df.count()})


#: Formats by name; local parts of the date, but UTC for the first two.
FORMATS = {"%d/%m/%Y": "dd/MM/yyyy", "%m/%d/%Y": "MM/dd/yyyy", "%Y/%m/%d": "yyyy/MM/dd"}


def date_standardize(grid: Grid, params: dict[str, Any], mode: str = LITERAL) -> ToolResult:
    """output_format: ISO8601, %Y-%m-%d, %d/%m/%Y, %m/%d/%Y, %Y/%m/%d or unix (any
    other is ISO8601); handle_errors: null, original or error."""
    form = text_or(params, "output_format", "ISO8601")
    errors = text_or(params, "handle_errors", "null")
    i = grid.index(params["column"])
    c, t = grid.col(i), grid.type(i)
    when = to_instant(c, t, null_is_epoch=mode == LITERAL)
    kind: T.DataType = T.StringType()
    if form == "unix":
        value, kind = F.floor(F.unix_micros(when) / 1_000_000).cast("long"), T.LongType()
    elif form in FORMATS:
        value = F.date_format(when, FORMATS[form])
    else:
        value = utc_day(grid, when)
    if errors != "null":
        value = to_text(value, kind) if kind != T.StringType() else value
        other = F.lit("#DATE_ERROR") if errors == "error" else F.when(c.isNotNull(), grid.text(i))
        value = F.when(when.isNull(), other).otherwise(value)
    out = grid.set({i: value})

    def measures() -> dict[str, Any]:
        rows, good = grid.df.agg(F.count(F.lit(1)), F.count(when)).first()
        return {"format": form, "converted": good, "errors": rows - good}

    return ToolResult(f"Standardise dates: {params['column']}", out, measures)
