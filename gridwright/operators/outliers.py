"""Rows whose number lies far from the others."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwright.functions.coerce import is_numeric, to_number
from gridwright.functions.params import choice, float_or
from gridwright.operators import LITERAL
from gridwright.operators.statistics import percentiles
from gridwright.sources.grid import Grid, ToolResult


def remove_outliers(grid: Grid, params: dict[str, Any], mode: str = LITERAL) -> ToolResult:
    """method: iqr, zscore or modified; threshold 1.5 by default. Rows without a
    number stay. Literally, modified is the plain z-score; otherwise it uses the
    median and the median absolute deviation."""
    method = choice(params, "method", "iqr", {"iqr", "zscore", "modified"})
    threshold = float_or(params, "threshold", 1.5, mode != LITERAL)
    i = grid.index(params["column"])
    c, t = grid.col(i), grid.type(i)
    x = to_number(c, t, blank_is_zero=mode == LITERAL)
    lower = upper = None
    if method == "iqr":
        q1, q3 = percentiles(grid.df, x, [0.25, 0.75])
        if q1 is not None:
            lower, upper = q1 - threshold * (q3 - q1), q3 + threshold * (q3 - q1)
    elif method == "zscore" or mode == LITERAL:
        mean, std = grid.df.agg(F.avg(x), F.stddev_pop(x)).first()
        if mean is not None:
            lower, upper = mean - threshold * std, mean + threshold * std
    else:
        middle = percentiles(grid.df, x, [0.5])[0]
        if middle is not None:
            mad = percentiles(grid.df, F.abs(x - middle), [0.5])[0]
            lower, upper = middle - threshold * mad / 0.6745, middle + threshold * mad / 0.6745
    if lower is None:
        out = grid
    elif isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) and abs(lower) < 2**62 and abs(upper) < 2**62:
        # Whole bounds in the column's own type reach the file scan.
        out = grid.filter(c.isNull() | ((c >= math.ceil(lower)) & (c <= math.floor(upper))))
    elif is_numeric(t):
        inside = c.isNull() | ((c >= lower) & (c <= upper))
        out = grid.filter(inside | F.isnan(c) if isinstance(t, (T.DoubleType, T.FloatType)) else inside)
    else:
        out = grid.filter(F.coalesce((x >= lower) & (x <= upper), F.lit(True)))

    def measures() -> dict[str, Any]:
        before, after = grid.df.count(), out.df.count()
        show = lambda v: "NaN" if v is None else f"{v:.2f}"
        return {"method": method, "lower": show(lower), "upper": show(upper), "removed": before - after, "remaining": after}

    return ToolResult(f"Remove outliers: {params['column']}", out, measures)
