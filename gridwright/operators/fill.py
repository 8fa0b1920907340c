"""Missing values: constants, statistics, ordered fills, dropping."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwright.functions.coerce import is_empty, is_numeric, is_text, put, to_number
from gridwright.functions.params import choice, float_or, given_or, leading_float
from gridwright.operators import LITERAL
from gridwright.operators.statistics import most_frequent_of, percentiles_of
from gridwright.sources.grid import POS, Grid, ToolResult
from gridwright.sources.positions import carried


def _empties(grid: Grid, indices: list[int]) -> dict[int, Column]:
    return {i: is_empty(grid.col(i), grid.type(i)) for i in indices}


def _numbers(grid: Grid, indices: list[int], mode: str) -> dict[int, Column]:
    return {i: to_number(grid.col(i), grid.type(i), blank_is_zero=mode == LITERAL) for i in indices}


def _means(grid: Grid, indices: list[int], mode: str) -> dict[int, float]:
    """One aggregate for all columns."""
    numbers = _numbers(grid, indices, mode)
    row = grid.df.agg(*[F.avg(n) for n in numbers.values()]).first()
    return {i: 0.0 if row[k] is None else row[k] for k, i in enumerate(indices)}


def _medians(grid: Grid, indices: list[int], mode: str) -> dict[int, float]:
    """The same passes for all columns."""
    found = percentiles_of(grid.df, list(_numbers(grid, indices, mode).values()), [0.5])
    return {i: middle or 0.0 for i, (middle,) in zip(indices, found)}


def _fill_with(grid: Grid, values: dict[int, Any]) -> Grid:
    """Empty cells replaced by one value per column."""
    changes = {}
    for i, v in values.items():
        c, t = grid.col(i), grid.type(i)
        if v is None:
            changes[i] = F.when(~is_empty(c, t), c)
            continue
        if isinstance(v, str) and is_numeric(t) and leading_float(v) is not None and str(v).strip() == str(v):
            v = float(leading_float(v))
        kind = T.StringType() if isinstance(v, str) else T.BooleanType() if isinstance(v, bool) else T.DoubleType()
        whole = not isinstance(v, (str, bool)) and float(v).is_integer() and isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        value = F.lit(int(v)).cast(t) if whole else F.lit(v if isinstance(v, (str, bool)) else float(v))
        changes[i] = put(c, t, is_empty(c, t), value, t if whole else kind)
    return grid.set(changes)


def _ordered_fill(grid: Grid, indices: list[int], forward: bool, otherwise: dict[int, Column]) -> Grid:
    """Empty cells take the nearest value before (or after) them; where there is
    none, ``otherwise``."""
    grid.position  # noqa: B018  (an order is needed)
    empty = _empties(grid, indices)
    names = {i: f"__fill_{i}" for i in indices}
    df = carried(grid.df, POS, {names[i]: (grid.col(i), ~empty[i]) for i in indices}, forward)
    filled = replace(grid, df=df).set({i: F.when(empty[i], F.coalesce(F.col(names[i]), otherwise[i])).otherwise(grid.col(i)) for i in indices})
    return replace(filled, df=filled.df.drop(*names.values()))


def fill_missing(grid: Grid, params: dict[str, Any], mode: str = LITERAL) -> ToolResult:
    """method: mean, median, zero, value (fill_value), ffill or bfill; of one
    column or of all. Literally, text columns get numbers too; otherwise only
    numeric columns are filled with statistics unless a column is named."""
    method = choice(params, "method", "mean", {"mean", "median", "ffill", "bfill", "value", "zero"})
    indices = grid.targets(params.get("column"))
    if mode != LITERAL and not params.get("column") and method in ("mean", "median", "zero"):
        indices = [i for i in indices if is_numeric(grid.type(i))]
    if method in ("ffill", "bfill"):
        out = _ordered_fill(grid, indices, method == "ffill", {i: grid.col(i) for i in indices})
    elif method in ("mean", "median"):
        out = _fill_with(grid, (_means if method == "mean" else _medians)(grid, indices, mode)) if indices else grid
    else:
        value = 0 if method == "zero" else given_or(params, "fill_value", 0)
        out = _fill_with(grid, {i: value for i in indices})

    def measures() -> dict[str, Any]:
        def empties(g: Grid) -> int:
            return g.df.agg(*[F.count_if(e) for e in _empties(g, indices).values()]).first() if indices else ()

        before = sum(empties(grid))
        left = sum(empties(out)) if method in ("ffill", "bfill") else 0
        return {"cells_filled": before - left, "method": method, "columns_processed": len(indices)}

    return ToolResult("Fill missing values", out, measures)


STRATEGIES = {"mean", "median", "mode", "constant", "forward_fill", "backward_fill", "interpolate", "drop_rows", "drop_cols"}


def missing_strategy(grid: Grid, params: dict[str, Any], mode: str = LITERAL) -> ToolResult:
    """Nine strategies. Literally, interpolate fills zeros and drop_cols looks at
    all columns whatever column is named; forward_fill turns leading empty cells
    into nulls, and backward_fill repeats the last row's own cell at the end."""
    strategy = choice(params, "strategy", "mean", STRATEGIES)
    threshold = float_or(params, "threshold", 50.0, mode != LITERAL)
    indices = grid.targets(params.get("column"))
    out = grid
    if strategy == "drop_cols":
        looked = list(range(len(grid.columns))) if mode == LITERAL else indices
        empty = _empties(grid, looked)
        row = grid.df.agg(F.count(F.lit(1)), *[F.count_if(e) for e in empty.values()]).first()
        gone = {i for k, i in enumerate(looked, start=1) if row[0] and 100 * row[k] / row[0] > threshold}
        out = grid.keep([i for i in range(len(grid.columns)) if i not in gone])
    elif strategy == "drop_rows":
        condition = F.lit(True)
        for e in _empties(grid, indices).values():
            condition = condition & ~e
        out = grid.filter(condition)
    elif strategy in ("mean", "median"):
        out = _fill_with(grid, (_means if strategy == "mean" else _medians)(grid, indices, mode))
    elif strategy == "constant":
        out = _fill_with(grid, {i: given_or(params, "constant_value", 0) for i in indices})
    elif strategy == "mode":
        position = grid.position if grid.ordered else None
        cells = [F.when(~is_empty(grid.col(i), grid.type(i)), grid.text(i)) for i in indices]
        modes = dict(zip(indices, most_frequent_of(grid.df, cells, position, mode == LITERAL)))
        changes = {}
        for i, v in modes.items():
            c, t = grid.col(i), grid.type(i)
            changes[i] = F.when(is_empty(c, t), F.lit(v).try_cast(t)).otherwise(c)  # a column keeps its type
        out = grid.set(changes)
    elif strategy == "forward_fill":
        out = _ordered_fill(grid, indices, True, {i: F.lit(None).cast(grid.type(i)) for i in indices})
    elif strategy == "backward_fill":
        grid.position  # noqa: B018
        last = grid.df.agg(*[F.max_by(F.struct(grid.col(i)), F.col(POS)) for i in indices]).first()
        out = _ordered_fill(grid, indices, False, {i: F.lit(last[k][0] if last[k] else None).cast(grid.type(i)) for k, i in enumerate(indices)})
    elif mode == LITERAL:
        out = _fill_with(grid, {i: 0 for i in indices})
    else:
        out = _interpolated(grid, [i for i in indices if is_numeric(grid.type(i)) or is_text(grid.type(i))], mode)

    def measures() -> dict[str, Any]:
        return {"strategy": strategy, "final_rows": out.df.count(), "final_columns": len(out.columns)}

    return ToolResult("Missing value strategy", out, measures)


def _interpolated(grid: Grid, indices: list[int], mode: str) -> Grid:
    """Straight lines between the neighbouring numbers, by position."""
    grid.position  # noqa: B018
    numbers = _numbers(grid, indices, mode)
    wanted = {i: (F.struct(numbers[i].alias("y"), F.col(POS).alias("x")), numbers[i].isNotNull()) for i in indices}
    df = carried(grid.df, POS, {f"__a_{i}": v for i, v in wanted.items()}, True)
    df = carried(df, POS, {f"__b_{i}": v for i, v in wanted.items()}, False)
    changes = {}
    for i in indices:
        a, b = F.col(f"__a_{i}"), F.col(f"__b_{i}")
        y = a["y"] + (b["y"] - a["y"]) * (F.col(POS) - a["x"]) / (b["x"] - a["x"])
        e = is_empty(grid.col(i), grid.type(i))
        changes[i] = put(grid.col(i), grid.type(i), e & a.isNotNull() & b.isNotNull(), y, T.DoubleType())
    out = replace(grid, df=df).set(changes)
    return replace(out, df=out.df.drop(*[f"__{s}_{i}" for i in indices for s in "ab"]))
