"""Currency and unit conversion."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridwright.functions.coerce import to_fixed, to_number
from gridwright.functions.params import float_or, text_or
from gridwright.operators import LITERAL
from gridwright.sources.grid import Grid, ToolResult

# Units of a currency for a US dollar, and dollars for a unit.
PER_DOLLAR = {"EUR": 0.92, "GBP": 0.79, "JPY": 149.5, "CNY": 7.24, "CAD": 1.36, "AUD": 1.53, "IRR": 42000, "USD": 1}
DOLLARS = {"EUR": 1.09, "GBP": 1.27, "JPY": 0.0067, "CNY": 0.138, "CAD": 0.74, "AUD": 0.65, "IRR": 0.000024, "USD": 1}

# Factors to the base unit of each category.
UNITS: dict[str, dict[str, float]] = {
    "length": {"m": 1, "km": 1000, "cm": 0.01, "mm": 0.001, "ft": 0.3048, "in": 0.0254, "yd": 0.9144, "mi": 1609.344},
    "mass": {"kg": 1, "g": 0.001, "mg": 0.000001, "lb": 0.453592, "oz": 0.028349, "t": 1000},
    "area": {"m2": 1, "km2": 1e6, "cm2": 0.0001, "ft2": 0.092903, "in2": 0.000645, "acre": 4046.86, "ha": 10000},
    "volume": {"m3": 1, "l": 0.001, "ml": 0.000001, "gal": 0.003785, "fl_oz": 0.0000295, "cup": 0.000237},
    "speed": {"ms": 1, "kmh": 0.27778, "mph": 0.44704, "knot": 0.51444},
    "pressure": {"pa": 1, "kpa": 1000, "mpa": 1e6, "bar": 100000, "psi": 6894.76, "atm": 101325},
}


def exchange_rate(params: dict[str, Any], source: str, target: str, mode: str = LITERAL) -> float:
    """manual_rate, or for rate_source 'live' the rate in ``rates`` that the caller
    has fetched (target to units per unit of source); without them a static one.
    Executors never use the network. Literally, static rates there and back don't
    cancel; otherwise they come from one table."""
    if params.get("rate_source") != "live":
        return float_or(params, "manual_rate", 1.0)
    if params.get("rates") is not None:
        return float(params["rates"].get(target) or 1)
    if mode == LITERAL:
        return DOLLARS.get(source, 1) * PER_DOLLAR.get(target, 1)
    return PER_DOLLAR.get(target, 1) / PER_DOLLAR.get(source, 1)


def currency_convert(grid: Grid, params: dict[str, Any], mode: str = LITERAL) -> ToolResult:
    source, target = text_or(params, "from_currency", "USD"), text_or(params, "to_currency", "EUR")
    rate = exchange_rate(params, source, target, mode)
    i = grid.index(params["column"])
    name = f"{params['column']}_{target}"
    value = to_number(grid.col(i), grid.type(i)) * F.lit(rate)
    out = grid.add_with(name, lambda df, column: to_fixed(df, column, value, 4))
    return ToolResult(f"Convert currency: {source} to {target}", out, lambda: {"rate": f"{rate:.6f}", "new_column": name, "rows": grid.df.count()})


def _converted(x: Column, category: str, source: str, target: str, mode: str) -> Column:
    if category == "temperature":
        # Literally, only these four are known.
        if (source, target) == ("C", "F"):
            return x * 9 / 5 + 32
        if (source, target) == ("F", "C"):
            return (x - 32) * 5 / 9
        if (source, target) == ("C", "K"):
            return x + 273.15
        if (source, target) == ("K", "C"):
            return x - 273.15
        if mode != LITERAL and (source, target) == ("F", "K"):
            return (x - 32) * 5 / 9 + 273.15
        if mode != LITERAL and (source, target) == ("K", "F"):
            return (x - 273.15) * 9 / 5 + 32
        if mode != LITERAL and source != target:
            raise ValueError(f"no conversion from {source} to {target}")
        return x
    table = UNITS.get(category)
    if mode != LITERAL and (table is None or source not in table or target not in table):
        raise ValueError(f"no conversion from {source} to {target} in {category}")
    if table is None:
        return x
    return x * float(table.get(source, 1)) / float(table.get(target, 1))


def unit_convert(grid: Grid, params: dict[str, Any], mode: str = LITERAL) -> ToolResult:
    """category: a key of UNITS or temperature. Literally, unknown units have the
    factor 1 and unknown categories change nothing; otherwise they are refused."""
    category, source, target = text_or(params, "category", "length"), text_or(params, "from_unit", "m"), text_or(params, "to_unit", "ft")
    i = grid.index(params["column"])
    value = _converted(to_number(grid.col(i), grid.type(i)), category, source, target, mode)
    out = grid.add_with(f"{params['column']}_{target}", lambda df, column: to_fixed(df, column, value, 6))
    return ToolResult(f"Convert units: {source} to {target}", out, lambda: {"category": category, "from": source, "to": target, "rows": grid.df.count()})
