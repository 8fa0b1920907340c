"""Parameters arrive as loose values, mostly text; these read them."""

from __future__ import annotations

import math
import re
from typing import Any

_FLOAT = re.compile(r"\s*([+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|Infinity))")
_INT = re.compile(r"\s*([+-]?\d+)")


def leading_float(value: Any) -> float | None:
    """The number that value begins with, if any."""
    if isinstance(value, bool) or value is None:
        return None
    m = _FLOAT.match(str(value))
    if not m:
        return None
    return float(m[1].replace("Infinity", "inf"))


def leading_int(value: Any) -> int | None:
    if isinstance(value, bool) or value is None:
        return None
    m = _INT.match(str(value))
    return int(m[1]) if m else None


def float_or(params: dict, name: str, default: float, zero_counts: bool = False) -> float:
    """A number; garbage is the default, and so is 0 unless zero_counts."""
    x = leading_float(params.get(name))
    return default if x is None or math.isnan(x) or (x == 0 and not zero_counts) else x


def int_or(params: dict, name: str, default: int, zero_counts: bool = False) -> int:
    x = leading_int(params.get(name))
    return default if x is None or (x == 0 and not zero_counts) else x


def text_or(params: dict, name: str, default: str) -> str:
    """Text; a missing or empty value is the default."""
    return str(params[name]) if params.get(name) not in (None, "") else default


def given_or(params: dict, name: str, default: Any) -> Any:
    """Any given value, empty text included; only a missing one is the default."""
    return default if params.get(name) is None else params[name]


def choice(params: dict, name: str, default: str, allowed: set[str] | list[str] | dict) -> str:
    """One of the allowed words; others are refused before anything is computed."""
    value = text_or(params, name, default)
    if value not in allowed:
        raise ValueError(f"{name}: {value!r} is not one of {', '.join(sorted(allowed))}")
    return value
