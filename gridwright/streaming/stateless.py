"""Row-wise tools on streams."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame

from gridwright.operators import LITERAL
from gridwright.plans.registry import STATELESS, run
from gridwright.sources.grid import Grid


def clean_stream(stream: DataFrame, steps: Iterable[tuple[str, dict[str, Any]]], mode: str = LITERAL) -> DataFrame:
    """A streaming DataFrame with tools applied to each row; works on batches too.

    Tools that need the whole table (duplicates, statistics, ordered fills,
    column dropping) are refused: they have no meaning row by row.
    """
    grid = Grid.of(stream)
    for tool, params in steps:
        if tool not in STATELESS:
            raise ValueError(f"{tool} needs the whole table and cannot run on a stream")
        grid = run(grid, tool, params, mode).grid
    return grid.frame()
