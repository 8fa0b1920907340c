"""Tool calls on named sheets: route, read, run, write, report."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession

from gridwright.operators import LITERAL
from gridwright.plans.registry import RESERVED, run
from gridwright.sources import wire
from gridwright.sources.grid import POS, Grid, add_sheet, quoted, read_sheet

#: Takes a tier and a request message, returns an answer message.
Backend = Callable[[str, str], str]


@dataclass
class Workbook:
    """Sheets are tables. A call reads the active one, and its result replaces it.

    With a backend every call goes there, whole grid and all (and fails if it
    fails: there is no falling back); without one the tools here are used. A grid
    of more than ``most_rows`` rows goes as files in the folder ``exchange``, which
    backend and cluster share; without that folder it is refused.
    Sheets written by a workbook keep their row order in a hidden column.
    """

    spark: SparkSession
    active: str
    order_by: str | Sequence[str] | None = None
    backend: Backend | None = None
    exchange: str | None = None
    most_rows: int = 100_000

    def grid(self) -> Grid:
        grid = read_sheet(self.spark, self.active)
        return grid if grid.ordered or self.order_by is None else Grid.of(grid.df, self.order_by)

    def call(self, tier: str, tool: str, params: dict[str, Any] | None = None, mode: str = LITERAL) -> dict[str, Any]:
        """Run a tool and write its result; returns the report."""
        if self.backend is not None:
            return self._remote(tier, tool, params or {})
        result = run(self.grid(), tool, params, mode, tier)
        report = {"title": result.title, "stats": result.stats(), "note": result.note}
        if result.writes:
            self._write(result.grid, self.active)
        return report

    def _write(self, grid: Grid, name: str) -> None:
        shown = list(grid.columns) + ([POS] if grid.ordered else [])
        whole = Grid(grid.df.select(*map(quoted, shown)), tuple(shown), tuple(shown), False, grid.marks)
        add_sheet(whole, name)

    def _remote(self, tier: str, tool: str, params: dict[str, Any]) -> Any:
        if tier != "clean" and tier not in RESERVED:
            raise KeyError(f"unknown tier {tier!r}")
        answer = self.backend(tier, wire.request(self.grid(), tool, params, most_rows=self.most_rows, exchange=self.exchange))
        grid, sheet, summary = wire.response(self.spark, answer)
        if grid is not None:
            self._write(grid, sheet or self.active)
        return summary
