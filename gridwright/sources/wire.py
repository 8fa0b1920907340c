"""The JSON messages by which a grid goes to another service and comes back."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridwright.sources.grid import POS, Grid, from_records, unique_names


def request(grid: Grid, tool: str, params: dict[str, Any], license_key: str | None = None, most_rows: int = 100_000, exchange: str | None = None) -> str:
    """The request for a grid. One message holds at most most_rows rows; a larger
    grid is written as JSON lines, a list of cells each with its position first, to
    a new folder in ``exchange``, and the message names it instead of the rows."""
    body = {"tool_id": tool, "params": params, "headers": list(grid.headers), "license_key": license_key}
    rows = grid.frame(sort=True).limit(most_rows + 1).toJSON().collect()
    if len(rows) <= most_rows:
        return json.dumps({**body, "rows": [[json.loads(r).get(c) for c in grid.columns] for r in rows]}, ensure_ascii=False)
    if exchange is None:
        raise ValueError(f"more than {most_rows} rows: name a folder for exchange, or write the grid to files")
    path = f"{exchange}/request-{uuid.uuid4().hex}"
    place = grid.position if grid.ordered else F.lit(None).cast("long")
    grid.df.select(F.to_json(F.struct(place.alias("position"), *[grid.col(i).alias(f"c{i}") for i in range(len(grid.columns))]), {"ignoreNullFields": "false"})).write.text(path)
    return json.dumps({**body, "files": path}, ensure_ascii=False)


def _from_files(spark: SparkSession, headers: list[Any], path: str) -> Grid:
    """A grid of JSON lines as request() writes them; cells are text."""
    names = unique_names(["" if h is None else str(h) for h in headers], [POS])
    kind = "position long, " + ", ".join(f"c{i} string" for i in range(len(names)))
    df = spark.read.schema(kind).option("primitivesAsString", True).json(path)
    ordered = df.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], F.col("position").alias(POS))
    return Grid(ordered, tuple("" if h is None else str(h) for h in headers), tuple(names), True)


def _grid(spark: SparkSession, headers: list[Any], rows: list[list[Any]]) -> Grid:
    names = unique_names(["" if h is None else str(h) for h in headers], [POS])
    if not rows:
        empty = spark.createDataFrame([], ", ".join(f"`{n}` string" for n in names) + f", {POS} long" if names else f"{POS} long")
        return Grid(empty, tuple(str(h) for h in headers), tuple(names), True)
    made = from_records(spark, [dict(zip(names, row)) for row in rows])
    return Grid(made.df, tuple("" if h is None else str(h) for h in headers), made.columns, True)


def response(spark: SparkSession, message: str) -> tuple[Grid | None, str | None, Any]:
    """The grid of an answer, the name of the sheet it makes (None: it replaces
    the active one), and its summary. An answer with an error raises."""
    body = json.loads(message)
    if body.get("error"):
        raise RuntimeError(body["error"])
    summary = body.get("summary") or body
    if body.get("headers") is not None and body.get("files") is not None:
        return _from_files(spark, body["headers"], body["files"]), None, summary
    if body.get("headers") is not None and body.get("rows") is not None:
        return _grid(spark, body["headers"], body["rows"]), None, summary
    if body.get("new_sheet"):
        sheet = body["new_sheet"]
        return _grid(spark, sheet["headers"], sheet["rows"]), sheet["name"], summary
    return None, None, summary
