"""The grid: a DataFrame with display headers and an optional row position.

Headers may repeat or be empty; the DataFrame's columns are unique. Row order is
part of a grid's meaning, so it is kept as data: a hidden column holds the
position, and tools that depend on order use it. Nothing is sorted until the
grid is shown or written.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwright.functions.coerce import is_text, quoted, to_text
from gridwright.sources.positions import numbered

POS = "__pos"
MARKS = "gridwright.marks"  #: the table property that keeps a sheet's marks


def unique_names(headers: Iterable[str], taken: Iterable[str] = ()) -> list[str]:
    """Column names for headers: repeated ones get _2, _3 and so on, empty ones a letter."""
    seen, out = {t.lower() for t in taken}, []
    for h in headers:
        base = h or "column"
        name, n = base, 1
        while name.lower() in seen:
            n += 1
            name = f"{base}_{n}"
        seen.add(name.lower())
        out.append(name)
    return out


@dataclass(frozen=True)
class Grid:
    df: DataFrame
    headers: tuple[str, ...]
    columns: tuple[str, ...]
    ordered: bool = False
    marks: tuple[tuple[str, str], ...] = ()  #: ranges of cells and the colours that a viewer should give them

    @staticmethod
    def of(df: DataFrame, order_by: str | Sequence[str] | None = None, headers: Sequence[str] | None = None, unique: bool = False) -> Grid:
        """A grid of all columns of df. order_by: the column (or columns) whose
        order is the row order, nulls first; rows are numbered by it, ties in the
        order in which they are read. unique: the caller vouches that one column of
        whole numbers has no null and no value twice, so it is the position."""
        columns = tuple(c for c in df.columns if c != POS)
        names = tuple(headers) if headers else columns
        if order_by is None:
            return Grid(df, names, columns, POS in df.columns)
        by = [order_by] if isinstance(order_by, str) else list(order_by)
        kind = df.schema[by[0]].dataType
        if unique and len(by) == 1 and isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            placed = df.withColumn(POS, F.col(quoted(by[0])).cast("long"))
        else:
            placed = numbered(df, [F.col(quoted(b)).asc_nulls_first() for b in by], POS)
        return Grid(placed, names, columns, True)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def index(self, name: str) -> int:
        """Of the first header equal to name, white space around both aside."""
        wanted = str(name).strip()
        for i, h in enumerate(self.headers):
            if h.strip() == wanted:
                return i
        raise KeyError(f"no column {name!r}")

    def targets(self, name: str | None) -> list[int]:
        """The named column, or all columns if name is missing."""
        return [self.index(name)] if name else list(range(len(self.columns)))

    def col(self, i: int) -> Column:
        return F.col(quoted(self.columns[i]))

    def type(self, i: int) -> T.DataType:
        return self.df.schema[self.columns[i]].dataType

    def text(self, i: int, null: str = "") -> Column:
        return to_text(self.col(i), self.type(i), null)

    @property
    def position(self) -> Column:
        if not self.ordered:
            raise ValueError("this depends on row order: give the grid an order (Grid.of(df, order_by=...))")
        return F.col(POS)

    def _hidden(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.columns]

    def set(self, changes: dict[int, Column]) -> Grid:
        """Columns replaced in one projection."""
        parts = [changes[i].alias(c) if i in changes else F.col(quoted(c)) for i, c in enumerate(self.columns)]
        return replace(self, df=self.df.select(*parts, *map(quoted, self._hidden())))

    def add(self, new: Sequence[tuple[str, Column]]) -> Grid:
        """Columns appended at the right; a name that is taken gets a suffix."""
        names = unique_names([n for n, _ in new], self.df.columns)
        df = self.df.select("*", *[c.alias(n) for n, (_, c) in zip(names, new)])
        taken = unique_names([n for n, _ in new], self.headers)
        return replace(self, df=df, headers=(*self.headers, *taken), columns=(*self.columns, *names))

    def add_with(self, name: str, make: Callable[[DataFrame, str], DataFrame]) -> Grid:
        """One column appended by a function of the DataFrame and the column's name."""
        column = unique_names([name], self.df.columns)[0]
        return replace(self, df=make(self.df, column), headers=(*self.headers, unique_names([name], self.headers)[0]), columns=(*self.columns, column))

    def keep(self, indices: Sequence[int]) -> Grid:
        columns = [self.columns[i] for i in indices]
        return replace(self, df=self.df.select(*map(quoted, [*columns, *self._hidden()])), columns=tuple(columns), headers=tuple(self.headers[i] for i in indices))

    def filter(self, condition: Column) -> Grid:
        return replace(self, df=self.df.filter(condition))

    def frame(self, sort: bool = False) -> DataFrame:
        """The visible columns; sort: in row order."""
        df = self.df.orderBy(POS) if sort and self.ordered else self.df
        return df.select(*map(quoted, self.columns))


@dataclass
class ToolResult:
    """A tool's grid and its report. Statistics are computed when asked for, by
    one aggregate over the tool's input."""

    title: str
    grid: Grid
    measures: Callable[[], dict[str, Any]] = field(default=dict)
    note: str = ""
    writes: bool = True

    @property
    def df(self) -> DataFrame:
        return self.grid.frame()

    def stats(self) -> dict[str, Any]:
        return self.measures()


# Grid primitives


def sheet_names(spark: SparkSession) -> list[str]:
    return [t.name for t in spark.catalog.listTables()]


def read_sheet(spark: SparkSession, name: str, order_by: str | Sequence[str] | None = None) -> Grid:
    if not spark.catalog.tableExists(name):
        raise KeyError(f"no sheet {name!r}")
    grid = Grid.of(spark.table(name), order_by)
    kept = {r[0]: r[1] for r in spark.sql(f"SHOW TBLPROPERTIES {quoted(name)}").collect()} if not _temporary(spark, name) else {}
    return replace(grid, marks=tuple((a, b) for a, b in json.loads(kept.get(MARKS, "[]"))))


def _temporary(spark: SparkSession, name: str) -> bool:
    return spark.catalog.getTable(quoted(name)).tableType in ("TEMPORARY", "VIEW")


def read_files(spark: SparkSession, path: str, kind: str = "parquet", order_by: str | Sequence[str] | None = None, schema: T.StructType | str | None = None, **options: Any) -> Grid:
    """A grid of files. CSV and JSON without a schema are read as text only, in
    one pass, so that every rule sees the cells as they were written."""
    reader = spark.read.format(kind).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    elif kind == "csv":
        reader = reader.option("header", options.get("header", True)).option("inferSchema", False)
    elif kind == "json":
        reader = reader.option("primitivesAsString", True)
    return Grid.of(reader.load(path), order_by)


def column_names(grid: Grid) -> list[str]:
    return list(grid.headers)


def read_range(grid: Grid, columns: Sequence[int], first: int, last: int) -> Grid:
    """The rows at positions first to last (inclusive) of some columns; the first
    of them becomes the header row."""
    part = grid.keep(list(columns)).filter(grid.position.between(first, last))
    head = part.df.orderBy(POS).limit(1).collect()
    if not head:
        return part
    headers = ["" if head[0][c] is None else str(head[0][c]) for c in part.columns]
    names = unique_names(headers, [POS])
    df = part.df.filter(F.col(POS) > head[0][POS]).select(*[F.col(quoted(c)).alias(n) for c, n in zip(part.columns, names)], POS)
    return Grid(df, tuple(headers), tuple(names), True)


def _counted(df: DataFrame) -> tuple[DataFrame, Callable[[], int]]:
    """df, and the number of its rows once an action has gone over it."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("n")), lambda: seen.get["n"]


def write_files(grid: Grid, path: str, kind: str = "parquet", mode: str = "overwrite", sort: bool = False, **options: Any) -> int:
    """Write the visible columns; returns the number of rows, counted on the way."""
    df, rows = _counted(grid.frame(sort))
    df.write.format(kind).mode(mode).options(**options).save(path)
    return rows()


def add_sheet(grid: Grid, name: str, sort: bool = False) -> dict[str, Any]:
    """Create the sheet anew, whether or not one of that name exists. It is written
    beside an old one, which is moved aside then and dropped last, and comes back
    if the new one can't take its place. The grid may read the sheet it replaces."""
    spark = grid.spark
    df, rows = _counted(grid.frame(sort))
    tag = uuid.uuid4().hex
    fresh, old = f"{name}__new_{tag}", f"{name}__old_{tag}"
    df.write.saveAsTable(fresh)
    if grid.marks:
        text = json.dumps(grid.marks, ensure_ascii=True).replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"ALTER TABLE {quoted(fresh)} SET TBLPROPERTIES ('{MARKS}' = '{text}')")
    there = spark.catalog.tableExists(name)
    if there:
        spark.sql(f"ALTER TABLE {quoted(name)} RENAME TO {quoted(old)}")
    try:
        spark.sql(f"ALTER TABLE {quoted(fresh)} RENAME TO {quoted(name)}")
    except Exception:
        if there:
            spark.sql(f"ALTER TABLE {quoted(old)} RENAME TO {quoted(name)}")
        raise
    if there:
        spark.sql(f"DROP TABLE {quoted(old)}")
    return {"sheet": name, "rows_written": rows()}


def _values(grid: Grid, name: str, values: Sequence[Any]) -> DataFrame:
    return grid.spark.createDataFrame([(i, v) for i, v in enumerate(values)], T.StructType([T.StructField("__at", T.LongType()), T.StructField(name, _kind(values))]))


def _kind(values: Sequence[Any]) -> T.DataType:
    kinds = {type(v) for v in values if v is not None}
    if kinds <= {int}:
        return T.LongType()
    if kinds <= {int, float}:
        return T.DoubleType()
    return T.BooleanType() if kinds == {bool} else T.StringType()


def _listed(values: Sequence[Any]) -> list[Any]:
    kind = _kind(values)
    if isinstance(kind, T.DoubleType):
        return [None if v is None else float(v) for v in values]
    return [v if v is None or not isinstance(kind, T.StringType) else str(v) for v in values]


def add_column(grid: Grid, name: str, values: Sequence[Any] | Column) -> Grid:
    """Append a column: an expression, or a list that goes with positions 0, 1, 2 ..."""
    if isinstance(values, Column):
        return grid.add([(name, values)])
    side = _values(grid, "__new", _listed(values))
    joined = grid.df.join(side, grid.position == F.col("__at"), "left").drop("__at")
    taken = replace(grid, df=joined).add([(name, F.col("__new"))])
    return replace(taken, df=taken.df.drop("__new"))


def update_column(grid: Grid, name: str, values: Sequence[Any] | Column) -> Grid:
    """Replace the column whose header equals name exactly."""
    if name not in grid.headers:
        raise KeyError(f"no column {name!r}")
    i = grid.headers.index(name)
    if isinstance(values, Column):
        return grid.set({i: values})
    side = _values(grid, "__new", _listed(values))
    joined = replace(grid, df=grid.df.join(side, grid.position == F.col("__at"), "left").drop("__at"))
    changed = joined.set({i: F.col("__new")})
    return replace(changed, df=changed.df.drop("__new"))


def delete_rows(grid: Grid, positions: Sequence[int] | DataFrame) -> Grid:
    """Without the rows at these positions; repeated ones count once. A DataFrame
    has them in its first column, and then may be of any size."""
    if not isinstance(positions, DataFrame):
        return grid.filter(~grid.position.isin(sorted(set(positions)))) if positions else grid
    gone = positions.select(F.col(positions.columns[0]).cast("long").alias("__at"))
    return replace(grid, df=grid.df.join(gone, grid.position == F.col("__at"), "left_anti"))


def delete_columns(grid: Grid, indices: Sequence[int]) -> Grid:
    return grid.keep([i for i in range(len(grid.columns)) if i not in set(indices)])


def mark_cells(grid: Grid, cells: str, color: str) -> dict[str, str]:
    """Presentation only: what a viewer should colour, as metadata."""
    return {"range": cells, "color": color}


def highlighted(grid: Grid, cells: str, color: str) -> Grid:
    """The grid with a range marked; a sheet written from it keeps its marks, and
    of marks on one range the last one counts."""
    mark = mark_cells(grid, cells, color)
    return replace(grid, marks=(*((a, b) for a, b in grid.marks if a != cells), (mark["range"], mark["color"])))


def from_records(spark: SparkSession, records: Sequence[dict[str, Any]]) -> Grid:
    """Rows from records; the first one's keys are the headers, in its order, and
    missing or null values are empty text."""
    if not records:
        return Grid(spark.createDataFrame([], f"{POS} long"), (), (), True)
    headers = [str(k) for k in records[0]]
    names = unique_names(headers, [POS])
    data = [[r.get(k) for k in records[0]] for r in records]
    kinds = [_kind([row[i] for row in data]) for i in range(len(headers))]
    # A column with a gap holds empty text there, so it is text throughout.
    kinds = [T.StringType() if any(row[i] is None for row in data) else k for i, k in enumerate(kinds)]
    rows = [(i, *["" if v is None else float(v) if isinstance(k, T.DoubleType) else str(v) if is_text(k) else v for v, k in zip(row, kinds)]) for i, row in enumerate(data)]
    schema = T.StructType([T.StructField(POS, T.LongType()), *[T.StructField(n, k) for n, k in zip(names, kinds)]])
    return Grid(spark.createDataFrame(rows, schema), tuple(headers), tuple(names), True)


def to_records(grid: Grid) -> DataFrame:
    """A JSON object for each row; of equal headers the last one's value counts."""
    last = {h: i for i, h in enumerate(grid.headers)}
    return grid.df.select(F.to_json(F.struct(*[grid.col(i).alias(h) for h, i in last.items()]), {"ignoreNullFields": "false"}).alias("record"))


def column_values(grid: Grid, i: int) -> DataFrame:
    return grid.df.select(grid.col(i))
