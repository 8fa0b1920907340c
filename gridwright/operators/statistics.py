"""Exact order statistics and the mode, without gathering a column anywhere."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: So many values may be sorted in one place at the end of a search, and so many such lists in one aggregate.
SMALL, LISTS = 50_000, 16


def order_statistics(df: DataFrame, x: Column, ranks: list[int], n: int | None = None) -> dict[int, float]:
    """The values of these ranks (from 0) among the n non-null values of x."""
    n = df.agg(F.count(x)).first()[0] if n is None else n
    return order_statistics_of(df, [x], [ranks], [n])[0]


def order_statistics_of(df: DataFrame, columns: Sequence[Column], ranks: Sequence[Sequence[int]], counts: Sequence[int]) -> list[dict[int, float]]:
    """For each column the values of its ranks (from 0) among its non-null values,
    of which there are counts.

    Approximate quantiles bracket every rank, counts tell its rank inside the
    bracket, and the search goes on there until few values are left. A round is
    two aggregates for all ranks of all columns together and narrows each about a
    thousandfold. Unlike the built-in exact percentile, no aggregate ever holds all
    distinct values in memory.
    """
    values = df.select(*[c.alias(f"x{i}") for i, c in enumerate(columns)])
    found: list[dict[int, float]] = [{} for _ in columns]
    # For each column and rank: where it still can be, how many values lie below that, and how many in it.
    open_: dict[tuple[int, int], tuple[Column, int, int]] = {(i, r): (F.lit(True), 0, counts[i]) for i, of in enumerate(ranks) for r in set(of)}
    v = [F.col(f"x{i}") for i in range(len(columns))]
    while open_:
        small = [k for k, (_, _, size) in open_.items() if size <= SMALL][:LISTS]
        if small:
            lists = values.agg(*[F.element_at(F.sort_array(F.collect_list(F.when(open_[i, r][0], v[i]))), r - open_[i, r][1] + 1) for i, r in small]).first()
            for (i, r), value in zip(small, lists):
                found[i][r] = value
                del open_[i, r]
            continue
        share = {k: (k[1] - below) / (size - 1) for k, (_, below, size) in open_.items()}
        near = {k: [max(0.0, s - 3e-4), min(1.0, s + 3e-4)] for k, s in share.items()}
        cuts = dict(zip(open_, values.agg(*[F.percentile_approx(F.when(open_[k][0], v[k[0]]), near[k], 10_000) for k in open_]).first()))
        tallies = [c for k, (where, _, _) in open_.items() for x, (low, high) in [(v[k[0]], cuts[k])] for c in (F.count_if(where & (x < low)), F.count_if(where & x.between(low, high)), F.count_if(where & (x == low)))]
        row = values.agg(*tallies).first()
        for n, (k, (where, below, size)) in enumerate(list(open_.items())):
            i, r = k
            (low, high), (under, inside, at_low) = cuts[k], row[3 * n : 3 * n + 3]
            left = r - below
            if left < under:
                open_[k] = (where & (v[i] < low), below, under)
            elif left >= under + inside:
                open_[k] = (where & (v[i] > high), below + under + inside, size - under - inside)
            elif left < under + at_low:
                # An end that holds many equal values is told apart from what lies within.
                found[i][r] = low
                del open_[k]
            else:
                open_[k] = (where & (v[i] > low) & (v[i] <= high), below + under + at_low, inside - at_low)
    return found


def percentiles(df: DataFrame, x: Column, shares: list[float]) -> list[float | None]:
    """Exact percentiles with linear interpolation between neighbours; null without values."""
    return percentiles_of(df, [x], shares)[0]


def percentiles_of(df: DataFrame, columns: Sequence[Column], shares: list[float]) -> list[list[float | None]]:
    """The same of several columns in the same passes."""
    if not columns:
        return []
    counts = list(df.agg(*[F.count(c) for c in columns]).first())
    at = [[s * (n - 1) for s in shares] if n else [] for n in counts]
    found = order_statistics_of(df, columns, [[r for a in of for r in (math.floor(a), math.ceil(a))] for of in at], counts)
    between = lambda x, a: x[math.floor(a)] + (x[math.ceil(a)] - x[math.floor(a)]) * (a - math.floor(a))
    return [[between(x, a) for a in of] if of else [None] * len(shares) for x, of in zip(found, at)]


def most_frequent(df: DataFrame, text: Column, position: Column | None, literal: bool = True) -> str | None:
    """The most frequent text. Ties: whole numbers first, in ascending order (the
    literal rule), then what comes first."""
    return most_frequent_of(df, [text], position, literal)[0]


def most_frequent_of(df: DataFrame, texts: Sequence[Column], position: Column | None, literal: bool = True) -> list[str | None]:
    """The same of several columns by one shuffle: cells are counted by column and
    text, and counts are combined before they move."""
    if not texts:
        return []
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), t.alias("t")) for i, t in enumerate(texts)]))
    per = df.select(cells.alias("cell"), *([position.alias("p")] if position is not None else [])).select("cell.i", "cell.t", *(["p"] if position is not None else [])).filter("t is not null")
    per = per.groupBy("i", "t").agg(F.count(F.lit(1)).alias("n"), (F.min("p") if position is not None else F.min("t")).alias("f"))
    number = F.when(F.col("t").rlike(r"^(0|[1-9][0-9]{0,9})\z"), F.col("t").try_cast("long"))
    number = F.when(number <= 4294967294, number)
    ties = F.struct(-F.col("n"), number.isNull() if literal else F.lit(True), number if literal else F.lit(0).cast("long"), F.col("f"))
    best = {r[0]: r[1] for r in per.groupBy("i").agg(F.min_by("t", ties)).collect()}  # a row for each column
    return [best.get(i) for i in range(len(texts))]
