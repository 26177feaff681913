"""Maps over the cells of one or more grids, by functions of columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..grid import Grid
from .stencil import Offset, moore, neighbours


def transform(grid: Grid, op: Callable[[Column], Column], column: str = "v", out: str = "v") -> Grid:
    """``out`` = op(value)."""
    return grid.add(**{out: op(F.col(column))})


def transform_position(grid: Grid, op: Callable[..., Column], column: str = "v", out: str = "v") -> Grid:
    """``out`` = op(value, x, y, …)."""
    return grid.add(**{out: op(F.col(column), *(F.col(a) for a in grid.axes))})


def transform_many(grids: Sequence[Grid], op: Callable[..., Column], column: str = "v", out: str = "v") -> Grid:
    """``out`` = op of the values of several grids of one size, cell by cell."""
    both = grids[0].map(_0=F.col(column))
    for i, g in enumerate(grids[1:], 1):
        both = both.zip(g.map(**{f"_{i}": F.col(column)}))
    return both.map(**{out: op(*(F.col(f"_{i}") for i in range(len(grids))))})


def transform_locator(grid: Grid, op: Callable[[Column], Column], offsets: list[Offset] | None = None, border: str = "repeat", column: str = "v", out: str = "v", assign: str = "update", strategy: str = "lines") -> Grid:
    """``out`` = op(array of neighbours, the centre first); assign "add": added to what ``out`` holds (0 where it is null)."""
    g = neighbours(grid, column, offsets or moore(len(grid.axes)), border, strategy, "_n")
    new = op(F.col("_n"))
    if assign == "add":
        new = F.coalesce(F.col(out), F.lit(0)) + new
    elif assign != "update":
        raise ValueError(f"no assignment {assign}")
    return g.add(**{out: new}).of_without("_n")


def fold_region(grid: Grid, corner: Sequence[int], size: Sequence[int], **aggregates: Column) -> DataFrame:
    """Aggregates over the cells of a box."""
    inside = F.lit(True)
    for a, c, s in zip(grid.axes, corner, size, strict=True):
        inside = inside & F.col(a).between(c, c + s - 1)
    cells = grid.df.filter(inside)
    return (cells.groupBy(*grid.keys) if grid.keys else cells).agg(*(c.alias(n) for n, c in aggregates.items()))


def add_scaled(a: Grid, weight, b: Grid, column: str = "v") -> Grid:
    """a + weight · b."""
    return transform_many([a, b], lambda x, y: x + F.lit(weight) * y, column, column)


def multiply(grid: Grid, factor, column: str = "v") -> Grid:
    return transform(grid, lambda v: v * F.lit(factor), column, column)


def register(grid: Grid, name: str) -> None:
    """Make a grid a view that SQL can name."""
    grid.df.createOrReplaceTempView(name)
