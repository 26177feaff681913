"""Dense grids as DataFrames: one row a cell, keyed by its coordinates."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Cells ``df`` with integer coordinates x, y (and z) from 0, x fastest.

    size: extents (nx, ny) or (nx, ny, nz). keys: further columns that tell
    grids of one frame apart, such as an image id; all operators work on every
    grid of a frame at once.
    """

    df: DataFrame
    size: tuple[int, ...]
    keys: tuple[str, ...] = ()

    @property
    def axes(self) -> tuple[str, ...]:
        return ("x", "y", "z")[: len(self.size)]

    @property
    def coords(self) -> tuple[str, ...]:
        return (*self.keys, *self.axes)

    @property
    def values(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.coords]

    def extent(self, axis: str) -> int:
        return self.size[self.axes.index(axis)]

    def of(self, df: DataFrame) -> Grid:
        return replace(self, df=df)

    def map(self, **columns: Column) -> Grid:
        """The grid with these value columns in place of its own."""
        return self.of(self.df.select(*self.coords, *(c.alias(n) for n, c in columns.items())))

    def add(self, **columns: Column) -> Grid:
        """The grid with these value columns added or replaced."""
        return self.of(self.df.withColumns(columns))

    def of_without(self, *columns: str) -> Grid:
        """The grid without some value columns."""
        return self.of(self.df.drop(*columns))

    def zip(self, other: Grid, **names: str) -> Grid:
        """Cells of both grids side by side; ``names`` renames value columns of ``other``."""
        if self.size != other.size:
            raise ValueError(f"grids of {self.size} and {other.size} do not go together")
        right = other.df.withColumnsRenamed(names)
        return self.of(self.df.join(right, list(self.coords)))

    def index(self) -> Column:
        """Linear index x + nx * (y + ny * z)."""
        return linear_index([F.col(a) for a in self.axes], self.size)

    def check_dense(self) -> None:
        """Raise unless every grid of the frame has each of its cells once."""
        cells = 1
        for n in self.size:
            cells *= n
        ok = F.lit(True)
        for a in self.axes:
            ok = ok & F.col(a).between(0, self.extent(a) - 1)
        got = self.df.groupBy(*self.keys).agg(F.count("*").alias("n"), F.countDistinct(F.when(ok, self.index())).alias("d"))
        if not got.filter((F.col("n") != cells) | (F.col("d") != cells)).isEmpty():
            raise ValueError("the grid is not dense")


def linear_index(coords: list[Column], size: tuple[int, ...]) -> Column:
    out = F.lit(0).cast("long")
    for c, n in zip(reversed(coords), reversed(size), strict=True):
        out = out * F.lit(n).cast("long") + c.cast("long")
    return out


def coords_of(index: Column, size: tuple[int, ...]) -> list[Column]:
    """The coordinates of a linear index."""
    out, rest = [], index
    for n in size[:-1]:
        out.append((rest % n).cast("int"))
        rest = F.floor(rest / n) if n > (1 << 30) else (rest - rest % n) / n
        rest = rest.cast("long")
    return [*out, rest.cast("int")]


def empty_grid(spark: SparkSession, size: tuple[int, ...]) -> Grid:
    """All cells of a grid, without values."""
    n = 1
    for k in size:
        n *= k
    cells = spark.range(n)
    names = ("x", "y", "z")[: len(size)]
    return Grid(cells.select(*(c.alias(a) for a, c in zip(names, coords_of(F.col("id"), size), strict=True))), size)


def densify(grid: Grid, spark: SparkSession, **fill) -> Grid:
    """Every cell of the extents, with ``fill`` where the grid has none. For frames of one grid."""
    spine = empty_grid(spark, grid.size).df
    joined = spine.join(grid.df, list(grid.axes), "left")
    return grid.of(joined.select(*grid.axes, *(F.coalesce(F.col(n), F.lit(v)).alias(n) for n, v in fill.items())))
