"""Neighbourhoods, borders and stencils.

Two strategies give the same values. ``lines`` shifts along one axis at a time
with window functions: one exchange an axis, whatever the number of offsets,
and the plan stays in generated code. ``gather`` joins each cell to its
neighbours by key; it takes any offset and serves lines too long for one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..grid import Grid

Offset = tuple[int, ...]
BORDERS = ("none", "repeat", "zero", "mirror", "periodic")


def von_neumann(dims: int) -> list[Offset]:
    """Centre, then one step down each axis, then one step up each axis."""
    unit = [tuple(int(i == d) for i in range(dims)) for d in range(dims)]
    return [(0,) * dims, *(tuple(-c for c in u) for u in unit), *unit]


def moore(dims: int, radius: int = 1) -> list[Offset]:
    """Centre, then the rest of the cube, last axis slowest."""
    cube = [tuple(reversed(o)) for o in product(range(-radius, radius + 1), repeat=dims)]
    return [(0,) * dims, *(o for o in cube if any(o))]


def four() -> list[Offset]:
    """The four side neighbours without the centre: -y, +x, +y, -x."""
    return [(0, -1), (1, 0), (0, 1), (-1, 0)]


def box(low: Sequence[int], high: Sequence[int]) -> list[Offset]:
    """Offsets of the half-open box from ``low`` to ``high``."""
    return [tuple(reversed(o)) for o in product(*(range(a, b) for a, b in zip(reversed(low), reversed(high), strict=True)))]


def border_coord(c: Column, n: int, border: str) -> Column:
    """Where coordinate ``c`` reads in an axis of ``n`` cells; null: nowhere."""
    if border == "repeat":
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), c))
    if border == "mirror":
        return F.when(c < 0, -c).when(c > n - 1, 2 * (n - 1) - c).otherwise(c)
    if border == "periodic":
        return F.pmod(c, F.lit(n))
    return F.when((c >= 0) & (c < n), c)


def _shift(grid: Grid, column: str, k: int, axis: str, border: str) -> Column:
    n, c = grid.extent(axis), F.col(axis)
    line = Window.partitionBy(*(a for a in grid.coords if a != axis)).orderBy(axis)

    def by(j: int) -> Column:
        return F.col(column) if j == 0 else F.lag(column, -j).over(line) if j < 0 else F.lead(column, j).over(line)

    if k == 0:
        return F.col(column)
    inside = by(k)
    if border == "none":
        return inside
    outside = c + k < 0 if k < 0 else c + k > n - 1
    if border == "zero":
        return F.when(outside, F.lit(0)).otherwise(inside)
    if border == "periodic":
        return F.when(outside, by(k + n if k < 0 else k - n)).otherwise(inside)
    at = [j if k < 0 else n - 1 - j for j in range(min(abs(k), n))]  # places that read outside
    sign = -1 if k < 0 else 1
    out = inside
    for j, place in enumerate(at):
        to = min(abs(k) - 2 * j, n - 1 - j) if border == "mirror" else -j
        out = F.when(c == place, by(-sign * to)).otherwise(out)
    return out


def neighbours(grid: Grid, column: str, offsets: list[Offset], border: str = "repeat", strategy: str = "lines", out: str = "n") -> Grid:
    """``grid`` with an array column ``out``: the values of ``column`` at ``offsets``, in their order.

    border: what is read outside the grid: nothing (null), the nearest cell,
    zero, the reflected cell, or the cell from the other side.
    """
    if border not in BORDERS:
        raise ValueError(f"no border rule {border}")
    if strategy == "gather":
        return _gather(grid, column, offsets, border, out)
    df, names = grid.df, {(): column}
    for d, axis in enumerate(grid.axes):
        wanted = dict.fromkeys(o[: d + 1] for o in offsets)
        new = {o: f"_{out}_{'_'.join(str(k).replace('-', 'm') for k in o)}" for o in wanted}
        kept = [c for c in df.columns if not c.startswith(f"_{out}_")]
        df = df.select(*kept, *(_shift(grid, names[o[:-1]], o[-1], axis, border).alias(n) for o, n in new.items()))
        names = new
    kept = [c for c in df.columns if not c.startswith(f"_{out}_")]
    return grid.of(df.select(*kept, F.array(*(names[o] for o in offsets)).alias(out)))


def _gather(grid: Grid, column: str, offsets: list[Offset], border: str, out: str) -> Grid:
    table = F.array(*(F.struct(F.lit(k).alias("k"), *(F.lit(c).alias(a) for a, c in zip(grid.axes, o, strict=True))) for k, o in enumerate(offsets)))
    asked = grid.df.select("*", F.explode(table).alias("o"))
    at = [border_coord(F.col(a) + F.col(f"o.{a}"), grid.extent(a), border).alias(f"_{a}") for a in grid.axes]
    asked = asked.select("*", *at)
    source = grid.df.select(*grid.keys, *(F.col(a).alias(f"_{a}") for a in grid.axes), F.col(column).alias("_v"))
    met = asked.join(source, [*grid.keys, *(f"_{a}" for a in grid.axes)], "left")
    value = F.coalesce("_v", F.lit(0)) if border == "zero" else F.col("_v")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col("o.k").alias("k"), value.alias("v")))), lambda s: s["v"])
    return grid.of(met.groupBy(*grid.df.columns).agg(ordered.alias(out)))


def total(n: Column, weights: Sequence[float] | None = None) -> Column:
    """Sum of an array of neighbours, weighted if weights are given."""
    if weights is None:
        return F.aggregate(n, F.lit(0.0), lambda a, v: a + v)
    terms = [F.get(n, F.lit(i)) * F.lit(w) for i, w in enumerate(weights) if w]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def subview(grid: Grid, corner: Sequence[int], size: Sequence[int]) -> Grid:
    """The box at ``corner``, its coordinates from 0 again; stencils see only the box."""
    if any(c < 0 or c + s > n for c, s, n in zip(corner, size, grid.size, strict=True)):
        raise ValueError("the box leaves the grid")
    ok = F.lit(True)
    for a, c, s in zip(grid.axes, corner, size, strict=True):
        ok = ok & F.col(a).between(c, c + s - 1)
    moved = [(F.col(a) - c).alias(a) for a, c in zip(grid.axes, corner, strict=True)]
    return Grid(grid.df.filter(ok).select(*grid.keys, *moved, *grid.values), tuple(size), grid.keys)


def bordered_subview(grid: Grid, corner: Sequence[int], size: Sequence[int], column: str, offsets: list[Offset], border: str = "repeat", out: str = "n") -> Grid:
    """``subview`` whose stencil may read outside the box, up to the border of the whole grid."""
    return subview(neighbours(grid, column, offsets, border, out=out), corner, size)


def slice_at(grid: Grid, axis: str, at: int) -> Grid:
    """The cells of one plane, without its axis; the axes that are left are named x, y in order."""
    rest = [a for a in grid.axes if a != axis]
    named = [F.col(a).alias(n) for a, n in zip(rest, ("x", "y"), strict=False)]
    size = tuple(grid.extent(a) for a in rest)
    return Grid(grid.df.filter(F.col(axis) == at).select(*grid.keys, *named, *grid.values), size, grid.keys)


def flip(grid: Grid, *axes: str) -> Grid:
    """The grid mirrored along ``axes``."""
    return grid.of(grid.df.select(*grid.keys, *((grid.extent(a) - 1 - F.col(a)).alias(a) if a in axes else F.col(a) for a in grid.axes), *grid.values))


def pad(grid: Grid, size: Sequence[int], offset: Sequence[int], column: str, fill) -> Grid:
    """A larger grid with this one at ``offset`` (periodic) and ``fill`` elsewhere. For frames of one grid."""
    from ..grid import empty_grid

    spark = grid.df.sparkSession
    moved = [F.pmod(F.col(a) + o, F.lit(n)).cast("int").alias(a) for a, o, n in zip(grid.axes, offset, size, strict=True)]
    placed = grid.df.select(*moved, column)
    spine = empty_grid(spark, tuple(size)).df
    return Grid(spine.join(placed, list(grid.axes), "left").select(*grid.axes, F.coalesce(column, F.lit(fill)).alias(column)), tuple(size))
