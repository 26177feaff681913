"""Spatial filters: convolutions, gradients, divergence, local minima."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..grid import Grid
from .stencil import Offset, moore, neighbours, total


def gaussian_kernel(radius: int) -> list[float]:
    """2r + 1 taps of a Gauss curve with sigma (2r + 1) / 4, of sum 1."""
    sigma = (2 * radius + 1) / 4
    taps = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-radius, radius + 1)]
    return [t / sum(taps) for t in taps]


#: The 3x3 Laplacian, and the two parts of a Sobel kernel.
LAPLACIAN: tuple[tuple[Offset, float], ...] = (((0, -1), 1.0), ((-1, 0), 1.0), ((0, 0), -4.0), ((1, 0), 1.0), ((0, 1), 1.0))
DERIVE = (-1.0, 0.0, 1.0)
SMOOTH = (1.0, 2.0, 1.0)


def convolve(grid: Grid, column: str, kernel: Sequence[tuple[Offset, float]], add: float = 0.0, out: str = "v", border: str = "repeat", strategy: str = "lines") -> Grid:
    """Weighted sum of neighbours (no flip) plus a constant, in ``out``."""
    g = neighbours(grid, column, [o for o, _ in kernel], border, strategy, "_k")
    return g.add(**{out: total(F.col("_k"), [w for _, w in kernel]) + F.lit(add)}).of_without("_k")


def along(grid: Grid, column: str, axis: str, taps: Sequence[float], out: str, border: str = "repeat") -> Grid:
    """One-dimensional convolution along an axis."""
    d, r = grid.axes.index(axis), len(taps) // 2
    offsets = [tuple(k if i == d else 0 for i in range(len(grid.axes))) for k in range(-r, r + 1)]
    return convolve(grid, column, list(zip(offsets, taps, strict=True)), out=out, border=border)


def separable(grid: Grid, column: str, taps: Sequence[float] | Sequence[Sequence[float]], out: str, border: str = "repeat") -> Grid:
    """The same taps along every axis in turn, or one list of taps an axis."""
    each = taps if isinstance(taps[0], (list, tuple)) else [taps] * len(grid.axes)
    g, name = grid, column
    for axis, t in zip(grid.axes, each, strict=True):
        g, name = along(g, name, axis, t, out, border), out
    return g


def gauss(grid: Grid, column: str = "v", radius: int = 5, out: str = "v") -> Grid:
    """Gaussian blur, axis by axis."""
    return separable(grid, column, gaussian_kernel(radius), out)


def laplacian(grid: Grid, column: str = "v", add: float = 128.0, out: str = "v") -> Grid:
    return convolve(grid, column, LAPLACIAN, add, out)


def _unit(grid: Grid, axis: str, k: int) -> Offset:
    return tuple(k if a == axis else 0 for a in grid.axes)


def backward_magnitude(grid: Grid, column: str = "v", out: str = "g") -> Grid:
    """Sum over the axes of the absolute difference to the cell before; 0 at the near faces."""
    offsets = [_unit(grid, a, 0) for a in grid.axes[:1]] + [_unit(grid, a, -1) for a in grid.axes]
    g = neighbours(grid, column, offsets, out="_n")
    parts = [F.abs(F.col("_n")[i + 1] - F.col("_n")[0]) for i in range(len(grid.axes))]
    s = parts[0]
    for p in parts[1:]:
        s = s + p
    return g.add(**{out: s}).of_without("_n")


def symmetric_gradient(grid: Grid, column: str = "v", out: Sequence[str] = ("gx", "gy", "gz"), whole: bool = False) -> Grid:
    """Half the difference of the two neighbours along each axis; whole: cut towards zero."""
    offsets = [o for a in grid.axes for o in (_unit(grid, a, -1), _unit(grid, a, 1))]
    g = neighbours(grid, column, offsets, out="_n")
    made = {}
    for i, name in enumerate(out[: len(grid.axes)]):
        d = F.col("_n")[2 * i + 1] - F.col("_n")[2 * i]
        made[name] = ((d - d % 2) / 2).cast("long") if whole else d / 2
    return g.add(**made).of_without("_n")


def length(*parts: str | Column) -> Column:
    """Euclidean length of components."""
    s = F.lit(0.0)
    for p in parts:
        c = F.col(p) if isinstance(p, str) else p
        s = s + c * c
    return F.sqrt(s)


def symmetric_magnitude(grid: Grid, column: str = "v", out: str = "g") -> Grid:
    names = [f"_g{a}" for a in grid.axes]
    return symmetric_gradient(grid, column, names).add(**{out: length(*names)}).of_without(*names)


def divergence(grid: Grid, field: Sequence[str], out: str = "div") -> Grid:
    """Sum over the axes of the backward difference of that axis's component."""
    g, terms = grid, []
    for axis, name in zip(grid.axes, field, strict=True):
        g = neighbours(g, name, [_unit(g, axis, -1)], out=f"_b{axis}")
        terms.append(F.col(name) - F.col(f"_b{axis}")[0])
    s = terms[0]
    for t in terms[1:]:
        s = s + t
    return g.add(**{out: s}).of_without(*(f"_b{a}" for a in grid.axes))


def sobel(grid: Grid, column: str = "v", out: Sequence[str] = ("sx", "sy", "sz")) -> Grid:
    """Sobel gradient: derivative along an axis, smoothing along the others."""
    g = grid
    for axis, name in zip(grid.axes, out, strict=False):
        g = separable(g, column, [DERIVE if a == axis else SMOOTH for a in grid.axes], name)
    return g


def sobel_magnitude(grid: Grid, column: str = "v", out: str = "g") -> Grid:
    names = [f"_s{a}" for a in grid.axes]
    return sobel(grid, column, names).add(**{out: length(*names)}).of_without(*names)


def sobel_divergence(grid: Grid, field: Sequence[str], weight: float = 1.0, out: str = "div") -> Grid:
    """Weighted sum over the axes of the Sobel derivative of that axis's component."""
    g, names = grid, []
    for axis, name in zip(grid.axes, field, strict=True):
        g = separable(g, name, [DERIVE if a == axis else SMOOTH for a in grid.axes], f"_d{axis}")
        names.append(f"_d{axis}")
    s = F.lit(0.0)
    for n in names:
        s = s + F.col(n)
    return g.add(**{out: s * F.lit(weight)}).of_without(*names)


def local_minima(grid: Grid, column: str = "v", out: str = "label") -> Grid:
    """Linear index plus one where no cell around is smaller, else 0."""
    g = neighbours(grid, column, moore(len(grid.axes)), out="_n")
    return g.add(**{out: F.when(F.array_min("_n") >= F.col(column), g.index() + 1).otherwise(F.lit(0))}).of_without("_n")


def has_smaller(grid: Grid, column: str = "v", out: str = "smaller") -> Grid:
    """1 where a cell around is smaller, else 0."""
    g = neighbours(grid, column, moore(len(grid.axes)), out="_n")
    return g.add(**{out: (F.array_min("_n") < F.col(column)).cast("int")}).of_without("_n")


def lower_completion(grid: Grid, column: str = "v", out: str = "v") -> Grid:
    """One more where no cell around is larger and some is smaller."""
    g = neighbours(grid, column, moore(len(grid.axes)), out="_n")
    v = F.col(column)
    rim = (F.array_max("_n") <= v) & (F.array_min("_n") < v)
    return g.add(**{out: v + rim.cast("int")}).of_without("_n")


def scaled(grid: Grid, column: str, to: float = 100.0, out: str | None = None) -> Grid:
    """Values scaled so that the most is ``to``; the most is one number, found first."""
    most = grid.df.agg(F.max(column)).first()[0] or 0.0
    return grid.add(**{out or column: F.col(column) * F.lit(to / most if most else 0.0)})
