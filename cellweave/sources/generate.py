"""Grids and graphs made from parameters alone."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..grid import Grid, empty_grid


def constant(spark: SparkSession, value, size: tuple[int, ...]) -> Grid:
    return empty_grid(spark, size).add(v=F.lit(value))


def checkerboard(spark: SparkSession, white, black, tile: Sequence[int], size: tuple[int, ...]) -> Grid:
    """Tiles in turn; the one at the origin is black."""
    g = empty_grid(spark, size)
    parity = F.lit(0)
    for a, t in zip(g.axes, tile, strict=True):
        parity = parity + F.floor(F.col(a) / t)
    return g.add(v=F.when(parity % 2 == 1, F.lit(white)).otherwise(F.lit(black)))


def unique_ids(spark: SparkSession, size: tuple[int, ...]) -> Grid:
    """Linear index plus one."""
    g = empty_grid(spark, size)
    return g.add(v=g.index() + 1)


def mesh(spark: SparkSession, start: Sequence[int], stop: Sequence[int]) -> Grid:
    """Coordinates from ``start`` towards ``stop`` (exclusive), a value column for each axis."""
    size = tuple(abs(b - a) for a, b in zip(start, stop, strict=True))
    g = empty_grid(spark, size)
    return g.add(**{f"v{d}": F.lit(a) + F.col(c) * (1 if b > a else -1) for d, (c, a, b) in enumerate(zip(g.axes, start, stop, strict=True))})


def basins(spark: SparkSession, size: tuple[int, int], period: int = 500) -> Grid:
    """Square pits: the larger distance from the middle of the period along either axis."""
    half = period // 2
    return empty_grid(spark, size).add(v=F.greatest(F.abs(F.col("x") % period - half), F.abs(F.col("y") % period - half)))


def spiral(spark: SparkSession, size: tuple[int, int], low: int = 0, high: int = 255) -> Grid:
    """A two-valued square spiral: vertical arms on odd columns, horizontal arms on even rows above and odd rows below the middle."""
    nx, ny = size
    x, y = F.col("x"), F.col("y")
    left = y.between(x + 1, nx - x)
    right = y.between(nx - x - 1, x)
    upright = (x % 2 == 1) & F.when(x < nx // 2, left).otherwise(right)
    above = (y % 2 == 0) & x.between(y - 1, ny - y - 1)
    below = (y % 2 == 1) & x.between(ny - y + 1, y - 1)
    across = F.when(y < ny // 2, above).otherwise(below)
    return empty_grid(spark, size).add(v=F.when(upright | across, F.lit(high)).otherwise(F.lit(low)))


def mandelbrot(spark: SparkSession, size: tuple[int, int], xs: tuple[float, float], ys: tuple[float, float], limit: int = 1000) -> Grid:
    """Steps before z*z + c leaves the circle of radius 2, at most ``limit``, and a colour (n, 7n, 13n) mod 256."""

    @pandas_udf("int")
    def steps(re: pd.Series, im: pd.Series) -> pd.Series:
        c = re.to_numpy() + 1j * im.to_numpy()
        z, n = np.zeros_like(c), np.zeros(len(c), dtype=np.int32)
        live = np.ones(len(c), dtype=bool)
        for _ in range(limit):
            z[live] = z[live] * z[live] + c[live]
            live &= (z.real**2 + z.imag**2) <= 4
            if not live.any():
                break
            n[live] += 1
        return pd.Series(n)

    re = F.lit(xs[0]) + F.col("x") * F.lit((xs[1] - xs[0]) / size[0])
    im = F.lit(ys[0]) + F.col("y") * F.lit((ys[1] - ys[0]) / size[1])
    g = empty_grid(spark, size).add(n=steps(re, im))
    return g.add(**{f"c{i}": F.col("n") * k % 256 for i, k in enumerate((1, 7, 13))})


def radial(spark: SparkSession, size: tuple[int, ...]) -> Grid:
    """Distance from the middle cell, its fraction cut off."""
    g = empty_grid(spark, size)
    s = F.lit(0.0)
    for a, n in zip(g.axes, g.size, strict=True):
        s = s + F.pow(F.col(a) - n // 2, F.lit(2.0))
    return g.add(v=F.floor(F.sqrt(s)).cast("int"))


@dataclass(frozen=True)
class Shape:
    """An ellipsoid (e), tube (t) or plate (p): centre, direction or normal, radius, length or thickness, value."""

    kind: str
    centre: tuple[int, int, int]
    radius: float
    value: float
    direction: tuple[float, float, float] = (0.0, 0.0, 1.0)
    extent: float = 0.0


def shape_rows(spark: SparkSession, shapes: Sequence[Shape]) -> DataFrame:
    rows = [(i, s.kind, *s.centre, *map(float, s.direction), float(s.radius), float(s.extent), float(s.value)) for i, s in enumerate(shapes)]
    return spark.createDataFrame(rows, "ord int, kind string, cx int, cy int, cz int, dx double, dy double, dz double, radius double, extent double, value double")


def _inside() -> Column:
    p = [F.col(a) - F.col(f"c{a}") for a in ("x", "y", "z")]
    d = [F.col(f"d{a}") for a in ("x", "y", "z")]
    pp = p[0] * p[0] + p[1] * p[1] + p[2] * p[2]
    dd = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
    pd_ = p[0] * d[0] + p[1] * d[1] + p[2] * d[2]

    def cube(half: Column) -> Column:
        return (F.abs(p[0]) <= half) & (F.abs(p[1]) <= half) & (F.abs(p[2]) <= half)

    r2 = F.col("radius") * F.col("radius")
    tube = cube(F.floor(F.col("extent") / 2) + 1) & (pp - F.try_divide(pd_ * pd_, dd) <= r2)
    plate = cube(F.col("radius")) & (F.try_divide(F.abs(pd_), F.sqrt(dd)) <= F.col("extent") / 2)
    return F.when(F.col("kind") == "e", pp <= r2).when(F.col("kind") == "t", tube).otherwise(plate)


def scene(spark: SparkSession, size: tuple[int, int, int], shapes: Sequence[Shape], background: float = 0.0) -> Grid:
    """A volume with shapes drawn in their order, later ones over earlier ones.

    Shapes are few and come as parameters of this call, so they are sent to all
    tasks and tested against each cell.
    """
    g = empty_grid(spark, size)
    met = g.df.join(F.broadcast(shape_rows(spark, shapes)), _inside(), "left") if shapes else g.df.withColumns({"value": F.lit(None).cast("double"), "ord": F.lit(0)})
    return g.of(met.groupBy(*g.axes).agg(F.coalesce(F.max_by("value", "ord"), F.lit(background)).alias("v")))


def lattice(grid: Grid, column: str, capacity, directed: bool = False) -> DataFrame:
    """Edges (eid, a, b, w_fwd, w_bwd) between side neighbours, a the lower id (linear index).

    capacity: function of the two values. Edges are found by windows along the
    axes, one exchange for each.
    """
    from pyspark.sql import Window

    out = None
    for d, axis in enumerate(grid.axes):
        w = Window.partitionBy(*(a for a in grid.coords if a != axis)).orderBy(axis)
        one = grid.df.select(grid.index().alias("b"), F.lag(grid.index()).over(w).alias("a"), F.col(column).alias("v2"), F.lag(column).over(w).alias("v1")).filter("a IS NOT NULL")
        c = capacity(F.col("v1"), F.col("v2"))
        one = one.select((F.col("a") * len(grid.axes) + d).alias("eid"), "a", "b", c.alias("w_fwd"), (F.lit(0.0) if directed else c).cast("double").alias("w_bwd"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("w_fwd", F.col("w_fwd").cast("double"))


def full_lattice(grid: Grid, column: str, capacity) -> DataFrame:
    """Edges (eid, a, b, w_fwd, w_bwd) between all cells around each other (8 or 26), a the lower id; capacities as for ``lattice``."""
    from ..operators.stencil import moore, neighbours

    half = [o for o in moore(len(grid.axes)) if tuple(reversed(o)) > (0,) * len(o)]
    g = grid.add(_id=grid.index())
    g = neighbours(neighbours(g, "_id", half, "none", out="_ids"), column, half, "none", out="_vs")
    each = g.df.select(F.col("_id").alias("a"), F.col(column).alias("v1"), F.posexplode(F.arrays_zip(F.col("_ids").alias("b"), F.col("_vs").alias("v2"))).alias("k", "p"))
    each = each.filter("p.b IS NOT NULL").withColumn("c", capacity(F.col("v1"), F.col("p.v2")).cast("double"))
    return each.select((F.col("a") * len(half) + F.col("k")).alias("eid"), "a", F.col("p.b").alias("b"), F.col("c").alias("w_fwd"), F.col("c").alias("w_bwd"))


def layered_graph(spark: SparkSession, layers: int, width: int, degree: int, weak: int) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of a graph in layers, each vertex joined to ``degree`` of the next layer.

    Edges out of layer ``weak`` have capacities 1 forward and 2 backward, others
    20 and 40; the first layer hangs on the source, the last on the sink.
    """
    v = spark.range(layers * width).select("id", F.floor(F.col("id") / width).alias("layer"))
    big = F.lit(1e6)
    vertices = v.select("id", F.when(F.col("layer") == 0, big).otherwise(0.0).alias("cap_src"), F.when(F.col("layer") == layers - 1, big).otherwise(0.0).alias("cap_snk"))
    e = v.filter(F.col("layer") < layers - 1).select("*", F.explode(F.sequence(F.lit(0), F.lit(degree - 1))).alias("k"))
    to = (F.col("layer") + 1) * width + (F.col("id") % width + F.col("k")) % width
    thin = F.col("layer") == weak
    edges = e.select((F.col("id") * degree + F.col("k")).alias("eid"), F.col("id").alias("a"), to.cast("long").alias("b"), F.when(thin, 1.0).otherwise(20.0).alias("w_fwd"), F.when(thin, 2.0).otherwise(40.0).alias("w_bwd"))
    return vertices, edges
