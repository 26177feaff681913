"""Tiles with a halo, for filters that built-in expressions cannot hold: non-local means and coherence-enhancing diffusion.

Cells are dealt to tiles, with copies of those that a neighbouring tile needs;
each tile is one NumPy array in one task, and one exchange does for any radius.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..grid import Grid
from .filters import DERIVE, SMOOTH, gaussian_kernel


def map_tiles(grid: Grid, columns: Sequence[str], halo: int, solve: Callable[[list[np.ndarray], list[tuple[int, int]]], list[np.ndarray]], out: Sequence[str], tile: int = 32) -> Grid:
    """Value columns ``out`` from ``solve``, which gets a padded array for each column and returns arrays of the same shape.

    Beyond the border of the grid the nearest cell is repeated; how many such
    cells there are before and after, for each axis of the arrays, is the second
    argument. Arrays are indexed by the axes in reverse, x last.
    """
    df = grid.df
    last = [(n - 1) // tile for n in grid.size]
    for a, m in zip(grid.axes, last, strict=True):
        low = F.greatest(F.lit(0), F.floor((F.col(a) - halo) / tile)).cast("int")
        high = F.least(F.lit(m), F.floor((F.col(a) + halo) / tile)).cast("int")
        df = df.withColumn(f"_t{a}", F.explode(F.sequence(low, high)))
    axes, size, keys = grid.axes, grid.size, grid.keys
    schema = grid.df.select(*grid.coords).schema
    for n in out:
        schema = schema.add(n, "double")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        corner = [int(pdf[f"_t{a}"].iloc[0]) * tile for a in axes]
        low = [max(0, c - halo) for c in corner]
        high = [min(n, c + tile + halo) for c, n in zip(corner, size, strict=True)]
        at = tuple(pdf[a].to_numpy() - lo for a, lo in zip(reversed(axes), reversed(low), strict=True))
        ends = [min(c + tile, n) for c, n in zip(corner, size, strict=True)]
        pads = [(halo - (c - lo), halo - (h - e)) for c, lo, e, h in zip(corner, low, ends, high, strict=True)]
        arrays = []
        for n in columns:
            a = np.zeros([h - lo for lo, h in zip(reversed(low), reversed(high), strict=True)])
            a[at] = pdf[n].to_numpy()
            arrays.append(np.pad(a, list(reversed(pads)), mode="edge"))
        inner = tuple(slice(halo, halo + e - c) for c, e in zip(reversed(corner), reversed(ends), strict=True))
        made = [a[inner] for a in solve(arrays, list(reversed(pads)))]
        grids = np.meshgrid(*(np.arange(c, e, dtype=np.int32) for c, e in zip(reversed(corner), reversed(ends), strict=True)), indexing="ij")
        found = {k: pdf[k].iloc[0] for k in keys}
        found |= {a: g.ravel() for a, g in zip(reversed(axes), grids, strict=True)}
        found |= {n: m.ravel() for n, m in zip(out, made, strict=True)}
        return pd.DataFrame(found)[[f.name for f in schema.fields]]

    tiles = [f"_t{a}" for a in axes]
    return grid.of(df.select(*grid.coords, *columns, *tiles).groupBy(*keys, *tiles).applyInPandas(run, schema))


def _shifted(a: np.ndarray, offset: Sequence[int]) -> np.ndarray:
    """a at each place plus offset (axes in array order), wrapping; halos absorb what wraps."""
    return np.roll(a, [-o for o in offset], axis=range(a.ndim))


def nonlocal_means(grid: Grid, column: str = "v", patch: int = 2, search: int = 4, variance: float = 10.0, out: str = "v", tile: int = 32, whole: bool = False) -> Grid:
    """Mean over the search cube, weighted by exp(-squared difference of patches / variance).

    Patches and searches are cubes of the given radii, from 1 to 8. whole: cut
    the fractions of values off first.
    """
    if not (1 <= patch <= 8 and 1 <= search <= 8):
        raise ValueError("radii go from 1 to 8")

    def solve(arrays: list[np.ndarray], _: list[tuple[int, int]]) -> list[np.ndarray]:
        v = np.trunc(arrays[0]) if whole else arrays[0]
        top, bottom = np.zeros_like(v), np.zeros_like(v)
        for o in np.ndindex(*[2 * search + 1] * v.ndim):
            other = _shifted(v, [k - search for k in o])
            d = (v - other) ** 2
            for axis in range(v.ndim):  # the sum over a cube, an axis at a time
                d = sum(np.roll(d, k, axis=axis) for k in range(-patch, patch + 1))
            w = np.exp(-d / variance)
            top += w * other
            bottom += w
        return [top / bottom]

    return map_tiles(grid, [column], patch + search, solve, [out], tile)


def _convolve(a: np.ndarray, taps: Sequence[float], axis: int) -> np.ndarray:
    r = len(taps) // 2
    return sum(w * np.roll(a, -k, axis=axis) for k, w in zip(range(-r, r + 1), taps, strict=True) if w)


def _sobel(a: np.ndarray) -> list[np.ndarray]:
    """Sobel derivatives along x, y (and z) of an array indexed by the axes in reverse."""
    out = []
    for d in reversed(range(a.ndim)):
        g = a
        for axis in range(a.ndim):
            g = _convolve(g, DERIVE if axis == d else SMOOTH, axis)
        out.append(g)
    return out


def _packed(dims: int) -> tuple[tuple[int, int], ...]:
    """Row and column of each component of a packed symmetric tensor."""
    return tuple((i, j) for i in range(dims) for j in range(i, dims))


def diffusion_tensor(tensor: np.ndarray, alpha: float, contrast: float) -> np.ndarray:
    """Packed diffusion tensors of packed structure tensors (rows of six in space, of three in the plane).

    All directions get alpha; the one of least change gets (1 - alpha) ·
    exp(-contrast / coherence) more, where the coherence, the sum of squared
    differences of eigenvalues, is not nearly 0.
    """
    dims = 3 if tensor.shape[1] == 6 else 2
    values, vectors = np.linalg.eigh(_full(tensor, dims))
    k = sum((values[:, i] - values[:, j]) ** 2 for i in range(dims) for j in range(i + 1, dims))
    new = np.full_like(values, alpha)
    strong = k >= 1e-8
    new[strong, 0] += (1 - alpha) * np.exp(-contrast / k[strong])
    full = np.einsum("nij,nj,nkj->nik", vectors, new, vectors)
    return np.stack([full[:, i, j] for i, j in _packed(dims)], axis=1)


def _full(packed: np.ndarray, dims: int) -> np.ndarray:
    full = np.empty((len(packed), dims, dims))
    for k, (i, j) in enumerate(_packed(dims)):
        full[:, i, j] = full[:, j, i] = packed[:, k]
    return full


def _hold(a: np.ndarray, pads: Sequence[tuple[int, int]]) -> np.ndarray:
    """a with the cells beyond the border of the grid set to the nearest inside."""
    inner = tuple(slice(b, n - e) for n, (b, e) in zip(a.shape, pads, strict=True))
    return np.pad(a[inner], list(pads), mode="edge")


def coherence_step(v: np.ndarray, pads: Sequence[tuple[int, int]], dt: float, alpha: float, contrast: float) -> np.ndarray:
    """One explicit step of coherence-enhancing diffusion on an array of two or three axes with ``pads`` cells beyond the border."""
    g = _sobel(v)
    tensor = []
    for i, j in _packed(v.ndim):
        t = _hold(g[i] * g[j], pads)
        for axis in range(v.ndim):
            t = _convolve(t, gaussian_kernel(2), axis)
        tensor.append(t)
    d = diffusion_tensor(np.stack([t.ravel() for t in tensor], axis=1), alpha, contrast)
    flux = np.einsum("nij,nj->ni", _full(d, v.ndim), np.stack([a.ravel() for a in g], axis=1))
    div = sum(_sobel(_hold(flux[:, i].reshape(v.shape), pads))[i] for i in range(v.ndim))
    return v + dt * div


def coherence_diffusion(grid: Grid, column: str = "v", steps: int = 1, dt: float = 0.05, alpha: float = 0.001, contrast: float = 15.0, out: str = "v", tile: int = 32, together: int = 1) -> Grid:
    """Coherence-enhancing diffusion of a plane or a volume, a fixed number of explicit steps.

    together: steps between two exchanges of tiles; halos grow with them.
    """
    from ..plans.storage import saved

    g = grid.map(**{out: F.col(column).cast("double")})

    def several(n: int):
        def solve(arrays: list[np.ndarray], pads: list[tuple[int, int]]) -> list[np.ndarray]:
            v = arrays[0]
            for _ in range(n):
                v = _hold(coherence_step(v, pads, dt, alpha, contrast), pads)
            return [v]

        return solve

    done = 0
    while done < steps:
        n = min(together, steps - done)
        g = map_tiles(g, [out], 6 * n, several(n), [out], tile)
        done += n
        if done < steps:
            g = g.of(saved(g.df, "diffusion"))
    return g
