"""Minima and distances on packed tiles: a row a tile, and rounds that exchange only what lies between tiles.

Cells are dealt to tiles once, with a rim of one cell around, and packed. What
is settled inside a tile stays there; links of plateaus and distances that
cross a border between tiles are the only rows of later rounds, so what these
write and shuffle grows with the borders and not with the cells.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from ..grid import Grid, linear_index
from ..plans.fixpoint import NotStable, _close, components
from ..plans.storage import saved
from .stencil import Offset

#: Rows of a tile's group: its packed cells, a strip of cells from the tile ``other``, a strip sent to it, the label of a plateau.
CELLS, IN, OUT, LABEL = range(4)
#: Whether a place of a tile has no cell, a cell without a value or one with a value.
NOWHERE, NULL, VALUE = range(3)
#: Lists of at most so many tiles are sent to all tasks.
FEW = 100_000
PACKED = "tile long, kind int, other long, label long, changed boolean, data binary"


@dataclass(frozen=True)
class Layout:
    """Tiles of ``tile`` cells an axis over extents ``size``. Arrays have a rim of one place around and are indexed by the axes in reverse."""

    size: tuple[int, ...]
    tile: int

    @property
    def counts(self) -> tuple[int, ...]:
        return tuple((n - 1) // self.tile + 1 for n in self.size)

    @property
    def tiles(self) -> int:
        return int(np.prod(self.counts, dtype=np.int64))

    @property
    def single(self) -> bool:
        return self.tiles == 1

    def at(self, index: int) -> list[int]:
        """Coordinates of a tile."""
        out = []
        for n in self.counts:
            index, c = divmod(index, n)
            out.append(c)
        return out

    def corner(self, index: int) -> list[int]:
        return [c * self.tile for c in self.at(index)]

    def extents(self, index: int) -> list[int]:
        """Cells an axis, without the rim."""
        return [min(self.tile, n - c) for n, c in zip(self.size, self.corner(index), strict=True)]

    def around(self, index: int) -> Iterator[tuple[Offset, int]]:
        """Direction and index of the tiles around."""
        here = self.at(index)
        for o in product((-1, 0, 1), repeat=len(here)):
            there = [c + d for c, d in zip(here, o, strict=True)]
            if any(o) and all(0 <= c < n for c, n in zip(there, self.counts, strict=True)):
                k = 0
                for c, n in zip(reversed(there), reversed(self.counts), strict=True):
                    k = k * n + c
                yield o, k

    def ids(self, index: int) -> np.ndarray:
        """Linear index of each place."""
        out = np.zeros((), dtype=np.int64)
        for c, n, cells in reversed(list(zip(self.corner(index), self.size, self.extents(index), strict=True))):
            out = out[..., None] * n + (np.arange(cells + 2, dtype=np.int64) + c - 1)
        return out

    def inside(self, index: int) -> np.ndarray:
        """Whether each place is in the grid."""
        out = np.ones((), dtype=bool)
        for c, n, cells in reversed(list(zip(self.corner(index), self.size, self.extents(index), strict=True))):
            at = np.arange(cells + 2) + c - 1
            out = out[..., None] & (at >= 0) & (at < n)
        return out

    def strip(self, index: int, direction: Offset, rim: bool) -> tuple[slice, ...]:
        """The places of the rim, or the cells inside, on the side of a direction."""
        r = 0 if rim else 1
        sides = [slice(1, n + 1) if d == 0 else slice(r, r + 1) if d < 0 else slice(n + 1 - r, n + 2 - r) for d, n in zip(direction, self.extents(index), strict=True)]
        return tuple(reversed(sides))


def _pack(*arrays: np.ndarray) -> bytes:
    return zlib.compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 1)


def _unpack(data: bytes, shape: Sequence[int], *kinds: np.dtype) -> list[np.ndarray]:
    raw, out, start = zlib.decompress(data), [], 0
    n = int(np.prod(shape))
    for k in map(np.dtype, kinds):
        out.append(np.frombuffer(raw, k, n, start).reshape(shape).copy())
        start += n * k.itemsize
    return out


INSIDE = slice(1, -1)


def _inner(a: np.ndarray) -> np.ndarray:
    return a[(INSIDE,) * a.ndim]


def _beside(a: np.ndarray, o: Sequence[int]) -> np.ndarray:
    """For each cell inside, the place at an offset (in array order)."""
    return a[tuple(slice(1 + d, n - 1 + d) for d, n in zip(o, a.shape, strict=True))]


def _ranks(v: np.ndarray) -> np.ndarray:
    """Values that compare as in SQL: NaN equals itself and is above all."""
    return v if v.dtype.kind == "i" else np.unique(v, return_inverse=True)[1].reshape(v.shape)


class Plateaus:
    """Plateaus of one tile, its cells being linked with all around: the place of the first cell of each, whether it has a lower cell beside it, and its links across the border."""

    def __init__(self, v: np.ndarray, state: np.ndarray, ids: np.ndarray):
        key, there = _ranks(v), state == VALUE
        k, ok = _inner(key), _inner(there)
        self.ids = _inner(ids)
        at = np.full(v.shape, -1, dtype=np.int64)  # -1: rim
        _inner(at)[...] = np.arange(k.size).reshape(k.shape)
        here = _inner(at)
        lower = np.zeros(k.shape, dtype=bool)
        pairs, cross, touched = [], [], np.zeros(k.shape, dtype=bool)
        for o in product((-1, 0, 1), repeat=v.ndim):
            if not any(o):
                continue
            both = ok & _beside(there, o)
            other = _beside(key, o)
            lower |= both & (other < k)
            same, to = both & (other == k), _beside(at, o)
            if o > (0,) * v.ndim:
                inside = same & (to >= 0)
                pairs.append((here[inside], to[inside]))
            out = same & (to < 0)
            touched |= out
            if o > (0,) * v.ndim:
                cross.append((self.ids[out], _beside(ids, o)[out]))
        root = np.arange(k.size)
        a, b = (np.concatenate(p) for p in zip(*pairs, strict=True))
        if len(a):
            found, first = _close(a, b)
            root[found] = first
        self.first = root.reshape(k.shape)
        self.bad = np.bincount(root, weights=lower.ravel(), minlength=k.size) > 0
        self.bad |= ~ok.ravel()
        ends = self.first[touched]
        flat = self.ids.ravel()
        links = [*cross, (self.ids[touched], flat[ends])]
        self.a, self.b = (np.concatenate(p) for p in zip(*links, strict=True))
        self.crossing = np.unique(ends)

    def labels(self, known: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Linear index plus one of the first cell of each minimum, 0 elsewhere; ``label`` of the plateaus of first id ``known`` is given."""
        flat = self.ids.ravel()
        each = np.where(self.bad, 0, flat + 1)
        each[np.searchsorted(flat, known)] = label
        return each[self.first]


def relaxed(v: np.ndarray, seed: np.ndarray, rim: Sequence[np.ndarray], offsets: Sequence[Offset]) -> list[np.ndarray]:
    """Distances, hops and labels of a tile from its minima (``seed`` inside, 0 elsewhere) and the rim around, until they stand."""
    dist, hops, label = (a.copy() for a in rim)
    steps = [tuple(reversed(o)) for o in offsets[1:]]
    start = seed > 0
    for a, at in zip((dist, hops, label), (0.0, 0.0, seed), strict=True):
        _inner(a)[...] = np.where(start, at, 0.0 if a is label else np.inf)
    free, cost = ~start, _inner(v).astype(np.float64)
    for _ in range(v.size + 1):
        low = [np.full(free.shape, np.inf), np.full(free.shape, np.inf), np.zeros(free.shape)]
        for o in steps:
            d, h = _beside(dist, o) + cost, _beside(hops, o) + 1
            better = (d < low[0]) | ((d == low[0]) & (h < low[1]))
            for a, new in zip(low, (d, h, _beside(label, o)), strict=True):
                a[better] = new[better]
        moved = free & np.isfinite(low[0]) & ((low[0] != _inner(dist)) | (low[1] != _inner(hops)) | (low[2] != _inner(label)))
        if not moved.any():
            break
        for a, new in zip((dist, hops, label), low, strict=True):
            _inner(a)[moved] = new[moved]
    return [dist, hops, label]


@dataclass(frozen=True)
class Work:
    """What a task does with the rows of one tile."""

    plan: Layout
    kind: str
    axes: tuple[str, ...]
    fill: float | None = None

    def dealt(self, pdf: pd.DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
        """Tile, values and states of dealt cells."""
        index, full = int(pdf["tile"].iloc[0]), (self.plan.tile + 2,) * len(self.axes)
        crop = tuple(slice(0, n + 2) for n in reversed(self.plan.extents(index)))
        v, state = np.zeros(full, dtype=self.kind), np.full(full, NOWHERE, dtype=np.uint8)
        pdf = pdf[pdf["at"] >= 0]
        at = pdf["at"].to_numpy()
        v.ravel()[at] = pdf["v"].to_numpy()
        state.ravel()[at] = np.where(pdf["gone"].to_numpy(), NULL, VALUE)
        v, state = v[crop].copy(), state[crop].copy()
        if self.fill is not None:
            missing = (state != VALUE) & self.plan.inside(index)
            v[missing], state[missing] = self.fill, VALUE
        return index, v, state

    def shape(self, index: int) -> list[int]:
        return [n + 2 for n in reversed(self.plan.extents(index))]

    def opened(self, pdf: pd.DataFrame) -> tuple[int, list[np.ndarray], list[np.ndarray]]:
        """Tile; its values, states and labels; and its rim, of the strips that came in."""
        index = int(pdf["tile"].iloc[0])
        held = _unpack(pdf.loc[pdf["kind"] == CELLS, "data"].iloc[0], self.shape(index), self.kind, "u1", "i8")
        rim, came = self.empty_rim(index), pdf[pdf["kind"] == IN]
        strips = dict(zip(came["other"], came["data"], strict=True))
        for o, k in self.plan.around(index):
            if k in strips:
                at = self.plan.strip(index, o, True)
                for a, s in zip(rim, _unpack(strips[k], rim[0][at].shape, "f8", "f8", "f8"), strict=True):
                    a[at] = s
        return index, held, rim

    def empty_rim(self, index: int) -> list[np.ndarray]:
        """Distances, hops and labels where nothing comes in."""
        shape = self.shape(index)
        return [np.full(shape, np.inf), np.full(shape, np.inf), np.zeros(shape)]

    def solved(self, held: list[np.ndarray], rim: list[np.ndarray], offsets: Sequence[Offset]) -> list[np.ndarray]:
        v, state, seed = held
        return relaxed(np.where(state == VALUE, v, np.nan), _inner(seed), rim, offsets)

    def cells(self, index: int, v: np.ndarray, state: np.ndarray, **made: np.ndarray) -> pd.DataFrame:
        """A row a cell, with arrays ``made`` over the cells inside."""
        there = _inner(state) != NOWHERE
        places = reversed(np.nonzero(there))
        found = {a: (p + c).astype(np.int32) for a, p, c in zip(self.axes, places, self.plan.corner(index), strict=True)}
        found |= {"_v": _inner(v)[there], "_gone": _inner(state)[there] == NULL}
        return pd.DataFrame(found | {n: m[there] for n, m in made.items()})

    def schema(self, made: str) -> str:
        return f"{', '.join(f'{a} int' for a in self.axes)}, _v {'long' if self.kind == 'int64' else 'double'}, _gone boolean, {made}"


class Tiles:
    """A column of a grid as packed tiles. Integers and floats are held as they are, other types as doubles. For frames of one grid.

    fill: the value of cells without a row or a value, for grids of this one
    column; so a sparse table need not be joined to all cells first.
    """

    def __init__(self, grid: Grid, column: str, tile: int | None = None, fill: float | None = None):
        self.grid, self.column = grid, column
        self.plan = Layout(grid.size, tile or (128 if len(grid.axes) == 2 else 32))
        self.types = {f.name: f.dataType for f in grid.df.schema}
        name = self.types[column].typeName()
        kind = "int64" if name in ("byte", "short", "integer", "long") else "float64"
        self.exact = kind == "int64" or name in ("float", "double")
        if fill is not None and not (self.exact and set(grid.values) == {column}):
            raise ValueError("only grids of one column of numbers are filled")
        self.work = Work(self.plan, kind, grid.axes, fill)

    def _groups(self, df: DataFrame) -> GroupedData:
        """Groups by tile, a task for every 16 tiles: packed rows are few bytes and much work, so tasks go by their number and not by their size."""
        return df.repartition(min(2000, (self.plan.tiles + 15) // 16), "tile").groupBy("tile")

    def _dealt(self) -> GroupedData:
        """(tile, at, v, gone): cells with copies for the rims of the tiles around; and a row at -1 of each tile, so that none is missing."""
        g, plan, v = self.grid, self.plan, F.col(self.column)
        df = g.df.select(*g.axes, v.cast("long" if self.work.kind == "int64" else "double").alias("_v"), v.isNull().alias("gone"))
        df = df.filter(reduce(and_, (F.col(a).between(0, n - 1) for a, n in zip(g.axes, g.size, strict=True))))
        for a, n in zip(g.axes, plan.counts, strict=True):
            low = F.greatest(F.lit(0), F.floor((F.col(a) - 1) / plan.tile)).cast("int")
            high = F.least(F.lit(n - 1), F.floor((F.col(a) + 1) / plan.tile)).cast("int")
            df = df.withColumn(f"_t{a}", F.explode(F.sequence(low, high)))
        tile = linear_index([F.col(f"_t{a}") for a in g.axes], plan.counts)
        at = linear_index([F.col(a) - F.col(f"_t{a}") * plan.tile + 1 for a in g.axes], (plan.tile + 2,) * len(g.axes))
        cells = df.select(tile.alias("tile"), at.cast("int").alias("at"), F.coalesce("_v", F.lit(0)).alias("v"), "gone")
        each = df.sparkSession.range(0, plan.tiles, 1, plan.tiles // 100_000 + 1)
        return self._groups(cells.unionByName(each.select(F.col("id").alias("tile"), F.lit(-1).alias("at"), F.lit(0).cast(cells.schema["v"].dataType).alias("v"), F.lit(True).alias("gone"))))

    def _whole(self, df: DataFrame, names: Sequence[str]) -> Grid:
        """The grid with columns of ``df`` added."""
        g, types = self.grid, self.types
        if set(g.values) == {self.column} and self.exact:  # all there is to a cell is in its tile
            v = F.col("_v") if self.work.kind == "int64" else F.coalesce("_v", F.lit(float("nan")))  # pandas hands NaN back as null
            v = F.when(~F.col("_gone"), v.cast(types[self.column])).alias(self.column)
            return g.of(df.select(*(v if c == self.column else F.col(c).cast(types[c]).alias(c) for c in g.df.columns), *names))
        return g.of(g.df.join(df.select(*g.axes, *names), list(g.axes)))

    def seeded(self) -> DataFrame:
        """PACKED rows of all tiles: values, states and labels of regional minima."""
        work, plan = self.work, self.plan

        def pack(pdf: pd.DataFrame) -> pd.DataFrame:
            index, v, state = work.dealt(pdf)
            p = Plateaus(v, state, plan.ids(index))
            return pd.DataFrame({"tile": [index], "data": [_pack(v, state)], "a": [p.a], "b": [p.b], "first": [p.ids.ravel()[p.crossing]], "bad": [p.bad[p.crossing]]})

        packed = saved(self._dealt().applyInPandas(pack, "tile long, data binary, a array<long>, b array<long>, first array<long>, bad array<boolean>"), "tiles")
        links = packed.select(F.explode(F.arrays_zip("a", "b")).alias("p")).select("p.a", "p.b")
        ends = packed.select("tile", F.explode(F.arrays_zip("first", "bad")).alias("p")).select("tile", F.col("p.first").alias("id"), "p.bad")
        ends = saved(ends.join(components(links), "id"), "ends")
        bad = ends.groupBy("root").agg(F.max("bad").alias("bad"))
        named = ends.drop("bad").join(bad, "root").select("tile", F.col("id").alias("other"), F.when(~F.col("bad"), F.col("root") + 1).otherwise(F.lit(0)).alias("label"))
        rows = _rows(packed, CELLS, "tile", data="data").unionByName(_rows(named, LABEL, "tile", other="other", label="label"))

        def seed(pdf: pd.DataFrame) -> pd.DataFrame:
            index = int(pdf["tile"].iloc[0])
            v, state = _unpack(pdf.loc[pdf["kind"] == CELLS, "data"].iloc[0], work.shape(index), work.kind, "u1")
            given = pdf[pdf["kind"] == LABEL]
            label = Plateaus(v, state, plan.ids(index)).labels(given["other"].to_numpy(), given["label"].to_numpy())
            return _frame(index, CELLS, [(-1, False, _pack(v, state, np.pad(label, 1)))])

        return self._groups(rows).applyInPandas(seed, PACKED)

    def minima(self, out: str) -> Grid:
        """The grid with labels of regional minima."""
        work = self.work

        def alone(pdf: pd.DataFrame) -> pd.DataFrame:
            index, v, state = work.dealt(pdf)
            return work.cells(index, v, state, _out=_alone(v, state, work.plan.ids(index)))

        def cells(pdf: pd.DataFrame) -> pd.DataFrame:
            index, (v, state, label), _ = work.opened(pdf)
            return work.cells(index, v, state, _out=_inner(label))

        schema = work.schema("_out long")
        df = self._dealt().applyInPandas(alone, schema) if self.plan.single else self._groups(self.seeded()).applyInPandas(cells, schema)
        return self._whole(df.select("*", F.col("_out").alias(out)), [out])

    def distances(self, offsets: Sequence[Offset], limit: int) -> Grid:
        """The grid with distances and labels of ``watershed_distance``."""
        work, plan = self.work, self.plan

        def finished(index: int, held: list[np.ndarray], rim: list[np.ndarray]) -> pd.DataFrame:
            d, _, label = (_inner(a) for a in work.solved(held, rim, offsets))
            return work.cells(index, held[0], held[1], _d=d, _l=label)

        def alone(pdf: pd.DataFrame) -> pd.DataFrame:
            index, v, state = work.dealt(pdf)
            return finished(index, [v, state, np.pad(_alone(v, state, plan.ids(index)), 1)], work.empty_rim(index))

        def last(pdf: pd.DataFrame) -> pd.DataFrame:
            return finished(*work.opened(pdf))

        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            """Strips that a tile sends; it is solved again only if a strip that came in is new."""
            index, before = int(pdf["tile"].iloc[0]), pdf[pdf["kind"] == OUT]
            if not pdf["changed"].any():
                return _frame(before["other"], IN, [(index, False, d) for d in before["data"]])
            _, held, rim = work.opened(pdf)
            done, sent = work.solved(held, rim, offsets), dict(zip(before["other"], before["data"], strict=True))
            out, to = [], []
            for o, k in plan.around(index):
                strip = [a[plan.strip(index, o, False)] for a in done]
                if np.isfinite(strip[0]).any():
                    data = _pack(*strip)
                    to.append(k)
                    out.append((index, k not in sent or zlib.decompress(sent[k]) != zlib.decompress(data), data))
            return _frame(to, IN, out)

        schema = work.schema("_d double, _l double")
        if plan.single:
            df = self._dealt().applyInPandas(alone, schema)
        else:
            df = self._groups(self._rounds(saved(self.seeded(), "seeds"), step, limit)).applyInPandas(last, schema)
        far = F.lit(float("inf"))
        return self._whole(df.select("*", F.when(F.col("_d") < far, F.col("_d")).alias("distance"), F.col("_l").cast("long").alias("label")), ["distance", "label"])

    def _rounds(self, tiles: DataFrame, step: Callable[[pd.DataFrame], pd.DataFrame], limit: int) -> DataFrame:
        """Tiles with the strips that come in, once none of these is new.

        While many tiles have a new strip, all are grouped; then only those, whose
        list goes to all tasks.
        """
        rows, rest = tiles.withColumn("changed", F.lit(True)), None  # all are solved at first
        for _ in range(limit):
            sent = self._groups(rows).applyInPandas(step, PACKED)
            strips = saved(sent if rest is None else sent.unionByName(rest), "strips")
            active = strips.filter("changed").select("tile").distinct()
            n = active.count()
            if not n:
                return tiles.unionByName(strips)
            cells, before, rest = tiles, _rows(strips, OUT, "other", other="tile", data="data"), None
            came = strips
            if n <= FEW:
                active = F.broadcast(active)
                rest = strips.join(active.withColumnRenamed("tile", "other"), "other", "left_anti").withColumn("changed", F.lit(False))
                cells, came, before = (d.join(active, "tile", "left_semi") for d in (cells, came, before))
            rows = cells.unionByName(came).unionByName(before)
        raise NotStable(f"not stable after {limit} rounds")


def _alone(v: np.ndarray, state: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Labels of the minima of a tile that has none around."""
    none = np.zeros(0, dtype=np.int64)
    return Plateaus(v, state, ids).labels(none, none)


def _rows(df: DataFrame, kind: int, tile: str, **columns: str) -> DataFrame:
    """Rows of PACKED."""
    none = {"other": F.lit(-1).cast("long"), "label": F.lit(0).cast("long"), "changed": F.lit(False), "data": F.lit(None).cast("binary")}
    return df.select(F.col(tile).alias("tile"), F.lit(kind).alias("kind"), *(F.col(columns[n]).alias(n) if n in columns else c.alias(n) for n, c in none.items()))


def _frame(tile, kind: int, rows: list[tuple[int, bool, bytes]]) -> pd.DataFrame:
    other, changed, data = zip(*rows, strict=True) if rows else ((), (), ())
    tiles = np.full(len(rows), tile, dtype=np.int64) if isinstance(tile, int) else np.asarray(tile, dtype=np.int64)
    return pd.DataFrame({"tile": tiles, "kind": np.full(len(rows), kind, dtype=np.int32), "other": np.asarray(other, dtype=np.int64), "label": np.zeros(len(rows), dtype=np.int64), "changed": np.asarray(changed, dtype=bool), "data": np.asarray(data, dtype=object)})


__all__ = ["Layout", "Plateaus", "Tiles", "relaxed"]
