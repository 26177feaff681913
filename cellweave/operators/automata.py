"""Cellular automata, component labelling and watersheds.

Rules that only spread information (labels, minima, steepest descent) are
solved as graphs, with hooking and pointer doubling, so rounds grow with the
logarithm of a path and not with its length. Rules that are true time steps
are iterated; each step is a stencil.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..grid import Grid
from ..plans.fixpoint import SMALL, components, iterate, roots, until_stable
from ..plans.storage import saved
from .blocks import Tiles
from .filters import has_smaller, local_minima, lower_completion
from .stencil import Offset, moore, neighbours, total, von_neumann


class Automaton:
    """A synchronous automaton: each step maps the neighbourhoods of all cells at once.

    rule: function of {column: array of its neighbours, the centre first} that
    returns the new value columns.
    """

    def __init__(self, grid: Grid, offsets: list[Offset], rule: Callable[[dict[str, Column]], dict[str, Column]], border: str = "repeat"):
        self.grid, self.offsets, self.rule, self.border = grid, offsets, rule, border

    def step(self, df: DataFrame, watched: Sequence[str] = ()) -> DataFrame:
        """The next state; with ``watched`` also _changed: whether one of these columns is new."""
        g = self.grid.of(df)
        names = g.values
        for n in names:
            g = neighbours(g, n, self.offsets, self.border, out=f"n_{n}")
        new = self.rule({n: F.col(f"n_{n}") for n in names})
        if watched:
            changed = F.lit(False)
            for c in watched:
                changed = changed | (~new[c].eqNullSafe(F.col(f"n_{c}")[0]) if c in new else F.lit(False))
            new = new | {"_changed": changed}
        return g.add(**new).of_without(*(f"n_{n}" for n in names)).df

    def iterate(self, n: int) -> Grid:
        """The state after ``n`` steps."""
        return self.grid.of(iterate(self.grid.df, self.step, n))

    def until_stable(self, columns: Sequence[str], limit: int = 1000) -> Grid:
        """The first state that a step leaves as it is, in ``columns``; the first offset has to be the centre."""
        if any(self.offsets[0]):
            raise ValueError("the first offset is not the centre")
        start = self.grid.df.withColumn("_changed", F.lit(True))
        done = until_stable(start, lambda df: self.step(df.drop("_changed"), columns), F.col("_changed"), limit)
        return self.grid.of(done.drop("_changed"))


def conway(n: dict[str, Column]) -> dict[str, Column]:
    """Life: three neighbours give life, two keep it."""
    around = F.aggregate(n["v"], F.lit(0), lambda a, v: a + v.cast("int")) - n["v"][0]
    return {"v": F.when((around == 3) | ((around == 2) & (n["v"][0] == 1)), 1).otherwise(0)}


def reaction_diffusion(alpha: float = 0.1, beta: float = 0.1, k: tuple[float, float] = (0.64, 0.32), dt: float = 0.2):
    """Two concentrations u, w that spread, and react by u·w²."""

    def rule(n: dict[str, Column]) -> dict[str, Column]:
        u, w = n["u"][0], n["w"][0]
        cells = F.size(n["u"])
        du = F.lit(k[0]) * (total(n["u"]) - cells * u) + F.lit(alpha) * u - u * w * w
        dw = F.lit(k[1]) * (total(n["w"]) - cells * w) + u * w * w - F.lit(beta) * w
        return {"u": u + F.lit(dt) * du, "w": w + F.lit(dt) * dw}

    return rule


def _links(grid: Grid, offsets: list[Offset], keep: Callable[[Column, Column], Column], column: str) -> DataFrame:
    """(a, b): linear ids of neighbouring cells whose values fulfil ``keep``; each pair once."""
    half = [o for o in offsets if tuple(reversed(o)) > (0,) * len(o)]
    g = grid.add(_id=grid.index())
    g = neighbours(neighbours(g, "_id", half, "none", out="_ids"), column, half, "none", out="_vs")
    pairs = g.df.select(F.col("_id").alias("a"), F.col(column).alias("_v"), F.explode(F.arrays_zip(F.col("_ids").alias("b"), F.col("_vs").alias("w"))).alias("p"))
    return pairs.filter(F.col("p.b").isNotNull() & keep(F.col("_v"), F.col("p.w"))).select("a", F.col("p.b").alias("b"))


def label_components(grid: Grid, column: str = "v", offsets: list[Offset] | None = None, same: bool = False, out: str = "label", small: int = SMALL) -> Grid:
    """Connected components of foreground cells: the smallest linear index plus one of each, 0 for background.

    offsets: the neighbourhood (all cells around). same: only cells of equal
    value are connected. small: lists of at most so many links are closed in
    one task. For frames of one grid.
    """
    offsets = offsets or moore(len(grid.axes))

    def keep(a: Column, b: Column) -> Column:
        return (a != 0) & (b != 0) & ((a == b) if same else F.lit(True))

    found = components(_links(grid, offsets, keep, column), small=small)
    df = grid.df.withColumn("id", grid.index()).join(found, "id", "left")
    return grid.of(df.withColumn(out, F.when(F.col(column) != 0, F.coalesce("root", "id") + 1).otherwise(F.lit(0))).drop("id", "root"))


def regional_minima(grid: Grid, column: str = "v", out: str = "label", tile: int | None = None) -> Grid:
    """Plateaus without a lower cell beside them, labelled by their smallest linear index plus one; 0 elsewhere."""
    return Tiles(grid, column, tile).minima(out)


def watershed_distance(grid: Grid, column: str = "v", offsets: list[Offset] | None = None, limit: int = 10000, tile: int | None = None, fill: float | None = None) -> Grid:
    """Label and distance of the nearest regional minimum, where entering a cell costs its value, which is not below 0.

    Of paths of equal distance the one of fewest cells counts, and of equal ones
    that which comes from the first neighbour in the order of offsets: so it is
    in synchronous steps in which a cell only changes for a smaller distance.
    Tiles are solved on their own from the cells around them, until none
    changes; rounds grow with the tiles that a path crosses, not with its cells,
    and exchange packed tiles and the cells on their borders. fill: the value of
    cells without a row or a value, in a grid of this one column.
    """
    return Tiles(grid, column, tile, fill).distances(offsets or von_neumann(len(grid.axes)), limit)


def _descent(grid: Grid, column: str, offsets: list[Offset], out: str) -> Grid:
    """Linear id of the neighbour that is smallest and not above the cell, the last of equals; null if none."""
    g = grid.add(_id=grid.index())
    g = neighbours(neighbours(g, "_id", offsets[1:], "none", out="_ids"), column, offsets[1:], "none", out="_vs")
    ranked = F.transform(F.sequence(F.lit(0), F.lit(len(offsets) - 2)), lambda i: F.struct(F.get("_vs", i).alias("v"), (-i).alias("k"), F.get("_ids", i).alias("id")))
    best = F.array_min(F.filter(ranked, lambda s: s["v"].isNotNull() & (s["v"] <= F.col(column))))
    return g.add(**{out: best["id"]}).of_without("_id", "_ids", "_vs")


def lower_pointers(grid: Grid, column: str = "v", out: str = "pointer") -> Grid:
    """Minus the linear index plus one of the smallest strictly lower cell around, the first of equals; 0 where there is none."""
    offsets = moore(len(grid.axes))
    g = grid.add(_id=grid.index())
    g = neighbours(neighbours(g, "_id", offsets[1:], out="_ids"), column, offsets[1:], out="_vs")
    each = F.transform(F.sequence(F.lit(0), F.lit(len(offsets) - 2)), lambda i: F.struct(F.get("_vs", i).alias("v"), i.alias("k"), F.get("_ids", i).alias("id")))
    best = F.array_min(F.filter(each, lambda s: s["v"] < F.col(column)))
    return g.add(**{out: F.coalesce(-(best["id"] + 1), F.lit(0))}).of_without("_id", "_ids", "_vs")


def watershed_pointers(grid: Grid, column: str = "v", offsets: list[Offset] | None = None, complete: bool = True) -> Grid:
    """Steepest descent by pointers: cells of regional minima keep their label, others follow to the end.

    complete: raise the rims of plateaus first. Pointers that meet in a cycle
    on a plateau get label 0.
    """
    offsets = offsets or von_neumann(len(grid.axes))
    base = lower_completion(grid, column, column) if complete else grid
    seeds = regional_minima(base, column)
    pointed = _descent(seeds, column, offsets, "_to")
    df = saved(pointed.df.withColumn("id", grid.index()), "pointers")
    chains = df.select("id", F.when(F.col("label") > 0, F.col("id")).otherwise(F.coalesce("_to", "id")).alias("parent"))
    cells = 1
    for n in grid.size:
        cells *= n
    state = chains.select("id", F.col("parent").alias("root"))
    for _ in range(cells.bit_length()):  # after so many doublings a chain without cycle has ended
        far = state.select(F.col("id").alias("root"), F.col("root").alias("far"))
        state = saved(state.join(far, "root").select("id", F.col("far").alias("root")), "doubled")
    ends = df.select(F.col("id").alias("root"), F.col("label").alias("_end"))
    named = state.join(ends, "root").select("id", "_end")
    return grid.of(df.join(named, "id").withColumn("label", F.col("_end").cast("long")).drop("id", "_to", "_end"))


def watershed_merged(grid: Grid, column: str = "v", offsets: list[Offset] | None = None, complete: bool = True) -> Grid:
    """Steepest descent with merging: every cell and the neighbour it descends to are one region, labelled by its smallest id plus one."""
    offsets = offsets or von_neumann(len(grid.axes))
    base = lower_completion(grid, column, column) if complete else grid
    pointed = _descent(base, column, offsets, "_to").df.withColumn("id", grid.index())
    found = components(pointed.select(F.col("id").alias("a"), F.col("_to").alias("b")).filter("b IS NOT NULL"))
    return grid.of(pointed.join(found, "id", "left").withColumn("label", F.coalesce("root", "id") + 1).drop("id", "root", "_to"))


def watershed_smaller(grid: Grid, column: str = "v", offsets: list[Offset] | None = None, complete: bool = True) -> Grid:
    """Merging with neighbours that are not above the cell and have a smaller label, from unique labels.

    Of these the smallest is taken, the last of equals; rounds run until no cell has one.
    """
    offsets = offsets or moore(len(grid.axes))
    base = lower_completion(grid, column, column) if complete else grid
    state = saved(base.add(label=(grid.index() + 1).cast("long")).df, "smaller")
    while True:
        g = neighbours(neighbours(grid.of(state), "label", offsets[1:], "none", out="_ls"), column, offsets[1:], "none", out="_vs")
        ranked = F.transform(F.sequence(F.lit(0), F.lit(len(offsets) - 2)), lambda i: F.struct(F.get("_vs", i).alias("v"), (-i).alias("k"), F.get("_ls", i).alias("l")))
        best = F.array_min(F.filter(ranked, lambda s: (s["v"] <= F.col(column)) & (s["l"] < F.col("label"))))
        links = saved(g.df.select(F.col("label").alias("a"), best["l"].alias("b")).filter("b IS NOT NULL"), "links")
        if links.isEmpty():
            return grid.of(state)
        state = saved(relabel(state, components(links)), "smaller")


def watershed_plateaus(grid: Grid, column: str = "v", offsets: list[Offset] | None = None) -> Grid:
    """As ``watershed_merged``, with plateaus told apart: a cell joins its smallest strictly lower neighbour (first of equals), a cell without one its plateau neighbours that have none either."""
    offsets = offsets or moore(len(grid.axes))
    g = has_smaller(grid, column, "_lower").add(_id=grid.index())
    for name in ("_id", column, "_lower"):
        g = neighbours(g, name, offsets[1:], "none", out=f"_n{name}")
    n = len(offsets) - 2
    each = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.struct(F.get(f"_n{column}", i).alias("v"), i.alias("k"), F.get("_n_id", i).alias("id"), F.get("_n_lower", i).alias("low")))
    df = g.df.withColumn("_e", F.filter(each, lambda s: s["v"].isNotNull()))
    below = F.array_min(F.filter("_e", lambda s: s["v"] < F.col(column)))
    flat = F.transform(F.filter("_e", lambda s: (s["v"] == F.col(column)) & (s["low"] == 0)), lambda s: s["id"])
    to = F.when(F.col("_lower") == 1, F.array(below["id"])).otherwise(flat)
    edges = df.select(F.col("_id").alias("a"), F.explode(to).alias("b"))
    found = components(edges)
    joined = grid.df.withColumn("id", grid.index()).join(found, "id", "left")
    return grid.of(joined.withColumn("label", F.coalesce("root", "id") + 1).drop("id", "root"))


def watershed_simple(grid: Grid, column: str = "v", offsets: list[Offset] | None = None) -> tuple[Grid, bool]:
    """Every cell takes the label of the neighbour it descends to, step by step, from unique labels.

    Plateaus can make labels swing for ever: returns the state and whether it
    is stable. Steps are doubled until that moves no label, or there were as
    many as cells: then only swinging labels are not at the end of their descent.
    """
    offsets = offsets or von_neumann(len(grid.axes))
    base = lower_completion(grid, column, column)
    fixed = saved(_descent(base, column, offsets, "_to").df.withColumn("id", grid.index()), "descent")
    cells = 1
    for n in grid.size:
        cells *= n
    one = fixed.select("id", F.coalesce("_to", "id").alias("root"))
    state = one
    for _ in range(cells.bit_length()):
        far = state.select(F.col("id").alias("root"), F.col("root").alias("far"))
        state = saved(state.join(far, "root").select("id", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved")), "simple")
        if state.filter("moved").isEmpty():
            break
        state = state.drop("moved")
    ahead = one.select(F.col("id").alias("root"), F.col("root").alias("far"))
    stable = state.join(ahead, "root").filter("far != root").isEmpty()
    named = state.select("id", (F.col("root") + 1).alias("label"))
    return grid.of(fixed.drop("_to").join(named, "id").drop("id")), stable


def merge_labels(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Equivalence closure of pairs of labels: (id, root), the smallest label of each class."""
    return components(pairs, a, b)


def relabel(labels: DataFrame, table: DataFrame, column: str = "label") -> DataFrame:
    """Labels replaced by their root; labels without one stay."""
    t = table.select(F.col("id").alias(column), "root")
    return labels.join(t, column, "left").withColumn(column, F.coalesce("root", column)).drop("root")


def _simple(grid: Grid, *args, **kwargs) -> Grid:
    found, stable = watershed_simple(grid, *args, **kwargs)
    return found.add(stable=F.lit(stable))


#: Methods of watershed by name.
WATERSHEDS = {
    "distance": watershed_distance,
    "distance_async": lambda *args: watershed_distance(*args, tile=16),
    "descent_pointer": watershed_pointers,
    "descent_gs": watershed_merged,
    "descent_smaller": watershed_smaller,
    "plateaus": watershed_plateaus,
    "descent_simple": _simple,
}


def watershed(grid: Grid, column: str = "v", method: str = "distance", offsets: list[Offset] | None = None) -> Grid:
    """Watershed labels in a column ``label``, by the method named.

    offsets: the neighbourhood (all cells around).
    descent_simple adds a column ``stable``: false in every cell if any label swings for ever.
    """
    if method not in WATERSHEDS:
        raise ValueError(f"no watershed method {method}; there are {', '.join(WATERSHEDS)}")
    return WATERSHEDS[method](grid, column, offsets or moore(len(grid.axes)))


__all__ = ["Automaton", "conway", "label_components", "local_minima", "merge_labels", "reaction_diffusion", "regional_minima", "relabel", "roots", "watershed"]
