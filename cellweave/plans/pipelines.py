"""End-to-end chains of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cells as C
from ..grid import Grid
from ..operators import automata, filters, maxflow, reduce, tiles
from ..operators.stencil import moore
from ..sources.generate import lattice
from .storage import saved


def negative(rgb: Grid) -> Grid:
    return rgb.map(**{c: C.negate(F.col(c)) for c in rgb.values})


def edge_components(rgb: Grid, at: int = 80) -> Grid:
    """Negative, gray, gradient, threshold, components, colours: the chain of channels r, g, b."""
    gray = negative(rgb).map(v=C.grayscale(F.col("r"), F.col("g"), F.col("b")).cast("long"))
    edge = filters.backward_magnitude(gray, out="edge").of_without("v")
    labelled = automata.label_components(edge.add(on=C.threshold(F.col("edge"), at, 0, 1)), "on")
    c0, c1, c2 = C.colour(F.col("label"))
    return labelled.map(edge=F.col("edge"), c0=c0, c1=c1, c2=c2)


def region_graph(grid: Grid, column: str = "v") -> DataFrame:
    """Regions of the gradient's watershed and their graph: tag n or e, labels, counts and sums."""
    edge = filters.backward_magnitude(grid, column, "g")
    regions = automata.watershed_merged(edge, "g", moore(len(grid.axes)), complete=False)
    regions = regions.of(saved(reduce.dense_labels(regions.df), "regions"))
    nodes = reduce.region_nodes(regions, column="g").select(F.lit("n").alias("tag"), F.col("label").alias("l1"), F.lit(0).cast("long").alias("l2"), "n", F.col("s").cast("double").alias("s"))
    edges = reduce.region_edges(regions, column="g").select(F.lit("e").alias("tag"), "l1", "l2", "n", "s")
    return nodes.unionByName(edges).withColumn("s", F.round("s", 6))


def grid_segmentation(grid: Grid, column: str = "v", mask: str = "m", sigma: float = 1.0, strong: float = 1e6, border: bool = False) -> Grid:
    """Minimum cut of a grid between marked cells: side 1 is that of markers 255.

    Neighbours are joined with exp(-(difference)² / 2 · sigma²). border: cells at
    the border belong to the other side too.
    """
    edges = lattice(grid, column, lambda a, b: F.exp(-((a - b) * (a - b)) / 2.0 * F.lit(sigma * sigma)))
    rim = F.lit(False)
    for a in grid.axes:
        rim = rim | (F.col(a) <= 1) | (grid.extent(a) - F.col(a) <= 2)
    src = F.when((F.col(mask) == 128) | (rim & F.lit(border) & (F.col(mask) != 255)), F.lit(strong)).otherwise(F.lit(0.0))
    snk = F.when(F.col(mask) == 255, F.lit(strong)).otherwise(F.lit(0.0))
    vertices = grid.df.select(grid.index().alias("id"), src.alias("cap_src"), snk.alias("cap_snk"))
    _, segments = maxflow.max_flow(vertices, edges, least=1e-9)
    return grid.of(grid.df.withColumn("id", grid.index()).join(segments, "id").drop("id"))


def region_segmentation(grid: Grid, mask: Grid, column: str = "v", strong: float = 1e4) -> Grid:
    """Minimum cut of the region graph between marked regions: side 1 for cells of regions on the side of markers 255."""
    regions = automata.watershed_merged(grid, column, moore(len(grid.axes)), complete=False)
    regions = regions.of(saved(regions.df, "regions"))
    marks = reduce.markers(regions.map(label=F.col("label")), mask)
    edges = saved(reduce.region_edges(regions, column=column), "edges")
    ids = regions.df.select("label").distinct()
    f = marks.filter("kind = 'f'").select("label", F.lit(strong).alias("cap_snk"))
    b = marks.filter("kind = 'b'").select("label", F.lit(strong).alias("cap_src"))
    zero = F.lit(0.0)
    vertices = ids.join(f, "label", "left").join(b, "label", "left").select(F.col("label").alias("id"), F.coalesce("cap_src", zero).alias("cap_src"), F.coalesce("cap_snk", zero).alias("cap_snk"))
    graph = edges.select((F.col("l1") * (1 << 31) + F.col("l2")).alias("eid"), F.col("l1").alias("a"), F.col("l2").alias("b"), F.col("s").alias("w_fwd"), F.col("s").alias("w_bwd"))
    _, segments = maxflow.max_flow(vertices, graph)
    return regions.of(regions.df.join(segments.select(F.col("id").alias("label"), "side"), "label").select(*grid.axes, "label", "side"))


def minima_colours(gray: Grid, column: str = "v") -> Grid:
    """Regional minima of a gray image, and the colours of their labels."""
    found = automata.regional_minima(gray, column)
    c0, c1, c2 = C.colour(F.col("label"))
    return found.map(label=F.col("label"), c0=c0, c1=c1, c2=c2)


def diffuse_image(gray: Grid, column: str = "v", steps: int = 80, dt: float = 0.1, together: int = 8) -> Grid:
    """Coherence-enhancing diffusion of an image of bytes, and the bytes after it."""
    unit = gray.map(v=F.col(column) / 255.0)
    done = tiles.coherence_diffusion(unit, steps=steps, dt=dt, tile=128, together=together)
    return done.map(v=C.to_byte(F.col("v") * 255))


def image_watershed(rgb: Grid, method: str = "distance") -> Grid:
    """Sum of channels, gradient with negative values cut, watershed, colours of labels."""
    v = C.total(*(F.col(c) for c in rgb.values))
    edge = filters.backward_magnitude(rgb.map(v=v), out="g")
    cells = edge.map(v=C.lower_limit(F.col("g"), 0, 0))
    labelled = automata.watershed(cells, "v", method)
    c0, c1, c2 = C.colour(F.col("label"))
    return labelled.map(label=F.col("label"), c0=c0, c1=c1, c2=c2)


def reaction_image(rgb: Grid, steps: int) -> Grid:
    """Reaction and diffusion of the first and last channel, as bytes between the least and most concentration."""
    from ..operators.stencil import von_neumann

    u, w = C.reaction(F.col(rgb.values[0]), F.col(rgb.values[-1]))
    state = automata.Automaton(rgb.map(u=u, w=w), von_neumann(len(rgb.axes)), automata.reaction_diffusion()).iterate(steps)
    state = state.of(saved(state.df, "reaction"))
    low = state.df.agg(F.min("u"), F.max("u"), F.min("w"), F.max("w")).first()
    lit = [F.lit(x) for x in low]
    return state.map(c0=C.concentration_colour(F.col("u"), lit[0], lit[1]), c2=C.concentration_colour(F.col("w"), lit[2], lit[3]))


def edge_weights(edges: DataFrame, column: str = "w_fwd") -> DataFrame:
    """Least, most and mean weight of edges, one row."""
    return edges.agg(F.min(column).alias("least"), F.max(column).alias("most"), F.avg(column).alias("mean"))
