"""Files and texts: round trips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.grid import empty_grid
from cellweave.operators.maxflow import max_flow
from cellweave.sources import generate as G
from cellweave.sources import lattice_file, tables, text


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_graph_text(spark):
    nodes, edges = text.parse_graph(lines(spark, "# note", "", "n;1;4;2.5", "e;1;2;3;0.25", "x;9", "n;2;1"))
    assert [tuple(r) for r in nodes.collect()] == [(1, 4, 2.5)] and [tuple(r) for r in edges.collect()] == [(1, 2, 3, 0.25)]
    again = text.parse_graph(text.graph_lines(nodes, edges))
    assert again[0].collect() == nodes.collect() and again[1].collect() == edges.collect()


def test_markers_labels_sizes(spark):
    m = text.parse_markers(lines(spark, "f 12", "b 7", "q 1", ""))
    assert sorted(map(tuple, m.collect())) == [("b", 7), ("f", 12)]
    assert [r.label for r in text.parse_labels(lines(spark, " 5 ", "x", "-3")).collect()] == [5, -3]
    assert text.parse_size("40x30x20") == (40, 30, 20)
    with pytest.raises(ValueError):
        text.parse_size("40")


def test_shapes(spark):
    rows = text.parse_shapes(lines(spark, "e[1,2,3] 4 100", "t[1,2,3][0,0,1] 2 9 50", "p[5,5,5][1,0,0] 6 2 70.5", "junk")).collect()
    got = {r.kind: (r.centre, r.direction, r.radius, r.extent, r.value) for r in rows}
    assert got["e"] == ([1, 2, 3], [0, 0, 1], 4, 0, 100) and got["t"] == ([1, 2, 3], [0, 0, 1], 2, 9, 50) and got["p"] == ([5, 5, 5], [1, 0, 0], 6, 2, 70.5)


def test_graphml(spark):
    v, e = G.layered_graph(spark, 2, 2, 1, 0)
    got = [r.value for r in text.graphml_lines(v, e).orderBy("part").collect()]
    assert got[0].startswith("<graphml>") and got[-1].endswith("</graphml>") and sum("<edge" in x for x in got) == 2 + 2 + 2


def test_lattice_file(spark, tmp_path):
    n = 4
    cap = np.full(n * n, 5)
    weak = cap.copy()
    weak[n : 2 * n] = 1  # arcs from the second row to the third
    top = np.where(np.arange(n * n) < n, 100, 0)
    x = lattice_file.Lattice((n, n, 1), top, top[::-1], [cap, cap, cap, weak], np.ones(n * n), 4, b"note", (1, 0))
    back = lattice_file.Lattice.unpack(x.pack())
    assert back.size == x.size and back.max_flow == 4 and back.metadata == b"note" and (back.neighbours[3] == weak).all()
    lattice_file.write_lattice(spark, x, f"file://{tmp_path}/a.mfi")
    v, e = lattice_file.read_lattices(spark, f"file://{tmp_path}/a.mfi")
    flow, _ = max_flow(v.drop("path"), e.drop("path"))
    assert flow == 4
    with pytest.raises(ValueError):
        lattice_file.Lattice.unpack(b"XXX")


def test_grid_files(spark, tmp_path):
    g = empty_grid(spark, (4, 3)).add(v=F.col("x") + 10 * F.col("y"))
    tables.write_grid(g, f"{tmp_path}/g")
    back = tables.read_grid(spark, f"{tmp_path}/g", (4, 3))
    assert back.df.exceptAll(g.df).isEmpty() and tables.probe(back.df) == {"type": "int", "components": 1, "dims": 2}
    with pytest.raises(ValueError):
        tables.probe(g.df.withColumn("v", F.array("v")))
