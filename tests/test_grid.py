"""Grids, stencils and generators, against fixed values and NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions import vectors as V
from cellweave.grid import empty_grid
from cellweave.operators import filters, reduce, stencil
from cellweave.sources import generate as G


def array(grid, column="v"):
    out = np.zeros(tuple(reversed(grid.size)))
    for r in grid.df.collect():
        out[tuple(r[a] for a in reversed(grid.axes))] = r[column]
    return out


def noise(spark, size, mod=23):
    g = empty_grid(spark, size)
    v = F.lit(0)
    for a, k in zip(g.axes, (31, 17, 7), strict=False):
        v = v + F.col(a) * F.col(a) * k + F.col(a) * 5
    return g.add(v=v % mod)


def test_offset_tables():
    assert stencil.von_neumann(2) == [(0, 0), (-1, 0), (0, -1), (1, 0), (0, 1)]
    assert stencil.von_neumann(3)[1:4] == [(-1, 0, 0), (0, -1, 0), (0, 0, -1)]
    m = stencil.moore(3)
    assert len(m) == 27 and m[0] == (0, 0, 0) and m[1] == (-1, -1, -1) and m[26] == (1, 1, 1)
    assert all(tuple(-c for c in o) in m[14:] for o in m[1:14])


def test_checkerboard_and_constant(spark):
    assert G.checkerboard(spark, 1, 0, (2, 2), (16, 16)).df.agg(F.sum("v")).first()[0] == 128
    assert G.constant(spark, 3.0, (8, 8, 4)).df.agg(F.sum("v")).first()[0] == 3 * 256


def test_blocked_index(spark):
    g = empty_grid(spark, (5, 5, 5))
    x, y, z = (F.col(c) for c in "xyz")
    rows = {(r.x, r.y, r.z): (r.b, r.c) for r in g.add(b=V.blocked_index(x, y, z, g.size, 2), c=V.blocked_index(x, y, z, g.size, 3)).df.collect()}
    two = [(0, 0, 0), (1, 1, 1), (1, 1, 3), (2, 0, 0), (2, 2, 0), (2, 2, 2), (4, 4, 4)]
    assert [rows[k][0] for k in two] == [0, 7, 57, 8, 28, 78, 124]
    assert [rows[k][1] for k in [(0, 0, 0), (2, 2, 2), (4, 4, 4)]] == [0, 26, 124]
    assert sorted(v[0] for v in rows.values()) == list(range(125))


@pytest.mark.parametrize("size", [(6, 5), (4, 3, 5), (1, 4)])
@pytest.mark.parametrize("border", stencil.BORDERS)
def test_strategies_agree(spark, size, border):
    g = noise(spark, size)
    offsets = stencil.moore(len(size)) if min(size) > 1 else stencil.von_neumann(len(size))[:1]
    a = stencil.neighbours(g, "v", offsets, border).df.select(*g.axes, F.to_json("n").alias("n"))
    b = stencil.neighbours(g, "v", offsets, border, "gather").df.select(*g.axes, F.to_json("n").alias("n"))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_shifted_sum_clamped(spark):
    g = G.unique_ids(spark, (6, 5, 4))
    n = stencil.neighbours(g, "v", [(-1, -1, -1), (1, 1, 1)])
    v = np.pad(array(g), 1, mode="edge")
    assert (array(n.map(v=F.col("n")[0] + F.col("n")[1])) == v[:-2, :-2, :-2] + v[2:, 2:, 2:]).all()


def test_bordered_subview_reads_outside(spark):
    g = G.unique_ids(spark, (20, 20))
    read = stencil.bordered_subview(g, (4, 4), (16, 16), "v", [(-4, -4)])
    assert (array(read.map(v=F.col("n")[0])) == array(stencil.subview(g, (0, 0), (16, 16)))).all()
    with pytest.raises(ValueError):
        stencil.subview(g, (10, 10), (16, 16))


def test_gauss_and_sobel(spark):
    g = noise(spark, (9, 7))
    v = array(g)
    k = np.array(filters.gaussian_kernel(2))
    assert abs(k.sum() - 1) < 1e-12 and np.allclose(k, k[::-1])
    p = np.pad(v, 2, mode="edge")
    rows = sum(w * p[:, i : i + 9] for i, w in enumerate(k))
    exp = sum(w * rows[i : i + 7] for i, w in enumerate(k))
    assert np.allclose(array(filters.gauss(g, radius=2)), exp)
    p = np.pad(v, 1, mode="edge")
    d = p[:, 2:] - p[:, :-2]
    assert np.allclose(array(filters.sobel(g).map(v=F.col("sx"))), d[:-2] + 2 * d[1:-1] + d[2:])


def test_scans_and_labels(spark):
    g = noise(spark, (9, 7))
    assert (array(reduce.integral(g, "v"), "integral") == array(g).cumsum(0).cumsum(1)).all()
    long = spark.range(1000).withColumn("v", F.col("id") % 7)
    rows = reduce.scan_long(long, "id", "v", chunk=64).orderBy("id").collect()
    assert [r.scan for r in rows] == np.cumsum([i % 7 for i in range(1000)]).tolist()
    labels = spark.createDataFrame([(x,) for x in (5, 900000, 7, 5, 131072)], "label long")
    assert sorted(r.label for r in reduce.dense_labels(labels).collect()) == [1, 1, 2, 3, 4]


def test_region_edges_literal(spark):
    g = noise(spark, (4, 3)).add(label=F.col("x").cast("long"))
    full = {(r.l1, r.l2): r.n for r in reduce.region_edges(g).collect()}
    assert full == {(0, 1): 3, (1, 2): 3, (2, 3): 3}
    cut = {(r.l1, r.l2): r.n for r in reduce.region_edges(g, literal=True).collect()}
    assert cut == {(0, 1): 2, (1, 2): 2, (2, 3): 2}


def test_vectors(spark):
    df = spark.createDataFrame([([0.0, 3.0, 4.0], [1.0, 2.0, 2.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    r = df.select(V.magnitude(a).alias("m"), V.orthonormal(a).alias("o"), V.cross(a, b).alias("c"), V.normalise(a).alias("u"), V.truncated_div(V.scale(-1.0, a), 2).alias("d"), V.insert(a, 1, 9.0).alias("i")).first()
    assert r.m == 5 and abs(np.dot(r.o, [0, 3, 4])) < 1e-12 and abs(np.linalg.norm(r.o) - 1) < 1e-12
    assert r.c == list(np.cross([0, 3, 4], [1, 2, 2])) and np.allclose(r.u, [0, 0.6, 0.8]) and r.d == [0, -1, -2] and r.i == [0, 9, 3, 4]


def test_dense_check(spark):
    g = noise(spark, (3, 3))
    g.check_dense()
    with pytest.raises(ValueError):
        g.of(g.df.filter("x != 1 OR y != 1")).check_dense()
    with pytest.raises(ValueError):
        g.zip(noise(spark, (3, 4)), v="w")
