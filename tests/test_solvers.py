"""Automata, watersheds, flows and tiles, against plain Python and NumPy."""

import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.grid import Grid, empty_grid
from cellweave.operators import automata as A
from cellweave.operators import maxflow, stencil, tiles
from cellweave.plans import fixpoint
from cellweave.sources import generate as G
from tests.test_grid import array


def of(spark, values):
    h, w = values.shape
    rows = [(x, y, int(values[y, x])) for y in range(h) for x in range(w)]
    return Grid(spark.createDataFrame(rows, "x int, y int, v long"), (w, h))


def flood(values, keep, around):
    """Smallest index plus one of each component."""
    h, w = values.shape
    out = np.zeros((h, w), int)
    for y in range(h):
        for x in range(w):
            if out[y, x] or not keep(values[y, x], values[y, x]):
                continue
            out[y, x] = mark = x + w * y + 1
            q = deque([(x, y)])
            while q:
                a, b = q.popleft()
                for dx, dy in around:
                    c, d = a + dx, b + dy
                    if 0 <= c < w and 0 <= d < h and not out[d, c] and keep(values[b, a], values[d, c]):
                        out[d, c] = mark
                        q.append((c, d))
    return out


MOORE = [o for o in stencil.moore(2) if any(o)]


def test_components_of_a_spiral(spark):
    v = np.zeros((15, 15), int)
    v[::2] = 1
    for i in range(1, 15, 2):  # a serpentine: one long component
        v[i, 14 if i % 4 == 1 else 0] = 1
    got = array(A.label_components(of(spark, v), offsets=stencil.von_neumann(2)), "label")
    assert set(got[v == 1]) == {1} and set(got[v == 0]) == {0}


def test_random_components_and_minima(spark):
    v = np.random.default_rng(0).integers(0, 3, (12, 11))
    got = array(A.label_components(of(spark, v)), "label")
    assert (got == flood(v, lambda a, b: a > 0 and b > 0, MOORE)).all()
    plateau = flood(v, lambda a, b: a == b, MOORE)
    p = np.pad(v, 1, mode="edge")
    low = np.min([p[1 + dy : 13 + dy, 1 + dx : 12 + dx] for dx, dy in MOORE], axis=0) < v
    bad = set(plateau[low])
    exp = np.where(np.isin(plateau, list(bad)), 0, plateau)
    assert (array(A.regional_minima(of(spark, v)), "label") == exp).all()


def test_life_blinker(spark):
    v = np.zeros((5, 5), int)
    v[2, 1:4] = 1
    assert (array(A.Automaton(of(spark, v), stencil.moore(2), A.conway).iterate(1)) == v.T).all()
    still = np.zeros((4, 4), int)
    still[1:3, 1:3] = 1
    assert (array(A.Automaton(of(spark, still), stencil.moore(2), A.conway).until_stable(["v"])) == still).all()


def watershed_steps(v):
    """Synchronous steps of the distance rule."""
    h, w = v.shape
    plateau = flood(v, lambda a, b: a == b, MOORE)
    p = np.pad(v, 1, mode="edge")
    low = np.min([p[1 + dy : h + 1 + dy, 1 + dx : w + 1 + dx] for dx, dy in MOORE], axis=0) < v
    label = np.where(np.isin(plateau, list(set(plateau[low]))), 0, plateau)
    dist = np.where(label > 0, 0.0, np.inf)
    while True:
        nl, nd, moved = label.copy(), dist.copy(), False
        for y in range(h):
            for x in range(w):
                best, found = dist[y, x], None
                for dx, dy in stencil.von_neumann(2)[1:]:
                    a, b = x + dx, y + dy
                    if 0 <= a < w and 0 <= b < h and label[b, a] and dist[b, a] < best:
                        best, found = dist[b, a], label[b, a]
                if found is not None and best + v[y, x] < dist[y, x]:
                    nl[y, x], nd[y, x], moved = found, best + v[y, x], True
        label, dist = nl, nd
        if not moved:
            return label, dist


def test_watersheds(spark):
    v = np.random.default_rng(2).integers(1, 9, (8, 9))
    g = A.watershed_distance(of(spark, v))
    label, dist = watershed_steps(v)
    assert (array(g, "label") == label).all() and (array(g, "distance") == dist).all()
    distinct = np.random.default_rng(3).permutation(72).reshape(8, 9)
    to = {}
    for y in range(8):
        for x in range(9):
            best = (distinct[y, x], x + 9 * y)
            for dx, dy in stencil.von_neumann(2)[1:]:
                if 0 <= x + dx < 9 and 0 <= y + dy < 8 and distinct[y + dy, x + dx] <= best[0]:
                    best = (distinct[y + dy, x + dx], x + dx + 9 * (y + dy))
            to[x + 9 * y] = best[1]
    end = {i: i for i in to}
    for i in to:
        while to[end[i]] != end[i]:
            end[i] = to[end[i]]
    members = {}
    for i, e in end.items():
        members.setdefault(e, []).append(i)
    exp = np.array([min(members[end[x + 9 * y]]) + 1 for y in range(8) for x in range(9)]).reshape(8, 9)
    assert (array(A.watershed_merged(of(spark, distinct), complete=False), "label") == exp).all()
    simple, stable = A.watershed_simple(of(spark, distinct))
    assert stable
    pointed = array(A.watershed_pointers(of(spark, distinct), offsets=stencil.moore(2), complete=False), "label")
    assert (pointed > 0).all()
    with pytest.raises(ValueError):
        A.watershed(of(spark, v), method="none")


def test_simple_watershed_of_a_long_descent(spark):
    ramp = np.arange(260).reshape(1, 260)
    found, stable = A.watershed_simple(of(spark, ramp))
    assert stable and set(array(found, "label")[0]) == {1}
    g = A.watershed(of(spark, ramp), method="descent_simple").df
    assert g.filter("stable AND label = 1").count() == 260
    flat = A.watershed(of(spark, np.zeros((2, 2), int)), method="descent_simple").df
    assert flat.filter("NOT stable").count() == 4


@pytest.mark.parametrize("method", ["distance", "descent_pointer", "descent_gs", "plateaus", "descent_simple"])
def test_watersheds_spread_over_corners(spark, method):
    g = A.watershed(of(spark, np.array([[0, 9], [9, 5]])), method=method)
    assert (array(g, "label") == 1).all()
    if method == "distance":
        assert array(g, "distance")[1, 1] == 5
    if method == "descent_gs":
        four = A.watershed(of(spark, np.array([[0, 9], [9, 5]])), method=method, offsets=stencil.von_neumann(2))
        assert array(four, "label")[1, 1] == 4


def smaller_steps(v):
    """Synchronous rounds of merging with lower neighbours of smaller label."""
    h, w = v.shape
    label = np.arange(h * w).reshape(h, w) + 1
    while True:
        root = {int(i): int(i) for i in label.ravel()}

        def find(i, root=root):
            return i if root[i] == i else find(root[i])

        moved = False
        for y in range(h):
            for x in range(w):
                low, to = v[y, x], None
                for dx, dy in MOORE:
                    a, b = x + dx, y + dy
                    if 0 <= a < w and 0 <= b < h and v[b, a] <= low and label[b, a] < label[y, x]:
                        low, to = v[b, a], int(label[b, a])
                if to is not None:
                    p, q = sorted((find(int(label[y, x])), find(to)))
                    root[q], moved = p, True
        if not moved:
            return label
        label = np.array([find(int(i)) for i in label.ravel()]).reshape(h, w)


def test_watershed_of_smaller_labels(spark):
    row = A.watershed(of(spark, np.array([[3, 5, 1]])), method="descent_smaller")
    assert array(row, "label").tolist() == [[1, 1, 3]]
    v = np.random.default_rng(5).integers(0, 9, (7, 8))
    assert (array(A.watershed_smaller(of(spark, v), complete=False), "label") == smaller_steps(v)).all()


def plain_flow(n, edges, src, snk):
    cap = {}
    for a, b, f, w in edges:
        cap[a, b] = cap.get((a, b), 0) + f
        cap[b, a] = cap.get((b, a), 0) + w
    for i in range(n):
        cap["s", i], cap[i, "t"] = src[i], snk[i]
    flow = 0
    while True:
        seen, q = {"s": None}, deque(["s"])
        while q and "t" not in seen:
            u = q.popleft()
            for (a, b), c in cap.items():
                if a == u and c > 0 and b not in seen:
                    seen[b] = u
                    q.append(b)
        if "t" not in seen:
            return flow
        path, u = [], "t"
        while seen[u] is not None:
            path.append((seen[u], u))
            u = seen[u]
        d = min(cap[e] for e in path)
        for a, b in path:
            cap[a, b] -= d
            cap[b, a] = cap.get((b, a), 0) + d
        flow += d


@pytest.mark.parametrize("small", [0, maxflow.SMALL])
@pytest.mark.parametrize("seed", [1, 2])
def test_max_flow(spark, small, seed):
    rng = random.Random(seed)
    n = 6
    edges = [(a, b, rng.randint(0, 6), rng.randint(0, 6)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
    src = [rng.choice([0, 0, 5]) for _ in range(n - 1)] + [0]
    snk = [0] + [rng.choice([0, 0, 7]) for _ in range(n - 1)]
    v = spark.createDataFrame([(i, float(src[i]), float(snk[i])) for i in range(n)], "id long, cap_src double, cap_snk double")
    e = spark.createDataFrame([(k, a, b, float(f), float(w)) for k, (a, b, f, w) in enumerate(edges)], "eid long, a long, b long, w_fwd double, w_bwd double")
    flow, segments = maxflow.max_flow(v, e, small=small)
    assert flow == plain_flow(n, edges, src, snk)
    assert (maxflow.cut_capacity(v, e, segments).first().capacity or 0.0) == flow


def test_layered_graph(spark):
    v, e = G.layered_graph(spark, 4, 8, 4, 1)
    assert maxflow.max_flow(v, e)[0] == 8 * 4
    swapped = v.select("id", F.col("cap_snk").alias("cap_src"), F.col("cap_src").alias("cap_snk"))
    assert maxflow.max_flow(swapped, e)[0] == 8 * 4 * 2


@pytest.mark.parametrize("small", [0, maxflow.SMALL])
def test_max_flow_least_and_trace(spark, small):
    v = spark.createDataFrame([(0, 9.0, 0.0), (1, 0.0, 0.0), (2, 0.0, 9.0)], "id long, cap_src double, cap_snk double")
    e = spark.createDataFrame([(0, 0, 1, 5.0, 0.0), (1, 1, 2, 3.0, 0.0), (2, 0, 2, 0.5, 0.0)], "eid long, a long, b long, w_fwd double, w_bwd double")
    told = []
    flow, _ = maxflow.max_flow(v, e, small=small, trace=lambda *t: told.append(t))
    assert flow == 3.5 and told[0] == ("relabel", 0, 0.0) and told[-1][0] == "relabel" and told[-1][2] == 3.5
    assert [t[0] for t in told] == ["relabel", "push"] * (len(told) // 2) + ["relabel"]
    none, segments = maxflow.max_flow(v, e, least=5.0, small=small)
    assert none == 0.0 and {r.id: r.side for r in segments.collect()} == {0: 0, 1: 0, 2: 1}


def test_levels(spark):
    arcs = spark.createDataFrame([(0, 0, 1, 1.0), (1, 1, 2, 1.0), (2, 3, 2, 0.0)], "eid long, src long, dst long, res double")
    v = spark.createDataFrame([(i, float(i == 2)) for i in range(4)], "id long, room double")
    for small in (0, 100):
        assert {r.id: r.level for r in maxflow.levels(v, arcs, small=small).collect()} == {2: 1, 1: 2, 0: 3}


def test_components_and_roots(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 51), (7, 7)], "a long, b long")
    for small in (0, fixpoint.SMALL):
        got = {r.id: r.root for r in fixpoint.components(links, small=small).collect()}
        assert {got[i] for i in range(41)} == {0} and got[51] == 50 and 7 in got
    chain = spark.createDataFrame([(i, max(i - 1, 0)) for i in range(20)], "id long, parent long")
    assert {r.root for r in fixpoint.roots(chain).collect()} == {0}


def volume(spark, size=(7, 6, 5)):
    return empty_grid(spark, size).add(v=((F.col("x") * 31 + F.col("y") * F.col("y") * 17 + F.col("z") * 7) % 23).cast("double"))


def test_nonlocal_means(spark):
    g = volume(spark)
    v = np.pad(array(g), 3, mode="edge")
    got = array(tiles.nonlocal_means(g, patch=1, search=2, variance=50.0, tile=4))
    z, y, x = 2, 0, 6
    c = np.array([z, y, x]) + 3
    top = bottom = 0.0
    for o in np.ndindex(5, 5, 5):
        s = c + np.array(o) - 2
        d = 0.0
        for p in np.ndindex(3, 3, 3):
            q = np.array(p) - 1
            a, b = c + q, s + q
            d += (v[tuple(np.clip(a, 0, np.array(v.shape) - 1))] - v[tuple(np.clip(b, 0, np.array(v.shape) - 1))]) ** 2
        w = np.exp(-d / 50.0)
        top += w * v[tuple(s)]
        bottom += w
    assert abs(got[z, y, x] - top / bottom) < 1e-9


def test_diffusion_does_not_depend_on_tiles(spark):
    g = volume(spark, (10, 9, 8))
    a, b = (array(tiles.coherence_diffusion(g, steps=2, tile=t)) for t in (4, 64))
    assert np.allclose(a, b) and not np.allclose(a, array(g))
    flat = empty_grid(spark, (5, 5, 5)).add(v=F.lit(3.0))
    assert np.allclose(array(tiles.coherence_diffusion(flat)), 3.0)
