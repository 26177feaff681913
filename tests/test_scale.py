"""What large inputs need: folds and scans in levels, tiles, no session settings or tables left behind."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave import queries
from cellweave.functions import cells as C
from cellweave.grid import Grid, empty_grid
from cellweave.operators import automata as A
from cellweave.operators import maxflow, reduce, stencil, tiles
from cellweave.plans import fixpoint, pipelines, storage
from cellweave.sources import generate as G
from cellweave.sources import lattice_file, tables
from tests.test_grid import array
from tests.test_solvers import of, watershed_steps

SMALL = "/root/testdata/sf0.001"


def test_fold_of_a_constant_grid(spark):
    g = G.constant(spark, 2, (300, 200))
    for group in (64, 5000, 1 << 20):
        assert reduce.fold(g.df.repartition(7), "v", F.lit(0).cast("long"), lambda a, b: a + b, group).collect() == [(120_000,)]
    assert reduce.fold(g.df.limit(0), "v", F.lit(7), lambda a, b: a + b).collect() == [(7,)]


def test_fold_takes_groups_of_rows_not_of_values(spark):
    df = spark.range(1000).select(F.lit(1).alias("v"))
    plan = df.groupBy(F.floor(F.monotonically_increasing_id() / 100).alias("g")).count()
    assert plan.agg(F.max("count")).first()[0] <= 100
    assert reduce.fold(df, "v", F.lit(0), lambda a, b: a + b, 100).first().v == 1000


@pytest.mark.parametrize("chunk", [3, 10, 1000])
def test_scans_and_labels_in_levels(spark, chunk):
    df = spark.range(200).select(F.col("id").alias("i"), (F.col("id") % 7).alias("p"))
    got = [r.scan for r in reduce.scan_long(df, "i", "p", chunk=chunk).orderBy("i").collect()]
    assert got == np.cumsum(np.arange(200) % 7).tolist()
    labels = spark.createDataFrame([(x,) for x in (5, 900, 17, 5, 40, 41, 100000, 17)], "label long")
    got = sorted((r.label for r in reduce.dense_labels(labels, chunk=chunk).collect()))
    assert got == [1, 1, 2, 2, 3, 4, 5, 6]


@pytest.mark.parametrize("offsets", [stencil.von_neumann(2), stencil.moore(2)])
@pytest.mark.parametrize("tile", [3, 5, 128])
def test_distances_do_not_depend_on_tiles(spark, tile, offsets):
    v = np.random.default_rng(4).integers(0, 6, (11, 13))
    g = A.watershed_distance(of(spark, v), offsets=offsets, tile=tile)
    if offsets == stencil.von_neumann(2):
        label, dist = watershed_steps(v)
    else:
        whole = A.watershed_distance(of(spark, v), offsets=offsets)
        label, dist = array(whole, "label"), array(whole, "distance")
    assert (array(g, "label") == label).all() and (array(g, "distance") == dist).all()


def test_distances_of_a_volume_and_a_limit(spark):
    v = empty_grid(spark, (6, 5, 4)).add(v=(F.col("x") * 7 + F.col("y") * 5 + F.col("z") * 3) % 11)
    a, b = (A.watershed_distance(v, tile=t) for t in (2, 32))
    assert a.df.exceptAll(b.df).isEmpty() and a.df.filter("label = 0").isEmpty()
    ramp = of(spark, np.arange(40).reshape(1, 40))
    with pytest.raises(fixpoint.NotStable):
        A.watershed_distance(ramp, tile=4, limit=3)
    assert set(array(A.watershed_distance(ramp, tile=4), "label")[0]) == {1}


@pytest.mark.parametrize("tile", [6, 64])
def test_basins_of_a_sparse_grid_with_odd_values(spark, tile):
    v = np.random.default_rng(8).integers(0, 4, (17, 20))
    cells = of(spark, v)
    odd = cells.of(cells.df.filter("v > 0 OR (x + y) % 2 = 0").select("x", "y", F.when(F.col("v") > 0, F.col("v")).alias("v")))
    a, b = A.watershed_distance(cells, tile=tile), A.watershed_distance(odd, tile=tile, fill=0)
    assert sorted(a.df.collect()) == sorted(b.df.select(a.df.columns).collect()) and a.df.count() == v.size
    with pytest.raises(ValueError):
        A.watershed_distance(cells.add(w=F.lit(1)), fill=0)
    marked = cells.map(v=F.when(F.col("v") == 1, F.lit(None)).when(F.col("v") == 2, F.lit(float("nan"))).otherwise(F.col("v").cast("double")))
    got = A.regional_minima(marked, tile=tile)
    null, nan, low = (got.df.filter(c) for c in ("v IS NULL", "isnan(v)", "v = 0"))
    assert [d.count() for d in (null, nan, low)] == [(v == k).sum() for k in (1, 2, 0)]
    assert null.filter("label != 0").isEmpty() and low.filter("label = 0").isEmpty()


def test_minima_of_a_plateau_through_all_tiles(spark):
    v = np.full((30, 31), 5)
    v[::2] = 1
    v[:, 0] = 1
    g = A.regional_minima(of(spark, v), tile=8)
    assert (array(g, "label") == (v == 1)).all()
    v[29, 30] = 0  # one lower cell beside the far end
    v[28, 30] = 1
    label = array(A.regional_minima(of(spark, v), tile=8), "label")
    assert label[29, 30] == 29 * 31 + 31 and (label > 0).sum() == 1


def test_basins_write_borders_and_not_cells(spark):
    v = np.random.default_rng(9).integers(0, 10, (256, 256))
    storage.cleanup(spark)
    cells = of(spark, v)
    found = A.watershed_distance(cells, tile=64).df
    folder = Path(storage.run_dir(spark).removeprefix("file://"))
    written = sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    assert written < 8 * v.size, f"{written / v.size} bytes a cell"
    assert found.filter("label = 0").isEmpty()


def test_automaton_until_stable_watches_columns(spark):
    rows = of(spark, np.arange(12).reshape(1, 12))
    spread = lambda n: {"v": F.array_min(n["v"])}
    assert (array(A.Automaton(rows, stencil.von_neumann(2), spread).until_stable(["v"])) == 0).all()
    with pytest.raises(fixpoint.NotStable):
        A.Automaton(rows, stencil.von_neumann(2), spread).until_stable(["v"], limit=4)
    with pytest.raises(ValueError):
        A.Automaton(rows, stencil.four(), spread).until_stable(["v"])


@pytest.mark.parametrize("small", [0, 5, 1000])
def test_components_down_to_any_size(spark, small):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(None, 3), (4, 4)]
    root = {i: i for p in links for i in p if i is not None}
    for _ in root:
        for a, b in links:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    got = {r.id: r.root for r in fixpoint.components(spark.createDataFrame(links, "a long, b long"), small=small).collect()}
    assert got == {i: root[i] for i in got} and {i for a, b in links if a is not None and a != b for i in (a, b)} == set(got)
    assert fixpoint.components(spark.createDataFrame([], "a long, b long"), small=small).isEmpty()


def test_tables_are_cleaned_up(spark):
    df = storage.saved(spark.range(5), "trial")
    assert storage.run_dir(spark) in df.inputFiles()[0]
    storage.cleanup(spark)
    with pytest.raises(Exception):  # noqa: B017
        df.count()
    assert storage.saved(spark.range(5), "trial").count() == 5


def test_scratch_tables_go_and_kept_ones_stay(spark):
    with storage.scratch(spark) as kept:
        step = storage.saved(spark.range(6), "trial")
        out = kept(step.filter("id > 2"), "kept")
    assert out.count() == 3
    with pytest.raises(Exception):  # noqa: B017
        step.count()
    assert storage.saved(spark.range(2), "trial").count() == 2


def least_side(n, edges, source, sink, least=0.0):
    """Vertices that reach the sink when no more can flow, by shortest paths one at a time."""
    room = {}
    for a, b, f, w in edges:
        room[a, b] = room.get((a, b), 0.0) + f
        room[b, a] = room.get((b, a), 0.0) + w
    for i in range(n):
        if source.get(i):
            room["s", i] = source[i]
        if sink.get(i):
            room[i, "t"] = sink[i]
    near = {}
    for a, b in list(room):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
        room.setdefault((b, a), 0.0)
    flow = 0.0
    while True:
        seen, queue = {"s": None}, ["s"]
        for u in queue:
            for w in near.get(u, ()):
                if w not in seen and room[u, w] > max(least, 1e-12):
                    seen[w] = u
                    queue.append(w)
        if "t" not in seen:
            break
        path, u = [], "t"
        while seen[u] is not None:
            path.append((seen[u], u))
            u = seen[u]
        d = min(room[e] for e in path)
        for a, b in path:
            room[a, b] -= d
            room[b, a] += d
        flow += d
    back, queue = {"t"}, ["t"]
    for u in queue:
        for w in near.get(u, ()):
            if w not in back and room[w, u] > max(least, 1e-12):
                back.add(w)
                queue.append(w)
    return flow, {i for i in range(n) if i in back}


def flow_tables(spark, n, edges, source, sink):
    v = spark.createDataFrame([(i, float(source.get(i, 0)), float(sink.get(i, 0))) for i in range(n)], "id long, cap_src double, cap_snk double")
    e = spark.createDataFrame([(k, a, b, float(f), float(w)) for k, (a, b, f, w) in enumerate(edges)], "eid long, a long, b long, w_fwd double, w_bwd double")
    return v, e


@pytest.mark.parametrize("small", [0, maxflow.SMALL])
def test_flow_of_a_lattice_with_all_neighbours(spark, small):
    rng = np.random.default_rng(5)
    v = rng.integers(0, 9, (4, 5))
    full = G.full_lattice(of(spark, v), "v", lambda a, b: 1 + F.abs(a - b))
    edges = [(r.a, r.b, r.w_fwd, r.w_bwd) for r in full.collect()]
    assert len(edges) == 4 * 4 + 3 * 5 + 2 * 3 * 4
    source, sink = {i: 50 for i in range(5)}, {15 + i: 50 for i in range(5)}
    flow, side = least_side(20, edges, source, sink)
    got, segments = maxflow.max_flow(*flow_tables(spark, 20, edges, source, sink), small=small)
    assert got == flow and {r.id for r in segments.filter("side = 1").collect()} == side


def test_levels_over_all_executors(spark):
    v, e = G.layered_graph(spark, 6, 8, 3, 2)
    own, arcs = v.select("id", F.col("cap_snk").alias("room")), maxflow.arcs_of(e)
    one, all_ = (maxflow.levels(own, arcs, small=n).select("id", "level") for n in (maxflow.SMALL, 0))
    assert one.exceptAll(all_).isEmpty() and all_.exceptAll(one).isEmpty() and one.count() == 48


def test_grid_segmentation_against_plain_flow(spark):
    v = array(queries.li(spark, SMALL)).astype(float)
    edges = []
    for y in range(32):
        for x in range(32):
            for dx, dy in ((1, 0), (0, 1)):
                if x + dx < 32 and y + dy < 32:
                    w = float(np.exp(-((v[y, x] - v[y + dy, x + dx]) ** 2) / 2.0 * 1e-4))
                    edges.append((x + 32 * y, x + dx + 32 * (y + dy), w, w))
    _, side = least_side(1024, edges, {8 + 32 * 8: 1e6}, {20 + 32 * 20: 1e6}, 1e-9)
    got = {r.x + 32 * r.y for r in queries.QUERIES["grid_segmentation"](spark, SMALL).filter("side = 1").collect()}
    assert got == side


def test_region_segmentation_against_plain_flow(spark):
    rows = queries.QUERIES["region_segmentation"](spark, SMALL).collect()
    v = array(queries.li(spark, SMALL)).astype(float)
    label = {(r.x, r.y): r.label for r in rows}
    weight, source, sink = {}, {}, {}
    for (x, y), a in label.items():
        if x < 5:
            source[a] = 1e4
        if x >= 27:
            sink[a] = 1e4
        for q in ((x + 1, y), (x, y + 1)):
            if q in label and label[q] != a:
                key = tuple(sorted((a, label[q])))
                weight[key] = weight.get(key, 0.0) + (1.0 / (1.0 + max(v[y, x], v[q[1], q[0]]))) ** 2
    ids = {lab: i for i, lab in enumerate(sorted(set(label.values())))}
    edges = [(ids[a], ids[b], w, w) for (a, b), w in weight.items()]
    _, side = least_side(len(ids), edges, {ids[k]: c for k, c in source.items()}, {ids[k]: c for k, c in sink.items()})
    assert {r.label for r in rows if r.side == 1} == {lab for lab, i in ids.items() if i in side}


def plain_coherence(v, dt, alpha=0.001, contrast=15.0):
    """One step, cell by cell, with all reads clamped to the array."""
    from cellweave.operators.filters import gaussian_kernel

    n = v.ndim
    at = lambda a, p: a[tuple(np.clip(p, 0, np.array(a.shape) - 1))]
    taps = {0: (1.0, 2.0, 1.0), 1: (-1.0, 0.0, 1.0)}

    def derivative(a, axis):
        out = np.zeros(a.shape)
        for p in np.ndindex(*a.shape):
            for o in np.ndindex(*[3] * n):
                w = np.prod([taps[int(k == axis)][o[k]] for k in range(n)])
                out[p] += w * at(a, np.array(p) + np.array(o) - 1)
        return out

    g = [derivative(v, axis) for axis in reversed(range(n))]
    blur = gaussian_kernel(2)
    tensor = np.zeros((*v.shape, n, n))
    for i in range(n):
        for j in range(n):
            for p in np.ndindex(*v.shape):
                for o in np.ndindex(*[5] * n):
                    tensor[(*p, i, j)] += np.prod([blur[k] for k in o]) * at(g[i] * g[j], np.array(p) + np.array(o) - 2)
    flux = np.zeros((n, *v.shape))
    for p in np.ndindex(*v.shape):
        values, vectors = np.linalg.eigh(tensor[p])
        k = sum((values[i] - values[j]) ** 2 for i in range(n) for j in range(i + 1, n))
        new = np.full(n, alpha)
        if k >= 1e-8:
            new[0] += (1 - alpha) * np.exp(-contrast / k)
        d = vectors @ np.diag(new) @ vectors.T
        flux[(slice(None), *p)] = d @ np.array([g[i][p] for i in range(n)])
    return v + dt * sum(derivative(flux[i], n - 1 - i) for i in range(n))


@pytest.mark.parametrize("size", [(6, 5), (5, 4, 3)])
def test_coherence_step_cell_by_cell(spark, size):
    g = empty_grid(spark, size)
    v = sum((F.col(a) * F.col(a) * k for a, k in zip(g.axes, (3, 5, 7), strict=False)), F.lit(0)) % 13
    g = g.add(v=v.cast("double"))
    exp = plain_coherence(plain_coherence(array(g).astype(float), 0.05), 0.05)
    for tile, together in ((3, 1), (64, 2)):
        assert np.allclose(array(tiles.coherence_diffusion(g, steps=2, tile=tile, together=together)), exp)


def test_diffused_image(spark):
    g = of(spark, np.random.default_rng(1).integers(0, 256, (9, 12)))
    v = array(g) / 255.0
    for _ in range(3):
        v = plain_coherence(v, 0.1)
    assert (array(pipelines.diffuse_image(g, steps=3, together=2)) == np.floor(np.clip(v * 255, 0, 255))).all()


def test_lattices_of_26_neighbours(spark, tmp_path):
    steps = lattice_file.STEPS[26]
    assert len(set(steps)) == 26 and steps[0] == (-1, -1, -1) and steps[1] == (0, -1, -1) and len(lattice_file.STEPS[8]) == 8
    cap = [np.full(8, 1 + k) for k in range(26)]
    top = np.where(np.arange(8) < 4, 1000, 0)
    x = lattice_file.Lattice((2, 2, 2), top, top[::-1], cap, np.ones(8))
    lattice_file.write_lattice(spark, x, f"file://{tmp_path}/a")
    v, e = lattice_file.read_lattices(spark, f"file://{tmp_path}/a")
    want = sum(1 + k for k, (dx, dy, dz) in enumerate(steps) if dz == 1 for a in (0, 1) for b in (0, 1) if 0 <= a + dx < 2 and 0 <= b + dy < 2)
    assert maxflow.max_flow(v.drop("path"), e.drop("path"))[0] == want
    bad = bytearray(x.pack())
    bad[3 + 4 : 3 + 8] = (7).to_bytes(4, "little")
    with pytest.raises(ValueError, match="7 neighbours"):
        lattice_file.Lattice.unpack(bytes(bad))


def test_volume_files_of_types(spark, tmp_path):
    g = empty_grid(spark, (3, 2, 2)).add(v=F.col("x") + 10 * F.col("y") + 100 * F.col("z"))
    for element in ("MET_UCHAR", "MET_SHORT", "MET_FLOAT"):
        tables.write_volume(g, f"file://{tmp_path}/{element}/v.mhd", element=element)
        assert (array(tables.read_volume(spark, f"file://{tmp_path}/{element}/v.mhd")) == array(g)).all()
    text = (tmp_path / "MET_SHORT" / "v.mhd").read_text()
    (tmp_path / "MET_SHORT" / ".v.mhd.crc").unlink(missing_ok=True)
    (tmp_path / "MET_SHORT" / "v.mhd").write_text(text.replace("3 2 2", "3 2 3"))
    with pytest.raises(ValueError, match="bytes"):
        tables.read_volume(spark, f"file://{tmp_path}/MET_SHORT/v.mhd")
    (tmp_path / "MET_SHORT" / "v.mhd").write_text(text.replace("MET_SHORT", "MET_ODD"))
    with pytest.raises(ValueError, match="MET_ODD"):
        tables.read_volume(spark, f"file://{tmp_path}/MET_SHORT/v.mhd")


def test_gray_images(spark, tmp_path):
    g = Grid(empty_grid(spark, (5, 3)).df.withColumn("v", F.col("x") + 40 * F.col("y")), (5, 3))
    tables.write_images(g.add(v=C.upper_limit(F.col("v"), 255)), ("v",), f"file://{tmp_path}")
    got = {(r.x, r.y): r.c0 for r in tables.read_images(spark, f"file://{tmp_path}").collect()}
    assert got == {(x, y): x + 40 * y for x in range(5) for y in range(3)}
