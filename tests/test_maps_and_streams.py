"""Maps, SQL views, image files, streams of frames, and the queries against DuckDB."""

import struct
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from cellweave import queries
from cellweave.grid import empty_grid
from cellweave.operators import maps, reduce, stencil
from cellweave.sources import generate as G
from cellweave.sources import tables
from cellweave.streaming.frames import frames
from tests.test_grid import array

SMALL = "/root/testdata/sf0.001"


def test_maps(spark):
    a, b = G.unique_ids(spark, (4, 3)), G.constant(spark, 3, (4, 3))
    assert maps.transform(b, lambda v: v + 1).df.agg(F.sum(F.abs(F.col("v") - 4))).first()[0] == 0
    assert (array(maps.transform_many([a, b], lambda x, y: x * y)) == 3 * array(a)).all()
    assert (array(maps.transform_position(a, lambda v, x, y: v - 1 - x - 4 * y)) == 0).all()
    assert (array(maps.add_scaled(a, 2, b)) == array(a) + 6).all() and (array(maps.multiply(a, 15)) == 15 * array(a)).all()
    n = maps.transform_locator(a, lambda n: n[0], [(-1, 0)], assign="add")
    assert array(n)[0].tolist() == [2, 3, 5, 7]
    assert maps.fold_region(a, (1, 1), (2, 2), n=F.count("*"), s=F.sum("v")).first().asDict() == {"n": 4, "s": 6 + 7 + 10 + 11}
    with pytest.raises(ValueError):
        maps.transform_locator(a, lambda n: n[0], assign="none")
    maps.register(a, "cells")
    assert spark.sql("SELECT sum(v) FROM cells").first()[0] == 78


def test_image_files(spark, tmp_path):
    rows = b"".join(b"\0" + bytes((10 * y + x, 100, 200) [i] for x in range(3) for i in range(3)) for y in range(2))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))
    got = {(r.x, r.y): (r.c0, r.c1, r.c2) for r in tables.read_images(spark, str(tmp_path)).collect()}
    assert got == {(x, y): (10 * y + x, 100, 200) for x in range(3) for y in range(2)}


def test_stream_of_frames(spark, tmp_path):
    size = (4, 4)
    for i in range(3):
        g = empty_grid(spark, size).add(v=F.col("x") + i, img=F.lit(i))
        g.df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("x int, y int, v int, img int").parquet(f"{tmp_path}/in")
    work = lambda g: reduce.stats(stencil.neighbours(g, "v", stencil.moore(2)))
    q = frames(stream, size, "img", work, lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}"), f"{tmp_path}/check")
    q.awaitTermination(120)
    rows = {r.img: (r.cells, r.least, r.most) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert rows == {i: (16, i, i + 3) for i in range(3)}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "lineitem events embeddings orders".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def settled(row):
    return tuple(round(float(v), 4) + 0.0 if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_against_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SMALL)
    want = duck.sql(queries.ORACLE[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(n) for n in names]
    got = sorted((settled([r[n] for n in names]) for r in df.collect()), key=str)
    assert got == sorted((settled([r[i] for i in at]) for r in want.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_queries_without_sql(spark, name):
    rows = queries.QUERIES[name](spark, SMALL).collect()
    assert rows
    if name == "max_flow":
        assert rows[0].flow == rows[0].capacity > 0


def test_flagship(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    nodes = [r for r in rows if r.tag == "n"]
    assert sum(r.n for r in nodes) == 64 * 500 and {r.l1 for r in nodes} == set(range(1, len(nodes) + 1))


def test_merged_keys_of_every_row(spark, tmp_path):
    pairs = [(1, 1, 1.0), (2, 1, 2.0), (2, 2, 50.0), (7, 3, 1.0), (107, 3, 50.0), (57, 4, 3.0)]
    spark.createDataFrame(pairs, "l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.id: r.root for r in queries.QUERIES["merged_keys"](spark, str(tmp_path)).collect()}
    assert got == {2: 2, 4: 2, 3: 2, 5: 2, 14: 7, 214: 7, 7: 7, 114: 9, 9: 9}


def test_max_flow_of_the_whole_lattice(spark):
    v = array(queries.li(spark, SMALL)).astype(int)
    room = {}
    for y in range(32):
        room["s"] = room.get("s", {}) | {(y, 0): 100000}
        room.setdefault((y, 31), {})["t"] = 100000
        for x in range(32):
            for a, b in ((x + 1, y), (x, y + 1), (x - 1, y), (x, y - 1)):
                if 0 <= a < 32 and 0 <= b < 32:
                    room.setdefault((x, y), {})[a, b] = 1 + abs(v[y, x] - v[b, a]) % 17
    want = 0
    while True:  # shortest paths, one at a time
        seen, queue = {"s": None}, ["s"]
        for u in queue:
            for w, c in room.get(u, {}).items():
                if c > 0 and w not in seen:
                    seen[w] = u
                    queue.append(w)
        if "t" not in seen:
            break
        path, u = [], "t"
        while seen[u] is not None:
            path.append((seen[u], u))
            u = seen[u]
        d = min(room[a][b] for a, b in path)
        for a, b in path:
            room[a][b] -= d
            back = room.setdefault(b, {})
            back[a] = back.get(a, 0) + d
        want += d
    row = queries.QUERIES["max_flow"](spark, SMALL).first()
    assert row.flow == row.capacity == want


@pytest.mark.parametrize("name", ["grid_segmentation", "region_segmentation"])
def test_segmentations_of_the_whole_grid(spark, name):
    side = {(r.x, r.y): r.side for r in queries.QUERIES[name](spark, SMALL).collect()}
    assert set(side) == {(x, y) for x in range(32) for y in range(32)}
    if name == "grid_segmentation":
        assert side[8, 8] == 0 and side[20, 20] == 1
