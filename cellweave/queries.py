"""The library's queries over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cells as C
from .functions import vectors as V
from .grid import Grid, coords_of
from .operators import automata as A
from .operators import filters, maps, maxflow, reduce, stencil, tiles
from .plans import pipelines
from .plans.storage import run_dir
from .sources import generate, lattice_file, tables, text

# ---------------------------------------------------------------- grids


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emb(spark: SparkSession, sf_dir: str) -> Grid:
    """Bytes of embeddings: y the vector, x the place in it."""
    df = _table(spark, sf_dir, "embeddings")
    rows = df.agg(F.max("vec_id")).first()[0] + 1
    g = tables.bytes_of(tables.from_vectors(df, "vec_id", "embedding", rows, 64))
    return g.add(v=F.col("v").cast("long"))


def li(spark: SparkSession, sf_dir: str) -> Grid:
    """32 x 32 sums of quantities by part and supplier."""
    df = _table(spark, sf_dir, "lineitem")
    return tables.binned(df, (32, 32), {"x": F.col("l_partkey") % 32, "y": F.col("l_suppkey") % 32}, F.sum(F.col("l_quantity").cast("long")), spark)


def ev(spark: SparkSession, sf_dir: str) -> Grid:
    """16 x 16 x 5 counts of events by user, event and type."""
    df = _table(spark, sf_dir, "events")
    names = [r[0] for r in df.select("event_type").distinct().orderBy("event_type").collect()]  # five types
    z = F.lit(-1)
    for i, n in enumerate(names):
        z = F.when(F.col("event_type") == n, i).otherwise(z)
    return tables.binned(df, (16, 16, 5), {"x": F.col("user_id") % 16, "y": F.col("event_id") % 16, "z": z}, F.count("*"), spark)


def ord_(spark: SparkSession, sf_dir: str, dense: bool = True) -> Grid:
    """Prices of orders in steps of 50,000: 64 columns, and rows that grow with the orders; ``dense`` false: only cells of an order."""
    df = _table(spark, sf_dir, "orders")
    rows = df.agg(F.max("o_orderkey")).first()[0] // 64 + 1
    return tables.binned(df, (64, rows), {"x": F.col("o_orderkey") % 64, "y": F.floor(F.col("o_orderkey") / 64)}, F.max(F.floor(F.col("o_totalprice") / 50000)), spark, dense)


ORD = "ord AS MATERIALIZED (SELECT CAST(i % 64 AS INT) AS x, CAST(i // 64 AS INT) AS y, i AS id, CAST(coalesce(v, 0) AS BIGINT) AS v FROM (SELECT unnest(range(0, (SELECT (max(o_orderkey) // 64 + 1) * 64 FROM orders))) AS i) LEFT JOIN (SELECT o_orderkey, max(floor(o_totalprice / 50000)) AS v FROM orders GROUP BY 1) ON o_orderkey = i)"
EMB = "emb AS (SELECT CAST(i - 1 AS INT) AS x, CAST(vec_id AS INT) AS y, CAST(least(255, greatest(0, floor((CAST(embedding[i] AS DOUBLE) + 1) * 127.5))) AS BIGINT) AS v FROM embeddings, range(1, 65) t(i))"
LI = "li AS (SELECT CAST(a.i AS INT) AS x, CAST(b.i AS INT) AS y, CAST(coalesce(s.v, 0) AS BIGINT) AS v FROM range(32) a(i) CROSS JOIN range(32) b(i) LEFT JOIN (SELECT l_partkey % 32 AS x, l_suppkey % 32 AS y, sum(CAST(l_quantity AS BIGINT)) AS v FROM lineitem GROUP BY ALL) s ON s.x = a.i AND s.y = b.i)"
EV = "ev AS (SELECT CAST(a.i AS INT) AS x, CAST(b.i AS INT) AS y, CAST(c.i AS INT) AS z, CAST(coalesce(s.v, 0) AS BIGINT) AS v FROM range(16) a(i) CROSS JOIN range(16) b(i) CROSS JOIN range(5) c(i) LEFT JOIN (SELECT user_id % 16 AS x, event_id % 16 AS y, r - 1 AS z, count(*) AS v FROM (SELECT *, dense_rank() OVER (ORDER BY event_type) AS r FROM events) GROUP BY ALL) s ON s.x = a.i AND s.y = b.i AND s.z = c.i)"
#: Offsets of a neighbourhood as a table o(k, dx, dy).
MOORE2 = "o(k, dx, dy) AS (VALUES (0,0,0),(1,-1,-1),(2,0,-1),(3,1,-1),(4,-1,0),(5,1,0),(6,-1,1),(7,0,1),(8,1,1))"
CROSS2 = "o(k, dx, dy) AS (VALUES (0,0,0),(1,-1,0),(2,0,-1),(3,1,0),(4,0,1))"


def _near(grid: str, nx: str, ny: str, border: bool = True) -> str:
    """A CTE n(x, y, v, k, nx, ny, nv) of neighbours, clamped or cut at the border."""
    if border:
        on = f"b.x = least({nx} - 1, greatest(0, c.x + o.dx)) AND b.y = least({ny} - 1, greatest(0, c.y + o.dy))"
    else:
        on = "b.x = c.x + o.dx AND b.y = c.y + o.dy"
    return f"n AS (SELECT c.x, c.y, c.v, o.k, o.dx, o.dy, b.x AS ox, b.y AS oy, b.v AS nv FROM {grid} c CROSS JOIN o JOIN {grid} b ON {on})"


NEAR_LI = _near("li", "32", "32")
NEAR_EMB = _near("emb", "64", "(SELECT max(y) + 1 FROM emb)")
CUT_LI = _near("li", "32", "32", False)

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


# ---------------------------------------------------------------- reductions and cells


@query(f"WITH {EMB} SELECT CAST(max(x) + 1 AS INT) AS nx, CAST(max(y) + 1 AS INT) AS ny, count(*) AS cells, min(v) AS least, max(v) AS most, CAST(sum(v) AS BIGINT) AS total, round(avg(v), 6) AS mean FROM emb")
def grid_stats(spark, sf_dir):
    return reduce.stats(emb(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


@query(f"""WITH {LI}, c AS (SELECT *, v % 256 AS r, v * 7 % 256 AS g, v * 13 % 256 AS b FROM li)
SELECT x, y, 255 - r AS negative, CAST((r + 2 * g + b) // 4 AS BIGINT) AS gray, CASE WHEN v < 900 THEN 0 ELSE 255 END AS over, CAST(least(255, greatest(0, v / 3.0)) AS DOUBLE) - CAST(least(255, greatest(0, v / 3.0)) AS DOUBLE) + floor(least(255, greatest(0, v / 3.0))) AS byte,
v * 123 % 256 AS c0, v * 7 % 256 AS c1, v * 13 % 256 AS c2, v * v AS sq, round(sqrt(v), 6) AS rt, greatest(800, v) AS low, least(1000, v) AS up, CASE WHEN v < 800 THEN -1 ELSE v END AS lowr, CASE WHEN v > 1000 THEN -2 ELSE v END AS upr,
CASE WHEN x % 3 != 0 THEN v ELSE -5 END AS masked, CASE WHEN x % 3 = 0 THEN 0 ELSE CAST(x + 32 * y + 1 AS BIGINT) END AS mid, CASE WHEN r + g + b > 300 THEN 0 ELSE 1 END AS alive, r + g + b AS channels, round(r / 255.0, 6) AS u, abs(v - 900) AS dist FROM c""")
def cell_functions(spark, sf_dir):
    g = li(spark, sf_dir)
    v, r, gr, b = F.col("v"), F.col("v") % 256, F.col("v") * 7 % 256, F.col("v") * 13 % 256
    c0, c1, c2 = C.colour(v)
    return g.map(
        negative=C.negate(r), gray=C.grayscale(r, gr, b).cast("long"), over=C.threshold(v, 900, 0, 255), byte=C.to_byte(v / 3.0).cast("double"), c0=c0.cast("long"), c1=c1.cast("long"), c2=c2.cast("long"),
        sq=C.square(v), rt=F.round(C.root(v), 6), low=C.lower_limit(v, 800), up=C.upper_limit(v, 1000), lowr=C.lower_limit(v, 800, -1), upr=C.upper_limit(v, 1000, -2),
        masked=C.masked(v, F.col("x") % 3, -5), mid=C.masked_id(F.col("x") % 3, g.index()), alive=C.alive(r, gr, b), channels=C.total(r, gr, b), u=F.round(C.reaction(r, b)[0], 6), dist=F.abs(v - 900),
    ).df


@query(f"""WITH {LI} SELECT a.x, a.y, CAST(0.5 * a.v + 2 * b.v AS DOUBLE) AS lin, a.v + b.v AS plus, a.v - b.v AS minus, a.v * b.v AS times, round(a.v / nullif(b.v, 0), 6) AS ratio, a.v + a.x - a.y AS placed, a.v + b.v + 3 AS three
FROM li a JOIN li b ON b.x = 31 - a.x AND b.y = 31 - a.y""")
def view_arithmetic(spark, sf_dir):
    a = li(spark, sf_dir)
    both = a.zip(stencil.flip(a, "x", "y").map(w=F.col("v")))
    v, w = F.col("v"), F.col("w")
    return both.map(lin=C.linear(0.5, v, 2.0, w), plus=v + w, minus=v - w, times=v * w, ratio=F.round(C.divide(v, w), 6), placed=v + F.col("x") - F.col("y"), three=C.total(v, w, F.lit(3))).df


def _blocked(b: int) -> str:
    return f"(z - z % {b}) * 256 + (y - y % {b}) * 16 * least({b}, 5 - (z - z % {b})) + (x - x % {b}) * least({b}, 16 - (y - y % {b})) * least({b}, 5 - (z - z % {b})) + x % {b} + least({b}, 16 - (x - x % {b})) * (y % {b} + least({b}, 16 - (y - y % {b})) * (z % {b}))"


@query(f"""WITH {EV} SELECT x, y, z, CAST(x + 16 * (y + 16 * z) AS BIGINT) AS idx, CAST((SELECT sum(((x >> b) & 1) << (3 * b)) + sum(((y >> b) & 1) << (3 * b + 1)) + sum(((z >> b) & 1) << (3 * b + 2)) FROM range(5) t(b)) AS BIGINT) AS morton, CAST({_blocked(2)} AS BIGINT) AS b2, CAST({_blocked(3)} AS BIGINT) AS b3, x AS bx, y AS by, z AS bz FROM ev""")
def index_math(spark, sf_dir):
    g = ev(spark, sf_dir)
    x, y, z = (F.col(c) for c in "xyz")
    back = coords_of(g.index(), g.size)
    return g.map(idx=g.index(), morton=V.morton(x, y, z), b2=V.blocked_index(x, y, z, g.size, 2), b3=V.blocked_index(x, y, z, g.size, 3), bx=back[0], by=back[1], bz=back[2]).df


@query(f"""WITH {LI}, a AS (SELECT x, y, x + 1.0 AS a0, y - 3.0 AS a1, v / 100.0 AS a2, v / 50.0 AS b0, x - 7.0 AS b1, y + 2.0 AS b2 FROM li)
SELECT x, y, round(a0 + b0 + a1 + b1 + a2 + b2, 6) AS plus, round((a0 - b0) * (a0 - b0) + (a1 - b1) * (a1 - b1) + (a2 - b2) * (a2 - b2), 6) AS far, round(a0 * b0 + a1 * b1 + a2 * b2, 6) AS dot, round(sqrt(a0 * a0 + a1 * a1 + a2 * a2), 6) AS len, round(a1 * b2 - a2 * b1, 6) AS cx, round(a2 * b0 - a0 * b2, 6) AS cy, round(a0 * b1 - a1 * b0, 6) AS cz, round(a0 * a1 * a2, 6) AS prod, round(least(a0, b0) + greatest(a1, b1), 6) AS mm, (a0 < b0 AND a1 < b1 AND a2 < b2) AS below, round(greatest(a0, a1, a2), 6) AS most FROM a""")
def vector_math(spark, sf_dir):
    g = li(spark, sf_dir)
    a = F.array(F.col("x") + 1.0, F.col("y") - 3.0, F.col("v") / 100.0)
    b = F.array(F.col("v") / 50.0, F.col("x") - 7.0, F.col("y") + 2.0)
    df = g.df.select("x", "y", a.alias("a"), b.alias("b"))
    a, b = F.col("a"), F.col("b")
    d = V.minus(a, b)
    k = V.cross(a, b)
    r = lambda c: F.round(c, 6)
    return df.select("x", "y", r(V.component_sum(V.plus(a, b))).alias("plus"), r(V.dot(d, d)).alias("far"), r(V.dot(a, b)).alias("dot"), r(V.magnitude(a)).alias("len"), r(k[0]).alias("cx"), r(k[1]).alias("cy"), r(k[2]).alias("cz"), r(V.component_product(a)).alias("prod"), r(V.least(a, b)[0] + V.most(a, b)[1]).alias("mm"), V.all_less(a, b).alias("below"), r(F.array_max(a)).alias("most"))


@query(f"""WITH {LI}, t AS (SELECT x, y, v % 11 + 1.0 AS a, x % 5 - 2.0 AS b, y % 3 + 0.0 AS c, v % 7 + 2.0 AS d, x % 4 - 1.0 AS e, y % 6 + 1.0 AS f FROM li)
SELECT x, y, CAST(a + d + f AS DOUBLE) AS trace, CAST(a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS DOUBLE) AS det, CAST(a * 1 + b * 2 + c * 3 AS DOUBLE) AS m0, true AS rebuilt FROM t""")
def tensor_math(spark, sf_dir):
    g = li(spark, sf_dir)
    t = [F.col("v") % 11 + 1.0, F.col("x") % 5 - 2.0, F.col("y") % 3 + 0.0, F.col("v") % 7 + 2.0, F.col("x") % 4 - 1.0, F.col("y") % 6 + 1.0]
    df = g.df.select("x", "y", F.array(*t).alias("t")).withColumn("e", V.eigen("t"))
    part = [F.col("t")[i] for i in range(6)]
    value, vector = F.col("e.values"), F.col("e.vectors")
    err = F.lit(0.0)
    for k, (i, j) in enumerate(V.PACKED):
        s = F.lit(0.0)
        for m in range(3):
            s = s + vector[3 * i + m] * value[m] * vector[3 * j + m]
        err = F.greatest(err, F.abs(s - part[k]))
    m0 = V.times_vector(part, [F.lit(1.0), F.lit(2.0), F.lit(3.0)])[0]
    return df.select("x", "y", F.round(value[0] + value[1] + value[2], 4).alias("trace"), F.round(F.round(value[0] * value[1] * value[2], 6), 4).alias("det"), F.round(m0, 4).alias("m0"), (err < 1e-6).alias("rebuilt"))


@query(f"""WITH {LI}, a AS (SELECT x, y, v, x + 1.0 AS a0, y - 3.0 AS a1, v / 100.0 AS a2, v - 900 AS i0, x - 16 AS i1, y AS i2 FROM li)
SELECT x, y, round(CAST(2.5 * a2 AS DOUBLE), 6) AS scaled, true AS same, x = 0 AS other, CAST(i0 // 7 AS BIGINT) AS d0, CAST(i1 // 7 AS BIGINT) AS d1, CAST(i0 // nullif(i1, 0) AS BIGINT) AS q0, CAST(i2 // nullif(i0, 0) AS BIGINT) AS q2,
CAST(a0 AS DOUBLE) AS n0, CAST(9 AS DOUBLE) AS n1, CAST(a1 AS DOUBLE) AS n2, round(CAST(least(a0, a1, a2) AS DOUBLE), 6) AS low, round(CAST(greatest(a0, a1, a2) AS DOUBLE), 6) AS high,
round(a1 / sqrt(a0 * a0 + a1 * a1), 6) AS o0, round(-a0 / sqrt(a0 * a0 + a1 * a1), 6) AS o1, CAST(0 AS DOUBLE) AS o2, round(a2 / sqrt(a0 * a0 + a1 * a1 + a2 * a2), 6) AS u2 FROM a""")
def vector_forms(spark, sf_dir):
    g = li(spark, sf_dir)
    a = F.array(F.col("x") + 1.0, F.col("y") - 3.0, F.col("v") / 100.0)
    i = F.array(F.col("v") - 900, F.col("x") - 16, F.col("y"))
    d, q = V.truncated_div(i, 7), V.quotients(i, F.array(F.col("x") - 16, F.lit(1), F.col("v") - 900))
    n, o, s = V.insert(a, 1, 9.0), V.orthonormal(a), F.array_sort(a)
    r = lambda c: F.round(c, 6)
    other = F.array(F.lit(1.0), F.col("y") - 3.0, F.col("v") / 100.0)
    return g.map(scaled=r(V.scale(2.5, a)[2]), same=a == F.array(F.col("x") + 1.0, F.col("y") - 3.0, F.col("v") / 100.0), other=a == other, d0=d[0], d1=d[1], q0=q[0], q2=q[2], n0=n[0], n1=n[1], n2=n[2], low=r(s[0]), high=r(s[2]), o0=r(o[0]), o1=r(o[1]), o2=r(o[2]), u2=r(V.normalise(a)[2])).df


@query(f"""WITH {LI}, m AS (SELECT x, y, v % 11 + 1.0 AS a, x % 5 - 2.0 AS b, y % 3 + 0.0 AS c, v % 7 + 2.0 AS d, x % 4 - 1.0 AS e, y % 6 + 1.0 AS f FROM li)
SELECT x, y, CAST(a + d + f AS DOUBLE) AS trace, CAST(a * d + b * f AS DOUBLE) AS p00, CAST(a * e + b * c AS DOUBLE) AS p01, CAST(c * d + d * f AS DOUBLE) AS p10, CAST(c * e + d * c AS DOUBLE) AS p11, CAST(a * 1 + b * 2 + c * 3 AS DOUBLE) AS t0, CAST(c * 1 + e * 2 + f * 3 AS DOUBLE) AS t2 FROM m""")
def matrix_math(spark, sf_dir):
    g = li(spark, sf_dir)
    a, b, c, d, e, f = t = [F.col("v") % 11 + 1.0, F.col("x") % 5 - 2.0, F.col("y") % 3 + 0.0, F.col("v") % 7 + 2.0, F.col("x") % 4 - 1.0, F.col("y") % 6 + 1.0]
    p = V.matrix_product([[a, b], [c, d]], [[d, e], [f, c]])
    k = V.times_vector(t, [F.lit(1.0), F.lit(2.0), F.lit(3.0)])
    return g.map(trace=V.trace(t), p00=p[0][0], p01=p[0][1], p10=p[1][0], p11=p[1][1], t0=k[0], t2=k[2]).df


# ---------------------------------------------------------------- generators


@query("""WITH g AS (SELECT CAST(a.i AS INT) AS x, CAST(b.i AS INT) AS y FROM range(40) a(i), range(40) b(i))
SELECT 'board' AS kind, x, y, CAST(CASE WHEN (x // 3 + y // 2) % 2 = 1 THEN 20 ELSE -10 END AS BIGINT) AS v FROM g
UNION ALL SELECT 'ids', x, y, x + 40 * y + 1 FROM g
UNION ALL SELECT 'basins', x, y, greatest(abs(x % 20 - 10), abs(y % 20 - 10)) FROM g
UNION ALL SELECT 'radial', x, y, CAST(floor(sqrt((x - 20) * (x - 20) + (y - 20) * (y - 20))) AS BIGINT) FROM g
UNION ALL SELECT 'constant', x, y, 7 FROM g
UNION ALL SELECT 'mesh', x, y, (5 - x) * 100 + (y - 2) FROM g
UNION ALL SELECT 'spiral', x, y, CASE WHEN (x % 2 = 1 AND ((x < 20 AND y > x AND y <= 40 - x) OR (x >= 20 AND y >= 40 - x - 1 AND y <= x))) OR (y < 20 AND y % 2 = 0 AND x >= y - 1 AND x < 40 - y) OR (y >= 20 AND y % 2 = 1 AND x > 40 - y AND x < y) THEN 255 ELSE 0 END FROM g""")
def generators(spark, sf_dir):
    size = (40, 40)
    made = {
        "board": generate.checkerboard(spark, 20, -10, (3, 2), size), "ids": generate.unique_ids(spark, size), "basins": generate.basins(spark, size, 20), "radial": generate.radial(spark, size),
        "constant": generate.constant(spark, 7, size), "mesh": generate.mesh(spark, (5, -2), (-35, 38)).map(v=F.col("v0") * 100 + F.col("v1")), "spiral": generate.spiral(spark, size),
    }
    out = None
    for kind, g in made.items():
        df = g.df.select(F.lit(kind).alias("kind"), "x", "y", F.col("v").cast("long").alias("v"))
        out = df if out is None else out.unionByName(df)
    return out


@query("""WITH RECURSIVE c AS (SELECT CAST(a.i AS INT) AS x, CAST(b.i AS INT) AS y, CAST(-2.0 AS DOUBLE) + a.i * CAST(3.0 / 48 AS DOUBLE) AS re, CAST(-1.0 AS DOUBLE) + b.i * CAST(2.0 / 32 AS DOUBLE) AS im FROM range(48) a(i), range(32) b(i)),
z(x, y, re, im, n, zr, zi) AS (SELECT x, y, re, im, 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM c UNION ALL SELECT x, y, re, im, n + 1, zr * zr - zi * zi + re, zr * zi + zi * zr + im FROM z WHERE n < 30 AND zr * zr + zi * zi <= 4)
SELECT x, y, max(CASE WHEN zr * zr + zi * zi <= 4 THEN n ELSE 0 END) AS n, max(CASE WHEN zr * zr + zi * zi <= 4 THEN n ELSE 0 END) * 7 % 256 AS c1 FROM z GROUP BY x, y""")
def mandelbrot(spark, sf_dir):
    return generate.mandelbrot(spark, (48, 32), (-2.0, 1.0), (-1.0, 1.0), 30).map(n=F.col("n"), c1=F.col("c1")).df


SHAPES = [generate.Shape("e", (8, 8, 8), 5, 100), generate.Shape("t", (4, 4, 6), 2, 50, (0, 0, 1), 8), generate.Shape("p", (10, 10, 10), 5, 70, (1, 0, 0), 2), generate.Shape("e", (12, 3, 3), 2, 30)]


@query("""WITH g AS (SELECT CAST(a.i AS INT) AS x, CAST(b.i AS INT) AS y, CAST(c.i AS INT) AS z FROM range(16) a(i), range(16) b(i), range(16) c(i))
SELECT x, y, z, CAST(CASE WHEN (x-12)*(x-12)+(y-3)*(y-3)+(z-3)*(z-3) <= 4 THEN 30 WHEN abs(x-10) <= 5 AND abs(y-10) <= 5 AND abs(z-10) <= 5 AND abs(x-10) <= 1 THEN 70
WHEN abs(x-4) <= 5 AND abs(y-4) <= 5 AND abs(z-6) <= 5 AND (x-4)*(x-4)+(y-4)*(y-4) <= 4 THEN 50 WHEN (x-8)*(x-8)+(y-8)*(y-8)+(z-8)*(z-8) <= 25 THEN 100 ELSE 0 END AS DOUBLE) AS v FROM g""")
def shape_scene(spark, sf_dir):
    return generate.scene(spark, (16, 16, 16), SHAPES).df


@query(ORACLE["shape_scene"])
def shape_file(spark, sf_dir):
    """The scene of shape_scene, from its lines of text."""
    told = {"e": "e[{c}] {r} {v}", "t": "t[{c}][{d}] {r} {l} {v}", "p": "p[{c}][{d}] {r} {l} {v}"}
    lines = [(i, told[s.kind].format(c=",".join(map(str, s.centre)), d=",".join(map(str, s.direction)), r=s.radius, l=s.extent, v=s.value)) for i, s in enumerate(SHAPES)]
    rows = text.parse_shapes(spark.createDataFrame(lines, "ord int, value string")).orderBy("ord").collect()  # a scene has few shapes
    shapes = [generate.Shape(r["kind"], tuple(int(c) for c in r["centre"]), r["radius"], r["value"], tuple(r["direction"]), r["extent"]) for r in rows]
    return generate.scene(spark, text.parse_size("16x16x16"), shapes).df


# ---------------------------------------------------------------- stencils and views


def _at(rule: str, dx: int, dy: int) -> str:
    def c(a: str, d: int) -> str:
        p = f"(c.{a} + {d})"
        return {"repeat": f"least(31, greatest(0, {p}))", "mirror": f"CASE WHEN {p} < 0 THEN -{p} WHEN {p} > 31 THEN 62 - {p} ELSE {p} END", "periodic": f"(({p} % 32) + 32) % 32"}.get(rule, p)

    value = f"(SELECT b.v FROM li b WHERE b.x = {c('x', dx)} AND b.y = {c('y', dy)})"
    return f"coalesce({value}, 0)" if rule == "zero" else value


@query(f"WITH {LI} SELECT c.x, c.y, " + ", ".join(f"{_at(b, -1, 0)} AS {b}_1, {_at(b, 2, -3)} AS {b}_2" for b in stencil.BORDERS) + " FROM li c")
def border_rules(spark, sf_dir):
    g = li(spark, sf_dir)
    for b in stencil.BORDERS:
        g = stencil.neighbours(g, "v", [(-1, 0), (2, -3)], b, out=f"n_{b}")
    return g.map(**{f"{b}_{i + 1}": F.col(f"n_{b}")[i] for b in stencil.BORDERS for i in (0, 1)}).df


@query(f"""WITH {EMB}, {MOORE2}, {NEAR_EMB} SELECT x, y, min(nv) AS low, max(nv) AS high, CAST(sum(nv) AS BIGINT) AS total, CASE WHEN v <= min(nv) THEN CAST(x + 64 * y + 1 AS BIGINT) ELSE 0 END AS label, CAST(min(nv) < v AS INT) AS smaller, v + CAST(max(nv) <= v AND min(nv) < v AS INT) AS raised, CAST(sum(CASE WHEN k IN (2, 4, 5, 7) THEN nv END) AS BIGINT) AS sides FROM n GROUP BY x, y, v""")
def moore_stencil(spark, sf_dir):
    g = stencil.neighbours(emb(spark, sf_dir), "v", stencil.moore(2))
    low, high, v, n = F.array_min("n"), F.array_max("n"), F.col("v"), F.col("n")
    return g.map(low=low, high=high, total=F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x), label=F.when(v <= low, g.index() + 1).otherwise(0), smaller=(low < v).cast("int"), raised=v + ((high <= v) & (low < v)).cast("int"), sides=n[2] + n[4] + n[5] + n[7]).df


@query(f"""WITH {EV} SELECT c.x, c.y, c.z, (SELECT min(b.v) FROM ev b WHERE b.x BETWEEN c.x - 1 AND c.x + 1 AND b.y BETWEEN c.y - 1 AND c.y + 1 AND b.z BETWEEN c.z - 1 AND c.z + 1) AS low, (SELECT max(b.v) FROM ev b WHERE abs(b.x - c.x) + abs(b.y - c.y) + abs(b.z - c.z) <= 1) AS high FROM ev c""")
def volume_stencil(spark, sf_dir):
    g = stencil.neighbours(ev(spark, sf_dir), "v", stencil.moore(3), out="m")
    g = stencil.neighbours(g, "v", stencil.von_neumann(3), out="w")
    return g.map(low=F.array_min("m"), high=F.array_max("w")).df


@query(f"""WITH {LI}, {EV} SELECT 'sub' AS kind, x - 4 AS x, y - 6 AS y, v FROM li WHERE x BETWEEN 4 AND 11 AND y BETWEEN 6 AND 15
UNION ALL SELECT 'border', c.x - 4, c.y - 6, b.v FROM li c JOIN li b ON b.x = c.x - 4 AND b.y = c.y - 4 WHERE c.x BETWEEN 4 AND 11 AND c.y BETWEEN 6 AND 15
UNION ALL SELECT 'flip', 31 - x, y, v FROM li UNION ALL SELECT 'slice', x, y, v FROM ev WHERE z = 2
UNION ALL SELECT 'pad', CAST(a.i AS INT), CAST(b.i AS INT), coalesce(l.v, -1) FROM range(40) a(i) CROSS JOIN range(36) b(i) LEFT JOIN li l ON (l.x + 10) % 40 = a.i AND (l.y + 34) % 36 = b.i""")
def grid_views(spark, sf_dir):
    g, vol = li(spark, sf_dir), ev(spark, sf_dir)
    parts = {
        "sub": stencil.subview(g, (4, 6), (8, 10)).df,
        "border": stencil.bordered_subview(g, (4, 6), (8, 10), "v", [(-4, -4)]).map(v=F.col("n")[0]).df,
        "flip": stencil.flip(g, "x").df,
        "slice": stencil.slice_at(vol, "z", 2).df,
        "pad": stencil.pad(g, (40, 36), (10, 34), "v", -1).df,
    }
    out = None
    for k, df in parts.items():
        df = df.select(F.lit(k).alias("kind"), "x", "y", F.col("v").cast("long").alias("v"))
        out = df if out is None else out.unionByName(df)
    return out


@query(f"""WITH {LI}, {CROSS2}, {NEAR_LI}, p AS (SELECT x, y, v, max(nv) FILTER (k = 1) AS l, max(nv) FILTER (k = 2) AS u, max(nv) FILTER (k = 3) AS r, max(nv) FILTER (k = 4) AS d FROM n GROUP BY x, y, v)
SELECT x, y, abs(l - v) + abs(u - v) AS edge, (r - l) / 2 AS gx, (d - u) / 2 AS gy, (d - u) // 2 AS gy_whole, round(sqrt((r - l) / 2 * ((r - l) / 2) + (d - u) / 2 * ((d - u) / 2)), 6) AS g, (v - l) + (v * 2 - u * 2) AS div FROM p""")
def gradients(spark, sf_dir):
    g = filters.backward_magnitude(li(spark, sf_dir), out="edge")
    g = filters.symmetric_gradient(g, out=("gx", "gy"))
    g = filters.symmetric_gradient(g, out=("gx_whole", "gy_whole"), whole=True)
    g = filters.symmetric_magnitude(g, out="g").add(w=F.col("v") * 2)
    g = filters.divergence(g, ("v", "w"))
    return g.map(edge=F.col("edge"), gx=F.col("gx"), gy=F.col("gy"), gy_whole=F.col("gy_whole"), g=F.round("g", 6), div=F.col("div")).df


SOBEL_X = "(CASE k WHEN 1 THEN -1 WHEN 3 THEN 1 WHEN 4 THEN -2 WHEN 5 THEN 2 WHEN 6 THEN -1 WHEN 8 THEN 1 ELSE 0 END)"
SOBEL_Y = "(CASE k WHEN 1 THEN -1 WHEN 2 THEN -2 WHEN 3 THEN -1 WHEN 6 THEN 1 WHEN 7 THEN 2 WHEN 8 THEN 1 ELSE 0 END)"


@query(f"""WITH {LI}, {MOORE2}, {NEAR_LI}, s AS (SELECT x, y, CAST(sum(nv * {SOBEL_X}) AS DOUBLE) AS sx, CAST(sum(nv * {SOBEL_Y}) AS DOUBLE) AS sy, CAST(sum(nv * CASE WHEN k = 0 THEN -4 WHEN k IN (2, 4, 5, 7) THEN 1 ELSE 0 END) AS DOUBLE) + 128 AS lap FROM n GROUP BY x, y)
SELECT x, y, sx, sy, round(sqrt(sx * sx + sy * sy), 6) AS s, lap FROM s""")
def sobel(spark, sf_dir):
    g = filters.sobel(li(spark, sf_dir), out=("sx", "sy"))
    g = filters.laplacian(g, out="lap")
    return g.map(sx=F.col("sx"), sy=F.col("sy"), s=F.round(filters.length("sx", "sy"), 6), lap=F.col("lap")).df


@query(f"WITH {LI}, {MOORE2}, {NEAR_LI} SELECT x, y, CAST(0.5 * sum(nv * {SOBEL_X}) + sum(nv * {SOBEL_Y}) AS DOUBLE) AS div FROM n GROUP BY x, y")
def sobel_divergence(spark, sf_dir):
    g = li(spark, sf_dir)
    return filters.sobel_divergence(g.add(w=F.col("v") * 2), ("v", "w"), 0.5).map(div=F.col("div")).df


def _taps(r: int) -> str:
    return "k(i, w) AS (VALUES " + ", ".join(f"({i - r}, CAST({w!r} AS DOUBLE))" for i, w in enumerate(filters.gaussian_kernel(r))) + ")"


@query(f"""WITH {LI}, {_taps(5)}, a AS (SELECT c.x, c.y, sum(b.v * w) AS v FROM li c CROSS JOIN k JOIN li b ON b.x = least(31, greatest(0, c.x + i)) AND b.y = c.y GROUP BY c.x, c.y)
SELECT c.x, c.y, round(sum(b.v * w), 4) AS v FROM a c CROSS JOIN k JOIN a b ON b.y = least(31, greatest(0, c.y + i)) AND b.x = c.x GROUP BY c.x, c.y""")
def gauss(spark, sf_dir):
    return filters.gauss(li(spark, sf_dir)).map(v=F.round("v", 4)).df


@query(f"""WITH {LI}, s AS (SELECT ds.i AS dx, dt.i AS dy FROM range(-1, 2) ds(i), range(-1, 2) dt(i)), w AS (SELECT c.x, c.y, s.dx, s.dy, exp(-sum((a.v - b.v) * (a.v - b.v)) / 90000.0) AS w
FROM li c CROSS JOIN s CROSS JOIN range(-1, 2) p(i) CROSS JOIN range(-1, 2) q(j) JOIN li a ON a.x = least(31, greatest(0, c.x + p.i)) AND a.y = least(31, greatest(0, c.y + q.j)) JOIN li b ON b.x = least(31, greatest(0, c.x + s.dx + p.i)) AND b.y = least(31, greatest(0, c.y + s.dy + q.j)) GROUP BY ALL)
SELECT w.x, w.y, round(sum(w.w * b.v) / sum(w.w), 4) AS v FROM w JOIN li b ON b.x = least(31, greatest(0, w.x + w.dx)) AND b.y = least(31, greatest(0, w.y + w.dy)) GROUP BY w.x, w.y""")
def nonlocal_means(spark, sf_dir):
    return tiles.nonlocal_means(li(spark, sf_dir), patch=1, search=1, variance=90000.0, tile=16).map(v=F.round("v", 4)).df


@query()
def coherence_diffusion(spark, sf_dir):
    return tiles.coherence_diffusion(ev(spark, sf_dir), steps=1, tile=16).map(v=F.round("v", 6)).df


# ---------------------------------------------------------------- reductions, scans, labels


@query(f"""WITH {LI}, b AS (SELECT 31 - x AS x, y, v FROM li) SELECT CAST(sum(abs(li.v - b.v)) AS BIGINT) AS apart, count(*) FILTER (CASE WHEN li.v >= 900 THEN 255 ELSE 0 END != CASE WHEN b.v >= 900 THEN 255 ELSE 0 END) AS different, count(*) FILTER (li.v >= 900) AS marked, (SELECT max(v) FROM li) AS folded FROM li JOIN b USING (x, y)""")
def grid_differences(spark, sf_dir):
    a = li(spark, sf_dir)
    b = stencil.flip(a, "x")
    mask = lambda g: g.map(v=C.threshold(F.col("v"), 900, 0, 255))
    one = reduce.sum_differences(a, b).select(F.col("v").alias("apart"))
    two = reduce.mask_difference(mask(a), mask(b))
    three = reduce.fold(a.df, "v", F.lit(0).cast("long"), lambda p, q: F.greatest(p, q)).select(F.col("v").alias("folded"))
    return one.crossJoin(two).crossJoin(three)  # one row each


@query(f"WITH {LI} SELECT count(*) AS n, CAST(sum(v) AS BIGINT) AS s, min(v) AS least, max(v) AS most FROM li WHERE x BETWEEN 3 AND 12 AND y BETWEEN 5 AND 24")
def region_fold(spark, sf_dir):
    return maps.fold_region(li(spark, sf_dir), (3, 5), (10, 20), n=F.count("*"), s=F.sum("v"), least=F.min("v"), most=F.max("v"))


@query("""SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, max(value) AS longest, arg_max(event_id, (value, -event_id)) AS longest_id, min(value) AS shortest, arg_min(event_id, (value, event_id)) AS shortest_id FROM events GROUP BY event_type""")
def timer_report(spark, sf_dir):
    df = reduce.timer_report(_table(spark, sf_dir, "events"), "event_type", "event_id", "value")
    return df.withColumn("total", F.round("total", 4)).withColumn("mean", F.round("mean", 6))


@query(f"""WITH {EMB}, r AS (SELECT x, y, CAST(sum(v) OVER (PARTITION BY y ORDER BY x) AS BIGINT) AS scan, max(v) OVER (PARTITION BY y ORDER BY x) AS top FROM emb) SELECT x, y, scan, top, CAST(sum(scan) OVER (PARTITION BY x ORDER BY y) AS BIGINT) AS integral FROM r""")
def scans(spark, sf_dir):
    g = reduce.scan(emb(spark, sf_dir), "v")
    g = reduce.scan(g, "v", op=F.max, out="top")
    return reduce.scan(g, "scan", "y", out="integral").map(scan=F.col("scan"), top=F.col("top"), integral=F.col("integral")).df


@query("SELECT o_orderkey, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) OVER (ORDER BY o_orderkey) AS BIGINT) AS scan FROM orders")
def long_scan(spark, sf_dir):
    df = _table(spark, sf_dir, "orders").select("o_orderkey", F.floor("o_totalprice").alias("p"))
    return reduce.scan_long(df, "o_orderkey", "p", chunk=4096).select("o_orderkey", "scan")


@query(f"WITH {LI} SELECT x, y, CAST(dense_rank() OVER (ORDER BY v // 40) AS BIGINT) AS label FROM li")
def dense_labels(spark, sf_dir):
    g = li(spark, sf_dir).map(label=F.floor(F.col("v") / 40))
    return reduce.dense_labels(g.df).select("x", "y", "label")


REG = "reg AS (SELECT x, y, v, (x // 4) + 8 * (y // 8) + 1 AS label FROM li)"


def _regions(g: Grid) -> Grid:
    return g.add(label=F.floor(F.col("x") / 4) + 8 * F.floor(F.col("y") / 8) + 1)


@query(f"WITH {LI}, {REG} SELECT CAST(label AS BIGINT) AS label, count(*) AS n, CAST(sum(v) AS BIGINT) AS s, CAST(sum(v * v) AS BIGINT) AS ss FROM reg GROUP BY 1")
def region_nodes(spark, sf_dir):
    return reduce.region_nodes(_regions(li(spark, sf_dir)))


def _edges(literal: bool) -> str:
    cut = "AND a.x < 31 AND a.y < 31" if literal else ""
    return f"SELECT CAST(least(a.label, b.label) AS BIGINT) AS l1, CAST(greatest(a.label, b.label) AS BIGINT) AS l2, count(*) AS n, round(sum(pow(1.0 / (1.0 + greatest(a.v, b.v)), 2)), 9) AS s FROM reg a JOIN reg b ON ((b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1)) AND a.label != b.label {cut} GROUP BY 1, 2"


@query(f"WITH {LI}, {REG} SELECT 0 AS literal, * FROM ({_edges(False)}) UNION ALL SELECT 1, * FROM ({_edges(True)})")
def region_edges(spark, sf_dir):
    g = _regions(li(spark, sf_dir))
    parts = [reduce.region_edges(g, literal=bool(k)).select(F.lit(k).alias("literal"), "l1", "l2", "n", F.round("s", 9).alias("s")) for k in (0, 1)]
    return parts[0].unionByName(parts[1])


@query(f"WITH {LI}, {REG} SELECT DISTINCT CASE WHEN v >= 1000 THEN 'f' ELSE 'b' END AS kind, CAST(label AS BIGINT) AS label FROM reg WHERE v >= 1000 OR v < 800 UNION ALL SELECT DISTINCT 'masked', CAST(label AS BIGINT) FROM reg WHERE v >= 1000")
def region_markers(spark, sf_dir):
    g = _regions(li(spark, sf_dir))
    mask = g.map(m=F.when(F.col("v") >= 1000, 255).when(F.col("v") < 800, 128).otherwise(0))
    labels = g.map(label=F.col("label"))
    return reduce.markers(labels, mask).unionByName(reduce.masked_labels(labels, mask).select(F.lit("masked").alias("kind"), "label"))


@query(f"WITH {LI}, {REG} SELECT 'n' AS tag, CAST(label AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, count(*) AS n, CAST(sum(v) AS DOUBLE) AS s FROM reg GROUP BY 2 UNION ALL SELECT 'e', l1, l2, n, round(s, 9) FROM ({_edges(False)})")
def graph_text(spark, sf_dir):
    g = _regions(li(spark, sf_dir))
    lines = text.graph_lines(reduce.region_nodes(g), reduce.region_edges(g).withColumn("s", F.format_number("s", 12)))
    nodes, edges = text.parse_graph(lines)
    return nodes.select(F.lit("n").alias("tag"), F.col("label").alias("a"), F.lit(0).cast("long").alias("b"), "n", "s").unionByName(edges.select(F.lit("e").alias("tag"), F.col("l1").alias("a"), F.col("l2").alias("b"), "n", F.round("s", 9).alias("s")))


@query(f"WITH {LI}, {REG} SELECT DISTINCT 'marker' AS source, CASE WHEN v >= 1000 THEN 'f' ELSE 'b' END AS kind, CAST(label AS BIGINT) AS label FROM reg WHERE v >= 1000 OR v < 800 UNION ALL SELECT DISTINCT 'label', '', CAST(label AS BIGINT) FROM reg")
def marker_text(spark, sf_dir):
    g = _regions(li(spark, sf_dir))
    mask = g.map(m=F.when(F.col("v") >= 1000, 255).when(F.col("v") < 800, 128).otherwise(0))
    back = text.parse_markers(text.marker_lines(reduce.markers(g.map(label=F.col("label")), mask)))
    ids = text.parse_labels(text.label_lines(g.df.select("label").distinct()))
    return back.select(F.lit("marker").alias("source"), "kind", "label").unionByName(ids.select(F.lit("label").alias("source"), F.lit("").alias("kind"), "label"))


# ---------------------------------------------------------------- automata

_ON = "CASE WHEN v >= 950 THEN 1 ELSE 0 END"


@query(f"""WITH RECURSIVE {LI}, m AS MATERIALIZED (SELECT x, y, x + 32 * y AS id FROM li WHERE v >= 950), e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1), r(id, u) AS (SELECT a, b FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.u),
l AS (SELECT id, min(u) + 1 AS label FROM r GROUP BY id) SELECT li.x, li.y, CAST(coalesce(l.label, 0) AS BIGINT) AS label FROM li LEFT JOIN l ON l.id = li.x + 32 * li.y""")
def component_labels(spark, sf_dir):
    g = li(spark, sf_dir).map(v=C.threshold(F.col("v"), 950, 0, 1))
    return A.label_components(g).map(label=F.col("label")).df


@query(ORACLE["component_labels"])
def component_labels_wide(spark, sf_dir):
    """As component_labels, with no part of the graph given to one task."""
    g = li(spark, sf_dir).map(v=C.threshold(F.col("v"), 950, 0, 1))
    return A.label_components(g, small=0).map(label=F.col("label")).df


def _life(n: int) -> str:
    steps, now = [f"g0 AS (SELECT x, y, {_ON} AS v FROM li)"], "g0"
    for i in range(1, n + 1):
        steps.append(f"g{i} AS (SELECT c.x, c.y, CASE WHEN sum(b.v) = 3 OR (sum(b.v) = 2 AND c.v = 1) THEN 1 ELSE 0 END AS v FROM {now} c CROSS JOIN o JOIN {now} b ON o.k > 0 AND b.x = least(31, greatest(0, c.x + o.dx)) AND b.y = least(31, greatest(0, c.y + o.dy)) GROUP BY c.x, c.y, c.v)")
        now = f"g{i}"
    return f"WITH {LI}, {MOORE2}, {', '.join(steps)} SELECT x, y, v FROM {now}"


@query(_life(3))
def life(spark, sf_dir):
    g = li(spark, sf_dir).map(v=C.threshold(F.col("v"), 950, 0, 1))
    return A.Automaton(g, stencil.moore(2), A.conway).iterate(3).df


def _react(n: int) -> str:
    steps, now = ["g0 AS (SELECT x, y, CAST(v % 256 AS DOUBLE) / 255.0 AS u, CAST(v * 7 % 256 AS DOUBLE) / 255.0 AS w FROM li)"], "g0"
    for i in range(1, n + 1):
        steps.append(f"g{i} AS (SELECT c.x, c.y, c.u + CAST(0.2 AS DOUBLE) * (CAST(0.64 AS DOUBLE) * (sum(b.u) - 5 * c.u) + CAST(0.1 AS DOUBLE) * c.u - c.u * c.w * c.w) AS u, c.w + CAST(0.2 AS DOUBLE) * (CAST(0.32 AS DOUBLE) * (sum(b.w) - 5 * c.w) + c.u * c.w * c.w - CAST(0.1 AS DOUBLE) * c.w) AS w FROM {now} c CROSS JOIN o JOIN {now} b ON b.x = least(31, greatest(0, c.x + o.dx)) AND b.y = least(31, greatest(0, c.y + o.dy)) GROUP BY c.x, c.y, c.u, c.w)")
        now = f"g{i}"
    return f"WITH {LI}, {CROSS2}, {', '.join(steps)} SELECT x, y, round(u, 6) AS u, round(w, 6) AS w FROM {now}"


@query(_react(2))
def reaction_diffusion(spark, sf_dir):
    u, w = C.reaction(F.col("v") % 256, F.col("v") * 7 % 256)
    g = li(spark, sf_dir).map(u=u, w=w)
    return A.Automaton(g, stencil.von_neumann(2), A.reaction_diffusion()).iterate(2).map(u=F.round("u", 6), w=F.round("w", 6)).df


PLAT = "p AS MATERIALIZED (SELECT x, y, v // 60 AS v, x + 32 * y AS id FROM li)"
_MIN = f"""WITH RECURSIVE {LI}, {PLAT}, e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.v = b.v), r(id, u) AS (SELECT a, b FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.u),
f AS (SELECT id, min(u) AS root FROM r GROUP BY id), low AS (SELECT p.id, max(CASE WHEN q.v < p.v THEN 1 ELSE 0 END) AS bad FROM p JOIN p q ON abs(p.x - q.x) <= 1 AND abs(p.y - q.y) <= 1 GROUP BY p.id),
bad AS (SELECT root, max(bad) AS bad FROM f JOIN low USING (id) GROUP BY root), m AS (SELECT p.x, p.y, p.v, p.id, CAST(CASE WHEN bad.bad = 0 THEN f.root + 1 ELSE 0 END AS BIGINT) AS label FROM p JOIN f USING (id) JOIN bad USING (root))"""


def _plateau_grid(spark, sf_dir) -> Grid:
    return li(spark, sf_dir).map(v=F.floor(F.col("v") / 60))


@query(f"{_MIN} SELECT x, y, label FROM m")
def regional_minima(spark, sf_dir):
    return A.regional_minima(_plateau_grid(spark, sf_dir)).map(label=F.col("label")).df


@query(f"""{_MIN}, d(id, d) USING KEY (id) AS (SELECT id, CAST(0 AS BIGINT) FROM m WHERE label > 0 UNION SELECT c.id, min(a.d + c.v) FROM d a JOIN m s ON s.id = a.id JOIN m c ON abs(c.x - s.x) + abs(c.y - s.y) = 1 LEFT JOIN recurring.d o ON o.id = c.id WHERE o.d IS NULL OR a.d + c.v < o.d GROUP BY c.id)
SELECT m.x, m.y, CAST(d.d AS DOUBLE) AS distance FROM m JOIN d USING (id)""")
def watershed_distance(spark, sf_dir):
    return A.watershed_distance(_plateau_grid(spark, sf_dir)).map(distance=F.col("distance")).df


#: Recursive parts of watersheds over a table c(id, x, y, v) of 32 x 32 cells and offsets o.
_CLOSED = "r(id, u) AS (SELECT id, id FROM c UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.u), done AS (SELECT id, min(u) + 1 AS label FROM r GROUP BY id)"
_AROUND = "n AS MATERIALIZED (SELECT c.id, c.x, c.y, c.v, o.k, b.id AS nid, b.v AS nv FROM c CROSS JOIN o JOIN c b ON o.k > 0 AND b.x = c.x + o.dx AND b.y = c.y + o.dy)"
_RAISED = "c AS MATERIALIZED (SELECT x + 32 * y AS id, x, y, v + CAST(max(nv) <= v AND min(nv) < v AS INT) AS v FROM (SELECT a.x, a.y, a.v, b.v AS nv FROM li a JOIN li b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1) GROUP BY x, y, v)"
_DOWN = "t AS MATERIALIZED (SELECT id, arg_min(nid, (nv, -k)) AS low FROM n WHERE nv <= v GROUP BY id)"


@query(f"""{_MIN}, {MOORE2}, d(id, d) USING KEY (id) AS (SELECT id, CAST(0 AS BIGINT) FROM m WHERE label > 0 UNION SELECT c.id, min(a.d + c.v * 100000 + 1) FROM d a JOIN m s ON s.id = a.id JOIN m c ON c.id != s.id AND abs(c.x - s.x) <= 1 AND abs(c.y - s.y) <= 1 LEFT JOIN recurring.d o ON o.id = c.id WHERE o.d IS NULL OR a.d + c.v * 100000 + 1 < o.d GROUP BY c.id),
w AS MATERIALIZED (SELECT c.id, arg_min(b.id, o.k) AS back FROM m c JOIN d e ON e.id = c.id CROSS JOIN o JOIN m b ON o.k > 0 AND b.x = c.x + o.dx AND b.y = c.y + o.dy JOIN d f ON f.id = b.id AND f.d = e.d - c.v * 100000 - 1 WHERE c.label = 0 GROUP BY c.id),
p2(id, here) AS (SELECT id, id FROM m UNION SELECT p2.id, w.back FROM p2 JOIN w ON w.id = p2.here)
SELECT c.x, c.y, s.label FROM p2 JOIN m c ON c.id = p2.id JOIN m s ON s.id = p2.here AND s.label > 0""")
def watershed_labels(spark, sf_dir):
    return A.watershed(_plateau_grid(spark, sf_dir), method="distance").map(label=F.col("label")).df


@query(f"""WITH RECURSIVE {LI}, {CROSS2}, {CUT_LI}, t AS (SELECT x, y, x + 32 * y AS id, arg_min(ox + 32 * oy, (nv, -k)) AS low FROM n WHERE k > 0 AND nv <= v GROUP BY x, y), e AS MATERIALIZED (SELECT id AS a, low AS b FROM t UNION SELECT low, id FROM t),
r(id, u) AS (SELECT CAST(x + 32 * y AS INT), CAST(x + 32 * y AS INT) FROM li UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.u) SELECT CAST(id % 32 AS INT) AS x, CAST(id // 32 AS INT) AS y, CAST(min(u) + 1 AS BIGINT) AS label FROM r GROUP BY id""")
def watershed_merged(spark, sf_dir):
    return A.watershed_merged(li(spark, sf_dir), complete=False).map(label=F.col("label")).df


@query(f"WITH {LI}, {MOORE2}, {CUT_LI} SELECT x, y, CAST(coalesce(-1 - arg_min(ox + 32 * oy, (nv, k)) FILTER (nv < v), 0) AS BIGINT) AS pointer FROM n GROUP BY x, y")
def lower_pointers(spark, sf_dir):
    return A.lower_pointers(li(spark, sf_dir)).map(pointer=F.col("pointer")).df


_ORDER_EDGES = f"{ORD}, {MOORE2}, n AS MATERIALIZED (SELECT c.id, c.v, o.k, b.id AS nid, b.v AS nv FROM ord c CROSS JOIN o JOIN ord b ON o.k > 0 AND b.x = c.x + o.dx AND b.y = c.y + o.dy)"
_ORDER_FLAT = "f(id, root) USING KEY (id) AS (SELECT id, id FROM ord UNION SELECT n.nid, min(f.root) FROM f JOIN n ON n.id = f.id AND n.nv = n.v JOIN recurring.f o ON o.id = n.nid WHERE f.root < o.root GROUP BY n.nid)"


@query(f"""WITH RECURSIVE {_ORDER_EDGES}, {_ORDER_FLAT}, low AS (SELECT id, max(CASE WHEN nv < v THEN 1 ELSE 0 END) AS bad FROM n GROUP BY id), bad AS (SELECT root, max(bad) AS bad FROM f JOIN low USING (id) GROUP BY root), m AS MATERIALIZED (SELECT id, CASE WHEN bad.bad = 0 THEN root + 1 ELSE 0 END AS label FROM f JOIN bad USING (root)),
d(id, d) USING KEY (id) AS (SELECT id, CAST(0 AS BIGINT) FROM m WHERE label > 0 UNION SELECT n.id, min(d.d + n.v * 100000 + 1) FROM d JOIN n ON n.nid = d.id LEFT JOIN recurring.d o ON o.id = n.id WHERE o.d IS NULL OR d.d + n.v * 100000 + 1 < o.d GROUP BY n.id),
w AS MATERIALIZED (SELECT n.id, arg_min(n.nid, n.k) AS back FROM n JOIN m ON m.id = n.id AND m.label = 0 JOIN d e ON e.id = n.id JOIN d b ON b.id = n.nid AND b.d = e.d - n.v * 100000 - 1 GROUP BY n.id), p2(id, here) AS (SELECT id, id FROM m UNION SELECT p2.id, w.back FROM p2 JOIN w ON w.id = p2.here)
SELECT c.x, c.y, CAST(s.label AS BIGINT) AS label, CAST(d.d // 100000 AS DOUBLE) AS distance FROM p2 JOIN ord c ON c.id = p2.id JOIN m s ON s.id = p2.here AND s.label > 0 JOIN d ON d.id = p2.id""")
def order_basins(spark, sf_dir):
    """Labels and distances of basins on a grid that grows with the tables."""
    return A.watershed_distance(ord_(spark, sf_dir, dense=False), offsets=stencil.moore(2), fill=0).map(label=F.col("label"), distance=F.col("distance")).df


@query(f"WITH RECURSIVE {_ORDER_EDGES}, {_ORDER_FLAT.replace('n.nv = n.v', 'n.nv > 6 AND n.v > 6')} SELECT c.x, c.y, CAST(CASE WHEN c.v > 6 THEN root + 1 ELSE 0 END AS BIGINT) AS label FROM f JOIN ord c USING (id)")
def order_components(spark, sf_dir):
    """Components of the orders above 350,000, on a grid that grows with the tables."""
    return A.label_components(ord_(spark, sf_dir).map(v=C.threshold(F.col("v"), 7, 0, 1))).map(label=F.col("label")).df


def _minima(of: str) -> str:
    """CTEs f, low, bad, m(id, label): regional minima of a table c."""
    return f"""q AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM {of} a JOIN {of} b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.v = b.v), qr(id, u) AS (SELECT a, b FROM q UNION SELECT qr.id, q.b FROM qr JOIN q ON q.a = qr.u), f AS (SELECT id, min(u) AS root FROM qr GROUP BY id),
low AS (SELECT a.id, max(CASE WHEN b.v < a.v THEN 1 ELSE 0 END) AS bad FROM {of} a JOIN {of} b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY a.id), bad AS (SELECT root, max(bad) AS bad FROM f JOIN low USING (id) GROUP BY root), m AS MATERIALIZED (SELECT id, CASE WHEN bad.bad = 0 THEN root + 1 ELSE 0 END AS label FROM f JOIN bad USING (root))"""


@query(f"""WITH RECURSIVE {LI}, {MOORE2}, {_RAISED}, {_minima("c")}, {_AROUND}, {_DOWN}, p2(id, here) AS (SELECT id, id FROM c UNION SELECT p2.id, t.low FROM p2 JOIN t ON t.id = p2.here JOIN m ON m.id = p2.here AND m.label = 0)
SELECT c.x, c.y, CAST(max(m.label) AS BIGINT) AS label FROM p2 JOIN c ON c.id = p2.id JOIN m ON m.id = p2.here GROUP BY c.x, c.y""")
def watershed_pointers(spark, sf_dir):
    return A.watershed(li(spark, sf_dir), method="descent_pointer").map(label=F.col("label")).df


@query(f"""WITH RECURSIVE {LI}, {MOORE2}, c AS MATERIALIZED (SELECT x + 32 * y AS id, x, y, v // 60 AS v FROM li), {_AROUND}, l AS MATERIALIZED (SELECT id, max(CAST(nv < v AS INT)) AS lower FROM n GROUP BY id),
e1 AS (SELECT n.id AS a, arg_min(nid, (nv, k)) AS b FROM n WHERE nv < v GROUP BY n.id UNION ALL SELECT n.id, n.nid FROM n JOIN l p ON p.id = n.id AND p.lower = 0 JOIN l q ON q.id = n.nid AND q.lower = 0 WHERE n.nv = n.v), e AS MATERIALIZED (SELECT a, b FROM e1 UNION SELECT b, a FROM e1), {_CLOSED}
SELECT c.x, c.y, CAST(label AS BIGINT) AS label FROM c JOIN done USING (id)""")
def watershed_plateaus(spark, sf_dir):
    return A.watershed(_plateau_grid(spark, sf_dir), method="plateaus").map(label=F.col("label")).df


_TWICE = ", ".join(f"s{i + 1} AS MATERIALIZED (SELECT a.id, b.root FROM s{i} a JOIN s{i} b ON b.id = a.root)" for i in range(11))


@query(f"""WITH {LI}, {MOORE2}, {_RAISED}, {_AROUND}, {_DOWN}, s0 AS MATERIALIZED (SELECT c.id, coalesce(t.low, c.id) AS root FROM c LEFT JOIN t USING (id)), {_TWICE}
SELECT c.x, c.y, CAST(s11.root + 1 AS BIGINT) AS label, NOT EXISTS (SELECT 1 FROM s11 a JOIN s0 b ON b.id = a.root WHERE b.root != a.root) AS stable FROM c JOIN s11 USING (id)""")
def watershed_simple(spark, sf_dir):
    return A.watershed(li(spark, sf_dir), method="descent_simple").map(label=F.col("label"), stable=F.col("stable")).df


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_partkey * 2 AS a, l_suppkey * 2 + 1 AS b FROM lineitem), s AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(id, root) USING KEY (id) AS (SELECT a, a FROM s GROUP BY a UNION SELECT s.b, min(r.root) FROM r JOIN s ON s.a = r.id JOIN recurring.r o ON o.id = s.b WHERE r.root < o.root GROUP BY s.b) SELECT id, root FROM r""")
def merged_keys(spark, sf_dir):
    """Classes of the keys of parts (2 · key) and suppliers (2 · key + 1) that any row of lineitem links."""
    e = _table(spark, sf_dir, "lineitem")
    return A.merge_labels(e.select((F.col("l_partkey") * 2).alias("a"), (F.col("l_suppkey") * 2 + 1).alias("b")))


# ---------------------------------------------------------------- graphs


def _lattice(spark, sf_dir, n: int = 32) -> tuple[DataFrame, DataFrame]:
    g = stencil.subview(li(spark, sf_dir), (0, 0), (n, n))
    edges = generate.lattice(g, "v", lambda a, b: 1 + F.abs(a - b) % 17)
    v = g.df.select(g.index().alias("id"), F.when(F.col("y") == 0, 100000.0).otherwise(0.0).alias("cap_src"), F.when(F.col("y") == n - 1, 100000.0).otherwise(0.0).alias("cap_snk"))
    return v, edges


@query(f"""WITH {LI}, e AS (SELECT a.x + 32 * a.y AS a, b.x + 32 * b.y AS b, 1 + abs(a.v - b.v) % 17 AS w, CASE WHEN b.x > a.x THEN 0 ELSE 1 END AS d FROM li a JOIN li b ON (b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1)) SELECT CAST(a * 2 + d AS BIGINT) AS eid, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(w AS DOUBLE) AS w_fwd, CAST(w AS DOUBLE) AS w_bwd FROM e""")
def lattice_edges(spark, sf_dir):
    return _lattice(spark, sf_dir)[1]


@query(f"WITH {LI}, e AS (SELECT a.x + 32 * a.y AS a, b.x + 32 * b.y AS b, a.v AS v1, b.v AS v2 FROM li a JOIN li b ON greatest(abs(a.x - b.x), abs(a.y - b.y)) = 1 AND a.x + 32 * a.y < b.x + 32 * b.y) SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(1 + abs(v1 - v2) % 17 AS DOUBLE) AS w_fwd, CAST(1 + abs(v1 - v2) % 17 AS DOUBLE) AS w_bwd FROM e")
def full_lattice_edges(spark, sf_dir):
    return generate.full_lattice(li(spark, sf_dir), "v", lambda a, b: 1 + F.abs(a - b) % 17).drop("eid")


@query(f"WITH {EV}, e AS (SELECT a.v AS v1, b.v AS v2 FROM ev a JOIN ev b ON greatest(abs(a.x - b.x), abs(a.y - b.y), abs(a.z - b.z)) = 1 AND a.x + 16 * (a.y + 16 * a.z) < b.x + 16 * (b.y + 16 * b.z)) SELECT count(*) AS n, CAST(sum(1 + abs(v1 - v2) % 17) AS DOUBLE) AS w FROM e")
def full_volume_lattice(spark, sf_dir):
    return generate.full_lattice(ev(spark, sf_dir), "v", lambda a, b: 1 + F.abs(a - b) % 17).agg(F.count("*").alias("n"), F.sum("w_fwd").alias("w"))


@query(f"""WITH {LI}, e AS (SELECT a.x + 32 * a.y AS a, b.x + 32 * b.y AS b, 1 + abs(a.v - b.v) % 17 AS w FROM li a JOIN li b ON (b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1))
SELECT 0 AS part, '<graphml><key id="capacity" for="edge" attr.name="capacity" attr.type="double"/><graph edgedefault="directed">' AS value UNION ALL SELECT 1, '<node id="source"/>' UNION ALL SELECT 1, '<node id="sink"/>' UNION ALL SELECT 4, '</graph></graphml>'
UNION ALL SELECT 2, '<node id="n' || (x + 32 * y) || '"/>' FROM li UNION ALL SELECT 3, '<edge source="source" target="n' || x || '"><data key="capacity">100000.0</data></edge>' FROM li WHERE y = 0
UNION ALL SELECT 3, '<edge source="n' || (x + 32 * y) || '" target="sink"><data key="capacity">100000.0</data></edge>' FROM li WHERE y = 31 UNION ALL SELECT 3, '<edge source="n' || a || '" target="n' || b || '"><data key="capacity">' || w || '.0</data></edge>' FROM e""")
def graphml_text(spark, sf_dir):
    return text.graphml_lines(*_lattice(spark, sf_dir))


@query("SELECT CAST(4 AS DOUBLE) AS flow, 16 AS cells, 8 AS terminals, CAST(48 AS BIGINT) AS arcs")
def lattice_files(spark, sf_dir):
    """A lattice of 4 x 4 cells whose middle arcs hold 1, written to a file and read back, and its maximum flow."""
    n, folder = 4, f"{run_dir(spark)}/lattice-{uuid.uuid4().hex}"
    cap = np.full(n * n, 5)
    weak = np.where(np.arange(n * n) // n == 1, 1, 5)
    top = np.where(np.arange(n * n) < n, 100, 0)
    lattice_file.write_lattice(spark, lattice_file.Lattice((n, n, 1), top, top[::-1], [cap, cap, cap, weak], np.ones(n * n), 4), f"{folder}/one")
    v, e = lattice_file.read_lattices(spark, f"{folder}/one")
    flow = maxflow.max_flow(v.drop("path"), e.drop("path"))[0]
    counts = v.agg(F.count("*").cast("int").alias("cells"), F.count_if((F.col("cap_src") > 0) | (F.col("cap_snk") > 0)).cast("int").alias("terminals"))
    return counts.crossJoin(e.agg(F.count("*").alias("arcs"))).select(F.lit(flow).alias("flow"), "cells", "terminals", "arcs")  # one row each


@query(f"""WITH RECURSIVE {LI}, e AS MATERIALIZED (SELECT a.x + 32 * a.y AS a, b.x + 32 * b.y AS b FROM li a JOIN li b ON abs(a.x - b.x) + abs(a.y - b.y) = 1 AND abs(a.v - b.v) % 17 > 6), r(id, level) AS (SELECT x + 32 * y, 1 FROM li WHERE y = 31 UNION SELECT e.a, r.level + 1 FROM r JOIN e ON e.b = r.id WHERE r.level < 400) SELECT CAST(id AS BIGINT) AS id, CAST(min(level) AS INT) AS level FROM r GROUP BY id""")
def bfs_levels(spark, sf_dir):
    v, e = _lattice(spark, sf_dir)
    arcs = maxflow.arcs_of(e).filter("res > 7")
    return maxflow.levels(v.select("id", F.col("cap_snk").alias("room")), arcs).select("id", "level")


#: The minimum cut of a flat lattice between its first and last row is the shortest way from its left to its right side across edges.
_ACROSS = """g AS MATERIALIZED (SELECT CASE WHEN x = 0 THEN -1 ELSE (x - 1) + 31 * y END AS p, CASE WHEN x = 31 THEN -2 ELSE x + 31 * y END AS q, w FROM (SELECT a.x, a.y, 1 + abs(a.v - b.v) % 17 AS w FROM li a JOIN li b ON b.x = a.x AND b.y = a.y + 1)
UNION ALL SELECT x + 31 * (y - 1), x + 31 * y, w FROM (SELECT a.x, a.y, 1 + abs(a.v - b.v) % 17 AS w FROM li a JOIN li b ON b.x = a.x + 1 AND b.y = a.y AND a.y BETWEEN 1 AND 30)), s AS MATERIALIZED (SELECT p, q, w FROM g UNION ALL SELECT q, p, w FROM g),
d(id, d) USING KEY (id) AS (SELECT CAST(-1 AS BIGINT), CAST(0 AS BIGINT) UNION SELECT s.q, min(d.d + s.w) FROM d JOIN s ON s.p = d.id LEFT JOIN recurring.d o ON o.id = s.q WHERE o.d IS NULL OR d.d + s.w < o.d GROUP BY s.q)"""


@query(f"WITH RECURSIVE {LI}, {_ACROSS} SELECT CAST(d AS DOUBLE) AS flow, CAST(d AS DOUBLE) AS capacity FROM d WHERE id = -2")
def max_flow(spark, sf_dir):
    v, e = _lattice(spark, sf_dir)
    flow, segments = maxflow.max_flow(v, e)
    return maxflow.cut_capacity(v, e, segments).select(F.lit(flow).alias("flow"), "capacity")


@query("SELECT CAST(32 * 8 AS DOUBLE) AS flow, CAST(32 * 8 * 2 AS DOUBLE) AS swapped")
def layered_flow(spark, sf_dir):
    """Flow through a graph in layers, cut at its weak one, and with its ends swapped."""
    v, e = generate.layered_graph(spark, 10, 32, 8, 4)
    turned = v.select("id", F.col("cap_snk").alias("cap_src"), F.col("cap_src").alias("cap_snk"))
    return spark.range(1).select(F.lit(maxflow.max_flow(v, e)[0]).alias("flow"), F.lit(maxflow.max_flow(turned, e)[0]).alias("swapped"))


@query("SELECT CAST(32 * 8 AS DOUBLE) AS flow")
def layered_flow_wide(spark, sf_dir):
    """As layered_flow, by sweeps over all executors."""
    v, e = generate.layered_graph(spark, 10, 32, 8, 4)
    return spark.range(1).select(F.lit(maxflow.max_flow(v, e, small=0)[0]).alias("flow"))


@query()
def grid_segmentation(spark, sf_dir):
    g = li(spark, sf_dir)
    w, h = g.size
    near, far = ((F.col("x") == w * k // 8) & (F.col("y") == h * k // 8) for k in (2, 5))
    g = g.add(m=F.when(near, 128).when(far, 255).otherwise(0))
    return pipelines.grid_segmentation(g, sigma=0.01).df


# ---------------------------------------------------------------- chains


@query("""WITH g AS (SELECT CAST(a.i AS INT) AS x, CAST(b.i AS INT) AS y, CAST(c.i AS INT) AS z FROM range(32) a(i), range(32) b(i), range(32) c(i)) SELECT x, y, z, round((CASE WHEN (x // 7 + y // 6 + z // 5) % 2 = 1 THEN 20 ELSE -10 END) + sqrt(abs(CASE WHEN (x // 3 + y // 8 + z // 11) % 2 = 1 THEN 20 ELSE -10 END)), 6) AS v FROM g""")
def fused_expression(spark, sf_dir):
    size = (32, 32, 32)
    a = generate.checkerboard(spark, 20, -10, (7, 6, 5), size)
    b = generate.checkerboard(spark, 20, -10, (3, 8, 11), size)
    return a.zip(b.map(w=F.col("v"))).map(v=F.round(F.col("v") + F.sqrt(F.abs("w")), 6)).df


@query(f"""WITH RECURSIVE {LI}, g AS (SELECT x, y, CAST((255 - v % 256 + 2 * (255 - v * 7 % 256) + 255 - v * 13 % 256) // 4 AS BIGINT) AS v FROM li), e AS (SELECT c.x, c.y, abs(l.v - c.v) + abs(u.v - c.v) AS v FROM g c JOIN g l ON l.x = greatest(0, c.x - 1) AND l.y = c.y JOIN g u ON u.x = c.x AND u.y = greatest(0, c.y - 1)),
m AS MATERIALIZED (SELECT x, y, x + 32 * y AS id FROM e WHERE v >= 80), t AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1), r(id, u) AS (SELECT a, b FROM t UNION SELECT r.id, t.b FROM r JOIN t ON t.a = r.u), l AS (SELECT id, min(u) + 1 AS label FROM r GROUP BY id)
SELECT e.x, e.y, e.v AS edge, CAST(coalesce(label, 0) * 123 % 256 AS INT) AS c0, CAST(coalesce(label, 0) * 7 % 256 AS INT) AS c1, CAST(coalesce(label, 0) * 13 % 256 AS INT) AS c2 FROM e LEFT JOIN l ON l.id = e.x + 32 * e.y""")
def edge_components(spark, sf_dir):
    g = li(spark, sf_dir).map(r=F.col("v") % 256, g=F.col("v") * 7 % 256, b=F.col("v") * 13 % 256)
    return pipelines.edge_components(g, at=80).df


@query(f"""WITH {LI}, {MOORE2}, {NEAR_LI}, s AS (SELECT x, y, CAST(sum(nv * {SOBEL_X}) AS DOUBLE) AS sx, CAST(sum(nv * {SOBEL_Y}) AS DOUBLE) AS sy FROM n GROUP BY x, y), m AS (SELECT x, y, sqrt(sx * sx + sy * sy) AS g FROM s)
SELECT x, y, round(g * (100.0 / (SELECT max(g) FROM m)), 4) AS g FROM m""")
def scaled_gradient(spark, sf_dir):
    g = filters.sobel_magnitude(li(spark, sf_dir))
    return filters.scaled(g, "g").map(g=F.round("g", 4)).df


@query(f"""WITH {LI}, e AS (SELECT CAST(1 + abs(a.v - b.v) % 17 AS DOUBLE) AS w FROM li a JOIN li b ON (b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1)) SELECT min(w) AS least, max(w) AS most, round(avg(w), 6) AS mean FROM e""")
def edge_weights(spark, sf_dir):
    return pipelines.edge_weights(_lattice(spark, sf_dir)[1]).withColumn("mean", F.round("mean", 6))


@query(f"""WITH {LI} SELECT c.x, c.y, c.v + coalesce(l.v, 0) AS left_sum, 2 * c.v AS doubled, c.v - c.x AS placed, c.v + 2 * m.v AS scaled FROM li c LEFT JOIN li l ON l.x = c.x - 1 AND l.y = c.y JOIN li m ON m.x = 31 - c.x AND m.y = c.y""")
def map_operators(spark, sf_dir):
    g = li(spark, sf_dir)
    both = maps.transform_locator(g.add(left_sum=F.col("v")), lambda n: n[0], [(-1, 0)], "zero", out="left_sum", assign="add")
    both = maps.transform(both, lambda v: v * 2, out="doubled")
    both = maps.transform_position(both, lambda v, x, y: v - x, out="placed")
    other = maps.add_scaled(g, 2, stencil.flip(g, "x"))
    return both.zip(other.map(scaled=F.col("v"))).map(left_sum=F.col("left_sum"), doubled=F.col("doubled"), placed=F.col("placed"), scaled=F.col("scaled")).df


_GREY = "(SELECT x, y, CAST(v % 256 + v * 7 % 256 + v * 13 % 256 AS BIGINT) AS v FROM li)"
_EDGE = f"g AS MATERIALIZED {_GREY}, li2 AS MATERIALIZED (SELECT c.x, c.y, abs(l.v - c.v) + abs(u.v - c.v) AS v FROM g c JOIN g l ON l.x = greatest(0, c.x - 1) AND l.y = c.y JOIN g u ON u.x = c.x AND u.y = greatest(0, c.y - 1))"


@query(f"""WITH RECURSIVE {LI}, {_EDGE}, {MOORE2}, {_RAISED.replace("li a JOIN li b", "li2 a JOIN li2 b")}, {_AROUND}, {_DOWN}, e AS MATERIALIZED (SELECT id AS a, low AS b FROM t UNION SELECT low, id FROM t), {_CLOSED}
SELECT c.x, c.y, CAST(label AS BIGINT) AS label, CAST(label * 123 % 256 AS INT) AS c0, CAST(label * 7 % 256 AS INT) AS c1, CAST(label * 13 % 256 AS INT) AS c2 FROM c JOIN done USING (id)""")
def image_watershed(spark, sf_dir):
    g = li(spark, sf_dir).map(r=F.col("v") % 256, g=F.col("v") * 7 % 256, b=F.col("v") * 13 % 256)
    return pipelines.image_watershed(g, "descent_gs").df


@query(f"""WITH z AS ({_react(2).replace("v * 7 % 256", "v * 13 % 256").replace("round(u, 6)", "u").replace("round(w, 6)", "w")}), b AS (SELECT min(u) AS ul, max(u) AS uh, min(w) AS wl, max(w) AS wh FROM z)
SELECT x, y, CAST(floor((u - ul) / (uh - ul) * 255) AS INT) AS c0, CAST(floor((w - wl) / (wh - wl) * 255) AS INT) AS c2 FROM z, b""")
def reaction_image(spark, sf_dir):
    g = li(spark, sf_dir).map(r=F.col("v") % 256, g=F.col("v") * 7 % 256, b=F.col("v") * 13 % 256)
    return pipelines.reaction_image(g, 2).df


@query(f"{_MIN} SELECT x, y, label, CAST(label * 123 % 256 AS INT) AS c0, CAST(label * 7 % 256 AS INT) AS c1, CAST(label * 13 % 256 AS INT) AS c2 FROM m")
def minima_colours(spark, sf_dir):
    return pipelines.minima_colours(_plateau_grid(spark, sf_dir)).df


@query()
def diffuse_image(spark, sf_dir):
    return pipelines.diffuse_image(li(spark, sf_dir).map(v=F.col("v") % 256)).df


@query(f"WITH {LI} SELECT x, y, CAST(v % 256 AS INT) AS c0, CAST(v * 7 % 256 AS INT) AS c1, CAST(v * 13 % 256 AS INT) AS c2 FROM li")
def image_files(spark, sf_dir):
    """The colours of a grid, written as an image file and read back."""
    g = li(spark, sf_dir).map(**{f"c{i}": F.col("v") * k % 256 for i, k in enumerate((1, 7, 13))})
    folder = f"{run_dir(spark)}/images-{uuid.uuid4().hex}"
    tables.write_images(g, ("c0", "c1", "c2"), folder)
    return tables.read_images(spark, folder).drop("img")


@query(f"WITH {EV} SELECT x, y, z, CAST(v AS DOUBLE) AS v FROM ev")
def volume_files(spark, sf_dir):
    """A volume, written as header and raw file and read back."""
    folder = f"{run_dir(spark)}/volume-{uuid.uuid4().hex}"
    tables.write_volume(ev(spark, sf_dir), f"{folder}/v.mhd")
    return tables.read_volume(spark, f"{folder}/v.mhd").df


@query()
def region_segmentation(spark, sf_dir):
    g = li(spark, sf_dir)
    rim = g.size[0] // 6
    mask = g.map(m=F.when(F.col("x") < rim, 128).when(F.col("x") >= g.size[0] - rim, 255).otherwise(0))
    return pipelines.region_segmentation(g, mask).df


@query(f"""WITH RECURSIVE {EMB}, h AS MATERIALIZED (SELECT c.x, c.y, c.x + 64 * c.y AS id, abs(l.v - c.v) + abs(u.v - c.v) AS v FROM emb c JOIN emb l ON l.x = greatest(0, c.x - 1) AND l.y = c.y JOIN emb u ON u.x = c.x AND u.y = greatest(0, c.y - 1)), {MOORE2}, c AS (SELECT * FROM h), {_AROUND}, {_DOWN},
e AS MATERIALIZED (SELECT id AS a, low AS b FROM t UNION SELECT low, id FROM t), {_CLOSED}, reg AS MATERIALIZED (SELECT h.x, h.y, h.v, CAST(dense_rank() OVER (ORDER BY label) AS BIGINT) AS label FROM h JOIN done USING (id))
SELECT 'n' AS tag, label AS l1, CAST(0 AS BIGINT) AS l2, count(*) AS n, round(CAST(sum(v) AS DOUBLE), 6) AS s FROM reg GROUP BY label
UNION ALL SELECT 'e', least(a.label, b.label), greatest(a.label, b.label), count(*), round(sum(pow(1.0 / (1.0 + greatest(a.v, b.v)), 2)), 6) FROM reg a JOIN reg b ON ((b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1)) AND a.label != b.label GROUP BY 2, 3""")
def flagship(spark, sf_dir):
    """Gradient, watershed and region graph of the embeddings."""
    return pipelines.region_graph(emb(spark, sf_dir))
