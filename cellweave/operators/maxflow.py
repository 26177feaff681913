"""Maximum flow and minimum cut by synchronous push-relabel sweeps.

vertices: id, cap_src, cap_snk. edges: eid, a, b, w_fwd, w_bwd. State is two
tables: vertices with excess and flow into the sink, and two arcs for an edge
with their residuals. Levels are distances to the sink over residual arcs,
found breadth first. In a sweep every vertex with excess first serves its sink
link and then gives out the rest over its arcs to lower levels, in the order of
eid, by a running sum; as an arc only goes down, no edge is pushed both ways.
Excess that cannot reach the sink stays where it is, which leaves the value of
the flow and the cut on the sink's side exact.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import saved


def arcs_of(edges: DataFrame) -> DataFrame:
    """eid, src, dst, res: both directions of every edge."""
    forward = edges.select("eid", F.col("a").alias("src"), F.col("b").alias("dst"), F.col("w_fwd").alias("res"))
    return forward.unionByName(edges.select("eid", F.col("b").alias("src"), F.col("a").alias("dst"), F.col("w_bwd").alias("res")))


#: Graphs of at most so many arcs are solved in one task.
SMALL = 100_000


def _one_task(vertices: DataFrame, arcs: DataFrame, solve, schema: str) -> DataFrame:
    """``solve`` of the rows of both tables, in one task; only for graphs whose size was checked."""
    v = vertices.select(F.lit(0).alias("kind"), "id", F.lit(0).cast("long").alias("src"), F.lit(0).cast("long").alias("dst"), F.col(vertices.columns[1]).cast("double").alias("a"), F.col(vertices.columns[-1]).cast("double").alias("b"))
    e = arcs.select(F.lit(1).alias("kind"), F.col("eid").cast("long").alias("id"), "src", "dst", F.col("res").cast("double").alias("a"), F.lit(0.0).alias("b"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(parts)
        if held:
            rows = pd.concat(held)
            yield solve(rows[rows.kind == 0], rows[rows.kind == 1].sort_values("id", kind="stable"))

    return v.unionByName(e).repartition(1).mapInPandas(run, schema)


def _breadth_first(starts: list, into: dict) -> dict:
    level, queue = dict.fromkeys(starts, 1), deque(starts)
    while queue:
        u = queue.popleft()
        for w in into.get(u, ()):
            if w not in level:
                level[w] = level[u] + 1
                queue.append(w)
    return level


def _local_levels(v: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
    into: dict = {}
    for s, d in zip(e.src, e.dst, strict=True):
        into.setdefault(d, []).append(s)
    level = _breadth_first(v.id[v.a > 0].tolist(), into)
    return pd.DataFrame({"id": list(level), "level": list(level.values())})


def _local_flow(v: pd.DataFrame, e: pd.DataFrame, least: float = 0.0) -> pd.DataFrame:
    """Blocking flows by levels, from virtual ends; (id, side), and the flow as the row of id -1.

    The flow at the levels of round t is the row of id -2 - 2t, that after its pushes of id -3 - 2t.
    """
    source, sink = -2, -3
    ends: dict = {}
    to: list = []
    room: list = []
    floor: list = []  # residuals up to this count as none when levels are found
    tiny = 1e-12

    def arc(a, b, forward: float, backward: float, none: float = tiny) -> None:
        for x, y, c in ((a, b, forward), (b, a, backward)):
            ends.setdefault(x, []).append(len(to))
            to.append(y)
            room.append(c)
            floor.append(none)

    for i, s, t in zip(v.id, v.a, v.b, strict=True):
        ends.setdefault(i, [])
        if s > 0:
            arc(source, i, s, 0.0)
        if t > 0:
            arc(i, sink, t, 0.0)
    for s, d, c in zip(e.src, e.dst, e.a, strict=True):
        if c > 0:
            arc(s, d, c, 0.0, max(least, tiny))
    flow, told = 0.0, []
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            u = queue.popleft()
            for k in ends.get(u, ()):
                if room[k] > floor[k] and to[k] not in level:
                    level[to[k]] = level[u] + 1
                    queue.append(to[k])
        told.append(flow)
        if sink not in level:
            break
        at = dict.fromkeys(ends, 0)
        path: list = []
        u = source
        while True:
            if u == sink:
                d = min(room[k] for k in path)
                flow += d
                for k in path:
                    room[k] -= d
                    room[k ^ 1] += d
                full = next(i for i, k in enumerate(path) if room[k] <= tiny)
                u = to[path[full] ^ 1]
                del path[full:]
                continue
            while at[u] < len(ends[u]):
                k = ends[u][at[u]]
                if room[k] > tiny and level.get(to[k], -1) == level[u] + 1:
                    break
                at[u] += 1
            if at[u] < len(ends[u]):
                path.append(ends[u][at[u]])
                u = to[path[-1]]
            elif path:
                u = to[path.pop() ^ 1]
                at[u] += 1
            else:
                break
        told.append(flow)
    into: dict = {}
    for u, ks in ends.items():
        for k in ks:
            if room[k] > floor[k]:
                into.setdefault(to[k], []).append(u)
    reach = _breadth_first([sink], into)
    ids = v.id.tolist()
    return pd.DataFrame({"id": [*ids, -1, *(-2 - i for i in range(len(told)))], "side": [float(i in reach) for i in ids] + [flow, *told]})


def levels(vertices: DataFrame, arcs: DataFrame, least: float = 0.0, small: int = SMALL) -> DataFrame:
    """id, level: 1 where the sink link has room, and one more for each residual arc on the way to it.

    Graphs of at most ``small`` arcs are searched in one task; beyond that each
    level is a job, and only its frontier is joined and written. Vertices that
    cannot reach the sink are not in the result.
    """
    open_arcs = arcs.filter(F.col("res") > least)
    if open_arcs.count() <= small:
        return saved(_one_task(vertices.select("id", "room"), open_arcs, _local_levels, "id long, level int"), "levels")
    back = arcs.filter(F.col("res") > least).select(F.col("src").alias("next"), F.col("dst").alias("id"))
    front = saved(vertices.filter("room > 0").select("id", F.lit(1).alias("level")), "levels")
    seen, depth = front, 1
    while not front.isEmpty():
        depth += 1
        new = front.join(back, "id").select(F.col("next").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        front = saved(new.withColumn("level", F.lit(depth)), "levels")
        seen = seen.unionByName(front)
        if depth % 16 == 0:
            seen = saved(seen, "levels")
    return seen


def max_flow(vertices: DataFrame, edges: DataFrame, sweeps: int = 4, least: float = 0.0, limit: int = 2000, small: int = SMALL, trace: Callable[[str, int, float], None] | None = None) -> tuple[float, DataFrame]:
    """(flow, segments): the value of the maximum flow, and id with side 1 for the sink's side of a minimum cut, else 0.

    sweeps: pushes between two rounds of levels. least: residuals up to this
    count as none when levels are found. small: graphs of at most so many arcs
    are solved in one task, by blocking flows. trace: called with what was done,
    the round, and the flow so far.
    """
    arcs = saved(arcs_of(edges), "arcs")
    if arcs.count() <= small:
        own = vertices.select("id", "cap_src", "cap_snk")
        rows = saved(_one_task(own, arcs, lambda v, e: _local_flow(v, e, least), "id long, side double"), "flow")
        found = rows.filter("id = -1").first()
        if trace:
            for r in rows.filter("id < -1").orderBy(F.desc("id")).collect():
                trace("push" if r["id"] % 2 else "relabel", (-2 - r["id"]) // 2, r["side"])
        return (found["side"] if found else 0.0), rows.filter("id >= 0").select("id", F.col("side").cast("int").alias("side"))
    state = vertices.select("id", F.col("cap_src").cast("double").alias("excess"), F.col("cap_snk").cast("double").alias("room"), F.lit(0.0).alias("sunk"))
    state = saved(state, "vertices")

    def serve(s: DataFrame) -> DataFrame:
        d = F.least("excess", "room")
        return s.select("id", (F.col("excess") - d).alias("excess"), (F.col("room") - d).alias("room"), (F.col("sunk") + d).alias("sunk"))

    flow = 0.0
    for turn in range(limit):
        state = saved(serve(state), "vertices")
        level = levels(state.select("id", "room"), arcs, least, small)
        if trace:
            trace("relabel", turn, flow)
        active = state.filter("excess > 0").join(level, "id", "left_semi")
        if active.isEmpty():
            break
        for _ in range(sweeps):
            # an arc goes out only where its source has excess and its target is lower
            src = state.filter("excess > 0").join(level, "id").select(F.col("id").alias("src"), "excess", F.col("level").alias("ls"))
            open_ = arcs.filter("res > 0").join(src, "src").join(level.select(F.col("id").alias("dst"), F.col("level").alias("ld")), "dst").filter("ls > ld")
            before = F.coalesce(F.sum("res").over(Window.partitionBy("src").orderBy("eid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
            pushed = saved(open_.withColumn("before", before).select("eid", "src", "dst", F.greatest(F.lit(0.0), F.least(F.col("res"), F.col("excess") - F.col("before"))).alias("d")).filter("d > 0"), "pushed")
            if pushed.isEmpty():
                break
            change = pushed.select(F.col("src").alias("id"), (-F.col("d")).alias("d")).unionByName(pushed.select(F.col("dst").alias("id"), "d")).groupBy("id").agg(F.sum("d").alias("d"))
            state = state.join(change, "id", "left").withColumn("excess", F.col("excess") + F.coalesce("d", F.lit(0.0))).drop("d")
            state = saved(serve(state), "vertices")
            p = pushed.select("eid", F.col("src").alias("from"), "d")
            arcs = arcs.join(p, "eid", "left").select("eid", "src", "dst", (F.col("res") + F.when(F.col("d").isNull(), 0.0).when(F.col("from") == F.col("src"), -F.col("d")).otherwise(F.col("d"))).alias("res"))
            arcs = saved(arcs, "arcs")
        flow = float(state.agg(F.sum("sunk")).first()[0] or 0.0)
        if trace:
            trace("push", turn, flow)
    else:
        raise RuntimeError(f"no maximum after {limit} rounds")
    flow = float(state.agg(F.sum("sunk")).first()[0] or 0.0)
    segments = state.select("id").join(level, "id", "left").select("id", F.col("level").isNotNull().cast("int").alias("side"))
    return flow, segments


def cut_capacity(vertices: DataFrame, edges: DataFrame, segments: DataFrame) -> DataFrame:
    """One row, ``capacity``: of the arcs and links from the source's side (0) to the sink's side (1)."""
    side = segments.select(F.col("id").alias("src"), F.col("side").alias("s"))
    over = arcs_of(edges).join(side, "src").join(segments.select(F.col("id").alias("dst"), F.col("side").alias("t")), "dst").filter("s = 0 AND t = 1").select(F.col("res").alias("c"))
    v = vertices.join(segments, "id")
    links = v.select(F.when(F.col("side") == 1, F.col("cap_src")).otherwise(F.col("cap_snk")).cast("double").alias("c"))
    return over.unionByName(links).agg(F.sum("c").alias("capacity"))


def saturated(arcs: DataFrame) -> DataFrame:
    """dst, full: whether any arc into a vertex has no residual left."""
    return arcs.groupBy("dst").agg(F.max((F.col("res") <= 0).cast("int")).alias("full"))
