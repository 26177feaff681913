"""Binary max-flow lattices: a packed header, capacities of links, and an active mask.

A file holds one instance, of bounded size; a folder of them is read as one
table, a task a file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..plans.storage import put

#: Magic; dimension, connectivity, width, height, depth; maximum
#: flow; symmetric; metadata; active cells, type of terminal and of neighbour
#: capacities (0, 1, 2: 8, 16, 32 bits unsigned).
MAGIC = b"MFI"
HEADER = struct.Struct("<5iqi4096s3i")
KINDS = ("<u1", "<u2", "<u4")
#: The step of each array of neighbour capacities, by connectivity.
STEPS = {
    4: ((-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0)),
    6: ((-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)),
}
#: All cells around, x fastest, in the plane and in space.
for _n, _dims in ((8, 2), (26, 3)):
    STEPS[_n] = tuple((*reversed(o), *(0,) * (3 - _dims)) for o in product((-1, 0, 1), repeat=_dims) if any(o))


@dataclass
class Lattice:
    """An instance: capacities from the source and to the sink, and to each neighbour, by cell."""

    size: tuple[int, int, int]
    source: np.ndarray
    sink: np.ndarray
    neighbours: list[np.ndarray]
    active: np.ndarray
    max_flow: int = 0
    metadata: bytes = b""
    kinds: tuple[int, int] = field(default=(2, 2))

    def pack(self) -> bytes:
        """The bytes of a file."""
        w, h, d = self.size
        head = HEADER.pack(2 if d == 1 else 3, len(self.neighbours), w, h, d, self.max_flow, 0, self.metadata, int(self.active.sum()), *self.kinds)
        t, n = (KINDS[k] for k in self.kinds)
        return b"".join((MAGIC, head, self.source.astype(t).tobytes(), self.sink.astype(t).tobytes(), *(x.astype(n).tobytes() for x in self.neighbours), self.active.astype("u1").tobytes()))

    @classmethod
    def unpack(cls, data: bytes) -> Lattice:
        if data[:3] != MAGIC:
            raise ValueError("no lattice file")
        _, many, w, h, d, flow, _, metadata, _, terminal, neighbour = HEADER.unpack_from(data, 3)
        if many not in STEPS:
            raise ValueError(f"no lattice of {many} neighbours; there are {', '.join(map(str, STEPS))}")
        at, cells = 3 + HEADER.size, w * h * d

        def take(kind: str) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(data, kind, cells, at)
            at += x.nbytes
            return x

        t, n = KINDS[terminal], KINDS[neighbour]
        source, sink = take(t), take(t)
        return cls((w, h, d), source, sink, [take(n) for _ in range(many)], take("u1"), flow, metadata.rstrip(b"\0"), (terminal, neighbour))

    def tables(self) -> tuple[dict, dict]:
        """Columns of vertices and of arcs (each neighbour capacity an edge that goes one way)."""
        w, h, d = self.size
        ids = np.arange(w * h * d)
        x, y, z = ids % w, ids // w % h, ids // (w * h)
        a, b, c = [], [], []
        for (dx, dy, dz), cap in zip(STEPS[len(self.neighbours)], self.neighbours, strict=True):
            ok = (x + dx >= 0) & (x + dx < w) & (y + dy >= 0) & (y + dy < h) & (z + dz >= 0) & (z + dz < d) & (cap > 0)
            a.append(ids[ok])
            b.append(ids[ok] + dx + w * (dy + h * dz))
            c.append(cap[ok].astype(float))
        return (
            {"id": ids, "cap_src": self.source.astype(float), "cap_snk": self.sink.astype(float)},
            {"a": np.concatenate(a), "b": np.concatenate(b), "w_fwd": np.concatenate(c)},
        )


def read_lattices(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of all files of a path, each row with the file's ``path``."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def reader(which: int, names: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for p, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                    t = Lattice.unpack(data).tables()[which]
                    n = len(t["a" if which else "id"])
                    if which:
                        t = {"eid": np.arange(n), **t, "w_bwd": np.zeros(n)}
                    yield pa.RecordBatch.from_arrays([pa.array([p] * n, pa.string()), *(pa.array(t[c]) for c in names)], ["path", *names])

        return run

    vertices = files.mapInArrow(reader(0, ["id", "cap_src", "cap_snk"]), "path string, id long, cap_src double, cap_snk double")
    edges = files.mapInArrow(reader(1, ["eid", "a", "b", "w_fwd", "w_bwd"]), "path string, eid long, a long, b long, w_fwd double, w_bwd double")
    return vertices, edges


def write_lattice(spark: SparkSession, lattice: Lattice, path: str) -> None:
    """Write one instance through Spark's file systems."""
    put(spark, path, lattice.pack())
