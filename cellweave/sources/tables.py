"""Grids from tables and files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import Grid, densify
from ..plans.storage import put

#: Types of a value column, widest ranges last.
SCALARS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def probe(df: DataFrame, value: str = "v") -> dict:
    """Component type, number of components and dimensions of a grid table; raises for what is no scalar."""
    kinds = dict(df.dtypes)
    axes = [a for a in ("x", "y", "z") if a in kinds]
    if kinds.get(value) not in SCALARS:
        raise ValueError(f"values of type {kinds.get(value)} are not scalars")
    return {"type": kinds[value], "components": 1, "dims": len(axes)}


def read_grid(spark: SparkSession, path: str, size: tuple[int, ...], keys: tuple[str, ...] = ()) -> Grid:
    """A grid stored as parquet; filters on coordinates and keys reach the scan."""
    return Grid(spark.read.parquet(path), size, keys)


def write_grid(grid: Grid, path: str) -> None:
    """Store a grid, in folders by its keys and sorted inside files so that boxes prune row groups."""
    order = list(reversed(grid.axes))
    writer = grid.df.sortWithinPartitions(*order).write
    (writer.partitionBy(*grid.keys) if grid.keys else writer).parquet(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Cells (img, y, x, c0…) of 8-bit image files, by Spark's image source (OpenCV order: blue, green, red)."""
    df = spark.read.format("image").load(path).select("image.*")
    n = F.col("nChannels")
    cells = df.select("origin", "width", "nChannels", "data", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("i"))

    def channel(k: int):
        byte = F.expr(f"conv(hex(substring(data, i * nChannels + {k} + 1, 1)), 16, 10)")
        return F.when(n > k, byte.cast("int"))

    red, green, blue = F.when(n == 1, channel(0)).otherwise(channel(2)), channel(1), F.when(n > 1, channel(0))
    return cells.select(F.col("origin").alias("img"), F.expr("cast(i div width as int)").alias("y"), F.expr("cast(i % width as int)").alias("x"), red.alias("c0"), green.alias("c1"), blue.alias("c2"))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_bytes(channels: np.ndarray) -> bytes:
    """A PNG file of 8-bit ``channels`` (height, width, 1 or 3)."""
    h, w, n = channels.shape
    lines = np.zeros((h, 1 + w * n), dtype=np.uint8)  # each line begins with filter 0
    lines[:, 1:] = channels.reshape(h, w * n)
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2}[n], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes())) + _chunk(b"IEND", b"")


def image_bytes(grid: Grid, columns: tuple[str, ...], key: str | None = None) -> DataFrame:
    """(img, content): a PNG file of each plane grid of the frame, from one or three columns of bytes. An image is made in one task."""
    if len(grid.axes) != 2 or len(columns) not in (1, 3):
        raise ValueError("an image has two axes and one or three channels")
    w, h = grid.size
    cells = grid.df.select((F.col(key).cast("string") if key else F.lit("0")).alias("img"), *grid.axes, *(F.col(c).cast("int").alias(c) for c in columns))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((h, w, len(columns)), dtype=np.uint8)
        a[pdf["y"], pdf["x"]] = pdf[list(columns)].to_numpy()
        return pd.DataFrame({"img": [pdf["img"].iloc[0]], "content": [png_bytes(a)]})

    return cells.groupBy("img").applyInPandas(draw, "img string, content binary")


def write_images(grid: Grid, columns: tuple[str, ...], path: str, key: str | None = None) -> None:
    """Write ``image_bytes`` as files ``path``/<img>.png through Spark's file systems, one image after the other; for very many, store ``image_bytes`` as a table."""
    for r in image_bytes(grid, columns, key).toLocalIterator():
        put(grid.df.sparkSession, f"{path}/{r['img']}.png", bytes(r["content"]))


#: Element types of raw volumes, as their headers name them.
RAW_TYPES = {"MET_UCHAR": "u1", "MET_CHAR": "i1", "MET_USHORT": "u2", "MET_SHORT": "i2", "MET_UINT": "u4", "MET_INT": "i4", "MET_FLOAT": "f4", "MET_DOUBLE": "f8"}


def read_volume(spark: SparkSession, header: str) -> Grid:
    """A raw volume (x fastest) described by a text header of ``name = value`` lines: NDims, DimSize, ElementType, ElementDataFile, ElementByteOrderMSB.

    The data file stands beside the header and has no header of its own. It is
    read as records of one line of cells each, so a volume is dealt over tasks.
    """
    rows = spark.read.text(header).select("value").collect()  # a dozen lines
    known = {k.strip(): v.strip() for k, v in (r["value"].split("=", 1) for r in rows if "=" in r["value"])}
    size = tuple(int(n) for n in known["DimSize"].split())
    if known["ElementType"] not in RAW_TYPES or len(size) not in (2, 3):
        raise ValueError(f"no volume of {known['ElementType']} in {len(size)} dimensions")
    order = ">" if known.get("ElementByteOrderMSB", known.get("BinaryDataByteOrderMSB", "False")).lower() == "true" else "<"
    kind = np.dtype(order + RAW_TYPES[known["ElementType"]])
    nx, line = size[0], size[0] * kind.itemsize
    path = header.rsplit("/", 1)[0] + "/" + known["ElementDataFile"]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    length = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).getLen()
    cells = int(np.prod(size))
    if length != cells * kind.itemsize:
        raise ValueError(f"{path} has {length} bytes, not {cells * kind.itemsize}")
    lines = spark.sparkContext.binaryRecords(path, line).zipWithIndex().map(lambda r: (r[1], bytes(r[0]))).toDF("line long, data binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("line").to_numpy().repeat(nx)
            v = np.frombuffer(b"".join(b.column("data").to_pylist()), dtype=kind).astype(np.float64)
            x = np.tile(np.arange(nx, dtype=np.int32), len(b))
            made = [x, (at % size[1]).astype(np.int32)] + ([(at // size[1]).astype(np.int32)] if len(size) == 3 else [])
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in made), pa.array(v)], [*"xyz"[: len(size)], "v"])

    axes = ", ".join(f"{a} int" for a in "xyz"[: len(size)])
    return Grid(lines.mapInArrow(run, f"{axes}, v double"), size)


def write_volume(grid: Grid, header: str, column: str = "v", element: str = "MET_DOUBLE") -> None:
    """Write a volume that fits one task as header and raw file, for ``read_volume``."""
    kind = np.dtype("<" + RAW_TYPES[element])
    rows = grid.df.select(grid.index().alias("i"), F.col(column).cast("double").alias("v"))
    cells = int(np.prod(grid.size))
    name = header.rsplit("/", 1)[-1].rsplit(".", 1)[0] + ".raw"

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros(cells, dtype=kind)
        a[pdf["i"]] = pdf["v"].to_numpy()
        return pd.DataFrame({"content": [a.tobytes()]})

    data = rows.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(draw, "content binary").first()["content"]
    text = f"ObjectType = Image\nNDims = {len(grid.size)}\nDimSize = {' '.join(map(str, grid.size))}\nElementType = {element}\nElementByteOrderMSB = False\nElementDataFile = {name}\n"
    for path, content in ((header, text.encode()), (header.rsplit("/", 1)[0] + "/" + name, data)):
        put(grid.df.sparkSession, path, bytes(content))


def from_vectors(df: DataFrame, key: str, column: str, rows: int, width: int) -> Grid:
    """A grid with a line for each vector: y from ``key``, x the place in the vector."""
    cells = df.select(F.col(key).cast("int").alias("y"), F.posexplode(column).alias("x", "v"))
    return Grid(cells.select("x", "y", F.col("v").cast("double").alias("v")), (width, rows))


def bytes_of(grid: Grid, column: str = "v", out: str = "v") -> Grid:
    """Values from -1 to 1 as bytes 0 to 255."""
    return grid.add(**{out: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col(column) + 1) * 127.5).cast("int")))})


def binned(df: DataFrame, size: tuple[int, ...], coords: dict, value, spark: SparkSession, dense: bool = True) -> Grid:
    """A grid of an aggregate ``value`` of rows by computed coordinates; 0 where there is no row, or with ``dense`` false no cell."""
    cells = df.groupBy(*(c.cast("int").alias(a) for a, c in coords.items())).agg(value.alias("v"))
    return densify(Grid(cells, size), spark, v=0) if dense else Grid(cells, size)
