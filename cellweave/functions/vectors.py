"""Small vectors and matrices in array columns, and index arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(f, a: Column) -> Column:
    return F.transform(a, lambda x: F.lit(f) * x)


def hadamard(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def least(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.least(x, y))


def most(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y))


def all_less(a: Column, b: Column) -> Column:
    """True if every component of a is below that of b: a partial order."""
    return F.forall(F.zip_with(a, b, lambda x, y: x < y), lambda x: x)


def component_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def component_product(a: Column) -> Column:
    return F.aggregate(a, F.lit(1.0), lambda s, x: s * x)


def dot(a: Column, b: Column) -> Column:
    return component_sum(hadamard(a, b))


def cross(a: Column, b: Column) -> Column:
    def part(i: int, j: int) -> Column:
        return a[i] * b[j] - a[j] * b[i]

    return F.array(part(1, 2), part(2, 0), part(0, 1))


def magnitude(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column) -> Column:
    """The unit vector; null components for the zero vector."""
    return F.transform(a, lambda x: F.try_divide(x, magnitude(a)))


def truncated_div(a: Column, d: int) -> Column:
    """Integer division of each component, towards zero."""
    return F.transform(a, lambda x: ((x - x % d) / d).cast("long"))


def quotients(a: Column, b: Column) -> Column:
    """Integer division of each component by that of ``b``, towards zero; null where it is 0."""
    return F.zip_with(a, b, lambda x, y: F.when(y != 0, (x - x % y) / y).cast("long"))


def insert(a: Column, at: int, value) -> Column:
    """A vector of one more dimension, with ``value`` at place ``at``."""
    return F.concat(F.slice(a, 1, at), F.array(F.lit(value)), F.slice(a, at + 1, F.size(a)))


def orthonormal(a: Column) -> Column:
    """A unit vector at right angles to a 3-vector: the first component that is not 0 and the one after it, turned; zeros for the zero vector."""
    out = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    for j in reversed(range(3)):
        k = (j + 1) % 3
        size = F.sqrt(a[j] * a[j] + a[k] * a[k])
        turned = {j: F.try_divide(a[k], size), k: F.try_divide(-a[j], size)}
        out = F.when(a[j] != 0, F.array(*(turned.get(i, F.lit(0.0)) for i in range(3)))).otherwise(out)
    return out


#: Row and column of each component of a packed symmetric 3x3 tensor.
PACKED = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))


def trace(t: Sequence[Column]) -> Column:
    """Trace of a packed symmetric tensor of six columns."""
    return t[0] + t[3] + t[5]


def times_vector(t: Sequence[Column], v: Sequence[Column]) -> list[Column]:
    """Packed symmetric tensor times vector."""
    a, b, c, d, e, f = t
    x, y, z = v
    return [a * x + b * y + c * z, b * x + d * y + e * z, c * x + e * y + f * z]


def matrix_product(a: Sequence[Sequence[Column]], b: Sequence[Sequence[Column]]) -> list[list[Column]]:
    """Product of two matrices of columns."""
    inner = range(len(b))
    out = []
    for row in a:
        line = []
        for j in range(len(b[0])):
            s = row[0] * b[0][j]
            for k in inner[1:]:
                s = s + row[k] * b[k][j]
            line.append(s)
        out.append(line)
    return out


def unpack(packed: np.ndarray) -> np.ndarray:
    """Full symmetric matrices of packed rows."""
    full = np.empty((len(packed), 3, 3))
    for k, (i, j) in enumerate(PACKED):
        full[:, i, j] = full[:, j, i] = packed[:, k]
    return full


@pandas_udf(T.StructType([T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("values", "vectors")]))
def eigen(t: pd.Series) -> pd.DataFrame:
    """Eigenvalues (ascending) and eigenvectors (by columns, row after row) of packed symmetric tensors."""
    values, vectors = np.linalg.eigh(unpack(np.stack(t.to_numpy()))) if len(t) else (np.zeros((0, 3)), np.zeros((0, 3, 3)))
    return pd.DataFrame({"values": list(values), "vectors": list(vectors.reshape(-1, 9))})


def morton(x: Column, y: Column, z: Column) -> Column:
    """Z-order index of 21-bit coordinates."""

    def spread(v: Column) -> Column:
        v = v.cast("long").bitwiseAND(F.lit(0x1FFFFF))
        for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1)).bitwiseOR(F.shiftleft(spread(z), 2))


def blocked_index(x: Column, y: Column, z: Column, size: tuple[int, int, int], block: int) -> Column:
    """Index in an order of cubes of ``block`` cells a side, ragged at the far faces.

    Whole slabs of blocks come before, then whole rows of blocks in the slab,
    then blocks in the row, then cells in the block; extents at the far faces
    are what is left there.
    """
    nx, ny, nz = size

    def start(c: Column) -> Column:
        return c - c % block

    def extent(c: Column, n: int) -> Column:
        return F.least(F.lit(block), F.lit(n) - start(c))

    ex, ey, ez = extent(x, nx), extent(y, ny), extent(z, nz)
    ahead = start(z).cast("long") * (nx * ny) + start(y).cast("long") * nx * ez + start(x).cast("long") * ey * ez
    return ahead + x % block + ex * (y % block + ey * (z % block))
