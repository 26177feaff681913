"""Functions of one cell, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def negate(c: Column) -> Column:
    """Complement of an 8-bit channel."""
    return 255 - c


def grayscale(r: Column, g: Column, b: Column) -> Column:
    """Integer luminance (r + 2g + b) / 4."""
    return ((r + 2 * g + b) - (r + 2 * g + b) % 4) / 4


def threshold(v: Column, at, under, over) -> Column:
    """``under`` for values below ``at``, else ``over``."""
    return F.when(v < at, F.lit(under)).otherwise(F.lit(over))


def to_byte(v: Column) -> Column:
    """Clamp to 0..255 and cut the fraction off."""
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), v)).cast("int")


def colour(label: Column) -> list[Column]:
    """A colour for a label, three 8-bit channels."""
    return [(label * k % 256).cast("int") for k in (123, 7, 13)]


def square(v: Column) -> Column:
    return v * v


def root(v: Column) -> Column:
    """Square root; null for negative values."""
    return F.when(v >= 0, F.sqrt(v))


def divide(a: Column, b: Column) -> Column:
    """Quotient; null where the divisor is 0."""
    return F.try_divide(a, b)


def linear(f1, a: Column, f2, b: Column) -> Column:
    return F.lit(f1) * a + F.lit(f2) * b


def total(*values: Column) -> Column:
    """Sum of several values, or of the channels of one cell."""
    out = values[0]
    for v in values[1:]:
        out = out + v
    return out


def lower_limit(v: Column, limit, replacement=None) -> Column:
    """At least ``limit``; or ``replacement`` for values below it."""
    return F.greatest(F.lit(limit), v) if replacement is None else F.when(v < limit, F.lit(replacement)).otherwise(v)


def upper_limit(v: Column, limit, replacement=None) -> Column:
    """At most ``limit``; or ``replacement`` for values above it."""
    return F.least(F.lit(limit), v) if replacement is None else F.when(v > limit, F.lit(replacement)).otherwise(v)


def masked(v: Column, mask: Column, default) -> Column:
    """The value where the mask is set, else ``default``."""
    return F.when(mask != 0, v).otherwise(F.lit(default))


def masked_id(v: Column, index: Column) -> Column:
    """index + 1 of foreground cells, 0 for background."""
    return F.when(v == 0, F.lit(0)).otherwise(index + 1)


def alive(r: Column, g: Column, b: Column) -> Column:
    """Cell state of a colour: 0 for bright cells, else 1."""
    return F.when(r + g + b > 300, F.lit(0)).otherwise(F.lit(1))


def reaction(r: Column, b: Column) -> list[Column]:
    """The two concentrations that a colour stands for."""
    return [r / 255.0, b / 255.0]


def concentration_colour(v: Column, low: Column, high: Column) -> Column:
    """A concentration scaled between the least and the most, as a byte."""
    return F.coalesce((F.try_divide(v - low, high - low) * 255).cast("int"), F.lit(0))
