"""Functions on arrays of samples or spectral values."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantize(x: Column) -> Column:
    """A sample to 16 bits: times 32768, held within the range, truncated; 0 for NaN."""
    held = F.greatest(F.lit(-32768.0), F.least(F.lit(32767.0), x.cast("double") * 32768))
    return F.when(F.isnan(x), F.lit(0).cast("short")).otherwise(held.cast("short"))


def interleave(planar: Column) -> Column:
    """Channel arrays to one array, sample by sample."""
    n = F.size(planar[0])
    return F.when(n == 0, F.slice(planar[0], 1, 0)).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(planar, lambda c: F.get(c, i)))))


def deinterleave(x: Column, channels: int) -> Column:
    """Channel arrays of an interleaved array."""
    pick = lambda j: F.filter(x, lambda _, i: F.pmod(i, F.lit(channels)) == j)
    return F.array(*[pick(j) for j in range(channels)])


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def inverse_couple(m: Column, a: Column) -> Column:
    """Magnitudes and angles to structs of two channels."""

    def pair(x: Column, y: Column) -> Column:
        first = F.when((x > 0) & (y <= 0), x + y).when((x <= 0) & (y <= 0), x - y).otherwise(x)
        second = F.when((x > 0) & (y > 0), x - y).when((x <= 0) & (y > 0), x + y).otherwise(x)
        return F.struct(first.alias("first"), second.alias("second"))

    return F.zip_with(m, a, pair)


def window_slope(n: int) -> Column:
    """Rising half of the window, n values."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.sin(F.lit(math.pi / 2) * F.pow(F.sin(F.lit(math.pi / 2) * ((i + 0.5) / n)), F.lit(2.0))))


def db_value(i: Column) -> Column:
    """Floor value of level i, 0 to 255."""
    return F.pow(F.lit(10.0), 7.0 * (i + 1) / 256 - 7)


def bark(x: Column) -> Column:
    return 13.1 * F.atan(0.00074 * x) + 2.24 * F.atan(0.0000000185 * x * x) + 0.0001 * x


def bark_cos(i: Column, n: int, rate: int, size: int) -> Column:
    """cos of omega of spectral line i of n."""
    at = F.floor(bark(F.lit(rate / (2.0 * n)) * i) * size / bark(F.lit(0.5 * rate)))
    return F.cos(F.lit(math.pi) * F.least(F.lit(size - 1).cast("long"), at) / size)


def imdct(x: Column, half: int) -> Column:
    """2 * half values from half, by the definition.

    cos(pi / half * (n + 1/2 + half / 2) * (k + 1/2)) has the period 8 * half in (2n + 1 + half)(2k + 1), so one
    period of cosines is a constant array and each term a product with one of its values. With the
    symmetries of the two halves, half of the sums are enough.
    """
    waves = F.array(*[F.lit(math.cos(math.pi * j / (4 * half))) for j in range(8 * half)])

    def value(n: Column) -> Column:
        odd = 2 * n + (1 + half)
        return F.aggregate(
            F.zip_with(x, F.sequence(F.lit(0), F.lit(half - 1)), lambda v, k: v.cast("double") * F.get(waves, F.pmod(odd * (2 * k + 1), F.lit(8 * half)))),
            F.lit(0.0), lambda a, t: a + t
        )

    # y[half - 1 - n] = -y[n] in the first half, y[3 * half - 1 - n] = y[n] in the second
    quarter, third = F.sequence(F.lit(0), F.lit(half // 2 - 1)), F.sequence(F.lit(half), F.lit(half + half // 2 - 1))
    left, right = F.transform(quarter, value), F.transform(third, value)
    return F.element_at(
        F.transform(
            F.array(F.struct(left.alias("l"), right.alias("r"))),
            lambda s: F.concat(s["l"], F.transform(F.reverse(s["l"]), lambda v: -v), s["r"], F.reverse(s["r"]))
        ),
        1
    )


def overlap_add(fresh: Column, before: Column, slope: Column) -> Column:
    """Samples of a block (fresh) with the half of the block before it; none without one.

    slope is the rising window; before may be shorter than it, and what comes after its end is kept.
    """
    n, s = F.size(before), F.size(slope)
    mixed = F.transform(before, lambda p, i: F.get(fresh, i) * F.get(slope, i) + p * F.get(slope, s - 1 - i))
    rest = F.slice(fresh, n + 1, F.greatest(F.size(fresh) - n, F.lit(0)))
    return F.when(before.isNull(), F.slice(fresh, 1, 0)).otherwise(F.concat(mixed, rest))


def eps_mismatch(a: Column, b: Column, eps: float) -> Column:
    """Number of places where two arrays differ by eps or more, up to the end of the shorter."""
    n = F.least(F.size(a), F.size(b))
    return F.size(F.filter(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.abs(x - y)), lambda d: d >= eps))


def block_geometry(n: Column, short: int | Column, long: Column, prev_long: Column, next_long: Column) -> Column:
    """Struct of left, left_end, right and end of a block (see operators.decode.block_shape)."""
    q = F.lit(short // 4) if isinstance(short, int) else F.floor(short / 4).cast("int")
    div = lambda x, k: F.floor(x / k).cast("int")
    narrow_left, narrow_right = long & ~prev_long, long & ~next_long
    return F.struct(
        F.when(narrow_left, div(n, 4) - q).otherwise(0).cast("int").alias("left"), F.when(narrow_left, div(n, 4) + q).otherwise(div(n, 2)).cast("int").alias("left_end"),
        F.when(narrow_right, div(3 * n, 4) - q).otherwise(div(n, 2)).cast("int").alias("right"), F.when(narrow_right, div(3 * n, 4) + q).otherwise(n).cast("int").alias("end"),
    )
