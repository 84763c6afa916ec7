"""Bit-field and integer functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def low_mask(n: int | Column) -> Column:
    return F.pow(F.lit(2), F.lit(n) if isinstance(n, int) else n).cast("long") - 1


def byte_mask(n: Column) -> Column:
    """As low_mask, but 0 stands for a whole byte."""
    return F.when(n == 0, F.lit(255).cast("long")).otherwise(low_mask(n))


def bit_field(x: Column, at: int, width: int) -> Column:
    """Unsigned field of width bits from bit at."""
    return F.shiftright(x.cast("long"), at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def field_of(x: Column, at: Column, width: Column) -> Column:
    """As bit_field, with a place and a width (up to 31) for each row; no width: 0."""
    return F.pmod(F.floor(x.cast("decimal(20,0)") / F.pow(F.lit(2), at).cast("decimal(20,0)")).cast("long"), F.pow(F.lit(2), width).cast("long"))


def sign_extend(x: Column, width: int) -> Column:
    """The low width bits as a signed number."""
    return F.shiftright(F.shiftleft(x.cast("long"), 64 - width), 64 - width)


def ilog(x: Column) -> Column:
    """Position of the highest set bit, from 1; 0 for 0."""
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x.cast("long"))))


def bit_reverse(x: Column) -> Column:
    """The low 32 bits in reverse."""
    return F.conv(F.reverse(F.lpad(F.bin(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 32, "0")), 2, 10).cast("long")


def packed_float(raw: Column) -> Column:
    """Sign in bit 31, exponent (less 788) in bits 21 to 30, mantissa below."""
    mantissa = bit_field(raw, 0, 21).cast("double")
    value = mantissa * F.pow(F.lit(2.0), (bit_field(raw, 21, 10) - 788).cast("double"))
    return F.when(bit_field(raw, 31, 1) == 1, -value).otherwise(value)


def nth_root(entries: Column, dims: int) -> Column:
    """Greatest r with r to the power dims at most entries."""
    guess = F.floor(F.pow(entries.cast("double"), F.lit(1.0 / dims))).cast("long")
    fits = lambda r: F.pow(r.cast("double"), F.lit(float(dims))) <= entries
    return F.when(fits(guess + 1), guess + 1).when(fits(guess), guess).otherwise(guess - 1)


def radix_digits(x: Column, base: int, n: int) -> Column:
    """n digits of x in the base, most significant first."""
    return F.transform(F.sequence(F.lit(n - 1), F.lit(0), F.lit(-1)), lambda i: F.pmod(F.floor(x / F.pow(F.lit(float(base)), i.cast("double"))), F.lit(base)).cast("int"))


def render_point(x0: Column, y0: Column, x1: Column, y1: Column, x: Column) -> Column:
    """Integer line from (x0, y0) to (x1, y1) at x, truncated towards y0."""
    step = F.floor((F.abs(y1 - y0) * (x - x0)) / (x1 - x0)).cast("long")
    return F.when(y1 >= y0, y0 + step).otherwise(y0 - step)


def prefix_neighbor(seen: Column, x: Column, low: bool) -> tuple[Column, Column]:
    """The nearest smaller (or larger) value among those seen before x, and its place, the first of equal ones; null without one."""
    found = F.array_max(F.filter(seen, lambda v: v < x)) if low else F.array_min(F.filter(seen, lambda v: v > x))
    return found, F.array_position(seen, found) - 1
