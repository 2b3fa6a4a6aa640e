"""Arithmetic with error modes, rounding, decimals with an overflow flag, and 32-bit chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


_WIDTHS = {8: "byte", 16: "short", 32: "int", 64: "long"}


def multiply(a: Column, b: Column, mode: str = "try", bits: int = 64) -> Column:
    """Product; on overflow ``try`` gives null, ``ansi`` fails and ``wrap`` keeps the low ``bits`` (the integers' width: 8, 16, 32 or 64)."""
    if mode == "wrap" and bits < 64:
        product = a.cast("long") * b.cast("long")
        return F.shiftright(F.shiftleft(product, 64 - bits), 64 - bits).cast(_WIDTHS[bits])
    if mode == "wrap":
        whole = F.lit(str(2**64)).cast("decimal(20,0)")
        low = F.pmod(a.cast("decimal(19,0)") * b.cast("decimal(19,0)"), whole)
        return F.when(low >= F.lit(str(2**63)).cast("decimal(20,0)"), low - whole).otherwise(low).cast("long")
    out = F.try_multiply(a, b)
    if mode == "try":
        return out
    if mode != "ansi":
        raise ValueError("mode must be try, ansi or wrap")
    return F.when(a.isNotNull() & b.isNotNull() & out.isNull(), F.raise_error(F.lit("overflow in multiplication"))).otherwise(out)


def round_half_up(col: Column, digits: int = 0) -> Column:
    return F.round(col, digits)


def round_half_even(col: Column, digits: int = 0) -> Column:
    return F.bround(col, digits)


_OPS = {"add": F.try_add, "subtract": F.try_subtract, "multiply": F.try_multiply, "divide": F.try_divide, "remainder": F.try_mod}


def with_overflow(op: str, a: Column, b: Column) -> Column:
    """struct(overflow, result) of a decimal operation; overflow also marks division by zero."""
    out = _OPS[op](a, b)
    return F.struct((out.isNull() & a.isNotNull() & b.isNotNull()).alias("overflow"), out.alias("result"))


def low_chunk(col: Column) -> Column:
    """The low 32 bits of a long, unsigned."""
    return col.bitwiseAND(F.lit(0xFFFFFFFF))


def high_chunk(col: Column) -> Column:
    """The high 32 bits of a long, signed."""
    return F.shiftright(col, 32)


def sum_with_overflow(col: Column) -> Column:
    """Aggregate: struct(overflow, sum) of a long column; the sum is exact and null on overflow."""
    total = F.sum(col.cast("decimal(20,0)"))
    out = (total < F.lit(str(-(2**63))).cast("decimal(38,0)")) | (total > F.lit(str(2**63 - 1)).cast("decimal(38,0)"))
    return F.struct(out.alias("overflow"), F.when(~out, total.cast("long")).alias("sum"))
