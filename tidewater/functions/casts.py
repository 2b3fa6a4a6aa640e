"""String, number and time casts with explicit error modes, and string functions over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("try", "ansi")


def _cast(col: Column, kind: str, mode: str) -> Column:
    """``try`` gives null for what can't be cast, ``ansi`` fails the query."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "try":
        return col.try_cast(kind)
    return F.when(col.isNotNull() & col.try_cast(kind).isNull(), F.raise_error(F.concat(F.lit(f"cannot cast to {kind}: "), col.cast("string")))).otherwise(col.try_cast(kind))


def to_integer(col: Column, kind: str = "int", strip: bool = True, mode: str = "try") -> Column:
    """Integer of a string: surrounding characters up to the space are allowed only with ``strip``; ``12.9`` gives 12 in try mode."""
    if mode == "try":
        whole = F.regexp_replace(F.regexp_replace(col, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"^([+-]?[0-9]+)\.[0-9]*$", "$1")
        whole = F.regexp_replace(whole, r"^([+-]?)\.[0-9]+$", "$10")
        out = whole.try_cast(kind)
    else:
        out = _cast(col, kind, mode)
    return out if strip else F.when(F.regexp_like(col, F.lit(r"^[^\x00-\x20].*[^\x00-\x20]$|^[^\x00-\x20]$")), out)


def to_decimal(col: Column, precision: int, scale: int, mode: str = "try") -> Column:
    return _cast(F.trim(col) if mode == "try" else col, f"decimal({precision},{scale})", mode)


def to_double(col: Column, mode: str = "try") -> Column:
    return _cast(col, "double", mode)


def to_timestamp(col: Column, mode: str = "try") -> Column:
    return _cast(col, "timestamp", mode)


def to_date(col: Column, mode: str = "try") -> Column:
    return _cast(col, "date", mode)


def to_base(col: Column, base: int, width: int = 64) -> Column:
    """Text of an integer in base 10 or 16; hexadecimal is the two's complement at the given bit width."""
    if base == 10:
        return col.cast("string")
    if base != 16:
        raise ValueError("base must be 10 or 16")
    digits = F.hex(col.cast("long"))
    return F.when(col < 0, F.substring(digits, 17 - width // 4, width // 4)).otherwise(digits)


def from_base(col: Column, base: int) -> Column:
    """Long of the leading valid digits of a text in base 10 or 16, as 64 bits; null without any, or if they exceed 64 unsigned bits."""
    if base not in (10, 16):
        raise ValueError("base must be 10 or 16")
    digits = F.regexp_extract(col, r"^\s*(-?[0-9]+)" if base == 10 else r"^\s*(-?[0-9A-Fa-f]+)", 1)
    bare, most = F.upper(F.regexp_replace(digits, "^-?0*", "")), "18446744073709551615" if base == 10 else "F" * 16
    fits = (F.length(bare) < len(most)) | ((F.length(bare) == len(most)) & (bare <= most))
    return F.conv(F.when((digits != "") & fits, digits), base, -10).try_cast("long")


def convert_base(col: Column, source: Column | int, target: Column | int) -> Column:
    """Text of a number in base ``source`` as text in base ``target``, unsigned 64-bit; bases may vary by row."""
    return F.call_function("conv", col, *(x if isinstance(x, Column) else F.lit(x) for x in (source, target)))


def float_to_decimal(col: Column, precision: int, scale: int, mode: str = "try") -> Column:
    """Decimal of a float or double, rounded half up; what doesn't fit gives null or fails."""
    return _cast(col, f"decimal({precision},{scale})", mode)


def conv_overflows(col: Column, base: int) -> Column:
    """True where the text's leading digits in ``base`` (2 to 36) exceed 64 unsigned bits."""
    if not 2 <= base <= 36:
        raise ValueError("base must be 2 to 36")
    symbols = "0123456789abcdefghijklmnopqrstuvwxyz"[:base]
    digits = F.regexp_extract(F.lower(col), f"^ *-?0*([{symbols}]+)", 1)
    most, n = "", 2**64 - 1
    while n:
        most, n = symbols[n % base] + most, n // base
    return (F.length(digits) > len(most)) | ((F.length(digits) == len(most)) & (digits > most))


def contains_literal_range(col: Column, literal: str, low: str, high: str, count: int) -> Column:
    """Whether a text holds the literal followed by ``count`` characters between low and high; a
    plain search for the literal goes before the pattern."""
    import re

    return col.contains(literal) & F.regexp_like(col, F.lit(re.escape(literal) + f"[{re.escape(low)}-{re.escape(high)}]{{{count},}}"))
