"""Numbers as C's printf writes them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _format(x: Column, pattern: str) -> Column:
    return F.call_function("format_number", x, F.lit(pattern))


def general15(x: Column) -> Column:
    """``%.15g`` of values from 0 to below 1e15; null for null."""
    text = F.when(x == 0, F.lit("0"))
    for digits in range(15, 1, -1):  # from large to small: 10**(digits - 1) has digits digits
        text = text.when(x >= 10.0 ** (digits - 1), _format(x, "0." + "#" * (15 - digits)))
    text = text.when(x >= 1, _format(x, "0." + "#" * 14))
    for zeros in range(4):
        text = text.when(x >= 10.0 ** -(zeros + 1), _format(x, "0." + "#" * (15 + zeros)))
    for exponent in range(5, 16):
        text = text.when(x >= 10.0**-exponent, F.concat(_format(x * 10.0**exponent, "0." + "#" * 14), F.lit(f"e-{exponent:02d}")))
    return F.regexp_replace(text, r"\.$", "")


def fixed(x: Column, digits: int) -> Column:
    """``%.<digits>f``."""
    return _format(x, "0." + "0" * digits)


def half_even(x: Column, digits: int) -> Column:
    scale = 10.0**digits
    return F.rint(x * scale) / scale


def like_python(x: Column) -> Column:
    """A float of few digits as Python prints it: whole numbers keep ``.0``."""
    return F.when(x == F.floor(x), fixed(x, 1)).otherwise(general15(x))
