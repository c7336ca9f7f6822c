"""Strict int4 arithmetic on columns.

Under ANSI mode Spark's ``+ - * %`` and unary minus already raise on overflow
and on a zero divisor. Division is the exception: ``/`` yields a double and
``div`` a bigint, so it is narrowed here with a checked cast.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def int_div(a, b) -> Column:
    """Truncating int4 division; a zero divisor and INT_MIN / -1 raise."""
    return F.call_function("div", _col(a).cast("int"), _col(b).cast("int")).cast("int")


def int_mod(a, b) -> Column:
    """Remainder with the sign of the dividend."""
    return _col(a).cast("int") % _col(b).cast("int")


def int_neg(a) -> Column:
    return -_col(a).cast("int")


def _mul32(h: Column, k: int) -> Column:
    """h * k mod 2**32 by 16-bit halves, so that no bigint product overflows."""
    low, high = h.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(h, 16)
    return (low * F.lit(k) + F.shiftleft((high * F.lit(k)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(0xFFFFFFFF))


def murmur32(a) -> Column:
    """Finalizer of the 32-bit murmur hash, as an unsigned value in a bigint."""
    h = _col(a).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))
    h = h.bitwiseXOR(F.shiftrightunsigned(h, 16))
    h = _mul32(h, 2246822507)
    h = h.bitwiseXOR(F.shiftrightunsigned(h, 13))
    h = _mul32(h, 3266489909)
    return h.bitwiseXOR(F.shiftrightunsigned(h, 16))
