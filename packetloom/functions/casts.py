"""Tolerant numeric reading of text cells, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def to_double(c: Column) -> Column:
    """A plain decimal number, or null.  (Spark's own cast would also take "24d".)"""
    text = c.cast("string")
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def first_number(*candidates: Column, default: float = 0.0) -> Column:
    """The first candidate that reads as a number."""
    return F.coalesce(*(to_double(c) for c in candidates), F.lit(float(default)))


def to_int(c: Column, default: int = 0) -> Column:
    """The number cut towards zero."""
    return F.coalesce(to_double(c).cast("long"), F.lit(default).cast("long"))


def tcp_flags(c: Column) -> Column:
    """Flags written as a decimal number, else as hexadecimal with or without 0x, else 0."""
    digits = F.regexp_extract(F.trim(c.cast("string")), r"^(?:0[xX])?([0-9A-Fa-f]{1,8})$", 1)
    return F.coalesce(to_double(c), F.when(digits != "", F.conv(digits, 16, 10).cast("double")), F.lit(0.0))


def ratio(x: Column, y: Column) -> Column:
    """x / y, 0 where y is not positive."""
    return F.when(y > 0, x / y).otherwise(F.lit(0.0))
