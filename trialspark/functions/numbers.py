"""Numeric column helpers that keep Python's rounding and formatting rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def clamp(x: Column, lo, hi) -> Column:
    """max(lo, min(x, hi)); bounds may be columns."""
    return F.greatest(F.least(x, _same(hi)), _same(lo))


def _same(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def half_even(x: Column) -> Column:
    """round(x) with ties to even, as an integer; null beyond 32 bits."""
    return F.rint(x).try_cast("int")


def round_even(x: Column, digits: int) -> Column:
    """round(x, digits) by scaling, ties to even."""
    scale = float(10 ** digits)
    return F.rint(x * F.lit(scale)) / F.lit(scale)


def fixed_text(x: Column, digits: int) -> Column:
    """'%.<digits>f': correctly rounded decimal text, ties to even."""
    return F.call_function("format_number", x, F.lit("0." + "0" * digits if digits else "0"))


def short_text(x: Column, digits: int = 2) -> Column:
    """Shortest decimal text (like '%g') of a value with at most `digits` places."""
    return F.regexp_replace(fixed_text(x, digits), r"\.?0+$", "")


def soft_level(x: Column, mid: float) -> Column:
    """x / (x + mid) with x cut at zero; 0 when the midpoint is not positive."""
    if mid <= 0:
        return F.lit(0.0)
    v = F.greatest(x, F.lit(0.0))
    return v / (v + F.lit(float(mid)))


def nz(x: Column, default) -> Column:
    """`x or default`: zero and null both take the default."""
    return F.coalesce(F.nullif(x, F.lit(0.0)), _same(default))


def ladder(*rules, otherwise=None) -> Column:
    """First matching rule wins: ladder((cond, value), ..., otherwise=value)."""
    out = None
    for cond, value in rules:
        value = _same(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(_same(otherwise)) if otherwise is not None else out
