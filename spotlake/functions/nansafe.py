"""Column helpers with IEEE semantics: NaN compares false, division gives infinities, NULL is a missing value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def double(c: Column | str) -> Column:
    return col(c).cast("double")


def present(c: Column | str) -> Column:
    """NaN to NULL: for the input of an aggregate."""
    d = double(c)
    return F.when(~F.isnan(d), d)


def filled(c: Column | str) -> Column:
    """NULL to NaN: for a stored result."""
    return F.coalesce(double(c), F.lit(NAN))


def finite(c: Column | str) -> Column:
    d = double(c)
    return F.coalesce(~F.isnan(d) & (F.abs(d) < F.lit(INF)), F.lit(False))


def divide(a: Column, b: Column) -> Column:
    """a / b with signed infinities and NaN instead of an error."""
    a, b = double(a), double(b)
    at_zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def floor_mod(a: Column, b: Column) -> Column:
    """Remainder with the divisor's sign."""
    return F.when(double(b) == 0, F.lit(NAN)).otherwise(double(a) - F.floor(divide(a, b)).cast("double") * double(b))


def compare(op: str, a: Column, b: Column) -> Column:
    """A comparison that is false with NaN on either side (and true for != )."""
    a, b = double(a), double(b)
    ok = ~F.isnan(a) & ~F.isnan(b) & a.isNotNull() & b.isNotNull()
    made = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "==": a == b, "!=": a != b}[op]
    return F.when(ok, made).otherwise(F.lit(op == "!="))


def between(c: Column | str, lo: float | None, hi: float | None) -> Column:
    """lo <= c <= hi, an open end where None; NaN fails any bound."""
    d = double(c)
    parts = ([compare(">=", d, F.lit(float(lo)))] if lo is not None else []) + ([compare("<=", d, F.lit(float(hi)))] if hi is not None else [])
    return reduce(lambda x, y: x & y, parts, F.lit(True))


def within(c: Column | str, lo: float | None, hi: float | None) -> Column:
    """As ``between`` for a filter: plain comparisons, which reach the scan; NULL where the value is missing."""
    x = col(c)
    parts = ([x >= lo] if lo is not None else []) + ([x <= hi] if hi is not None else [])
    return reduce(lambda a, b: a & b, [*parts, ~F.isnan(x)] if parts else [F.lit(True)])


def logarithm(c: Column, base: float | None = None) -> Column:
    d = double(c)
    made = F.log(d) if base is None else {2: F.log2, 10: F.log10}[base](d)
    return F.when(F.isnan(d) | (d < 0), F.lit(NAN)).when(d == 0, F.lit(-INF)).otherwise(made)


def lowest(a: Column, b: Column) -> Column:
    return F.when(F.isnan(double(a)) | F.isnan(double(b)), F.lit(NAN)).otherwise(F.least(double(a), double(b)))


def highest(a: Column, b: Column) -> Column:
    return F.when(F.isnan(double(a)) | F.isnan(double(b)), F.lit(NAN)).otherwise(F.greatest(double(a), double(b)))
