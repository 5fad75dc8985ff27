"""Selections: named ranges, shapes and conditions, all as NaN-safe predicates."""

from __future__ import annotations

import ast
import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nansafe as N


@dataclass
class Filters:
    """Named ranges and flags over one table; a row passes if it passes all."""

    parts: dict[str, Column] = field(default_factory=dict)
    bounds: dict[str, tuple[float | None, float | None, bool]] = field(default_factory=dict)

    def set(self, name: str, lo: float | None = None, hi: float | None = None, invert: bool = False) -> Filters:
        """Inclusive range of a column; ``invert`` is the exact complement, NaN included."""
        self.parts[name] = ~N.between(name, lo, hi) if invert else N.within(name, lo, hi)
        self.bounds[name] = (lo, hi, invert)
        return self

    def set_mask(self, name: str, flag: Column) -> Filters:
        """Any boolean column; rows where it is missing don't pass."""
        self.parts[name] = F.coalesce(flag, F.lit(False))
        return self

    def restrict(self, column: str, values: list) -> Filters:
        """Only rows of the chosen files (prunes partitions if the table is partitioned by them)."""
        self.parts[f"in {column}"] = F.col(column).isin(values)
        return self

    def mask(self, without: tuple[str, ...] = ()) -> Column:
        return reduce(lambda a, b: a & b, (p for n, p in self.parts.items() if n not in without), F.lit(True))

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(self.mask())

    def counts(self, df: DataFrame) -> DataFrame:
        """(filter, n): rows that each filter alone keeps, in one pass."""
        names = [*self.parts]
        one = df.agg(*[F.count_if(self.parts[n]).alias(n) for n in names])
        return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("filter"), F.col(f"`{n}`").alias("n")) for n in names])).alias("r")).select("r.*")


def quantile_range(df: DataFrame, column: str, lower: float = 0.001, upper: float = 0.999) -> DataFrame:
    """(lo, hi) of a column's finite values, by counts in ever narrower bins: no task holds all values."""
    from .phase import quantiles

    row = quantiles(df, N.double(column), (lower, upper))
    return df.sparkSession.createDataFrame([row], "lo double, hi double")


def display_range(df: DataFrame, column: str, times: float = 3.0) -> DataFrame:
    """1 to 99 % quantiles, within the fences ``times`` the quartile distance outside the quartiles."""
    from .phase import quantiles

    row = quantiles(df, N.double(column), (0.01, 0.25, 0.75, 0.99))
    q = df.sparkSession.createDataFrame([row], "q0 double, q1 double, q2 double, q3 double")
    span = times * (F.col("q2") - F.col("q1"))
    return q.select(F.greatest(F.col("q0"), F.col("q1") - span).alias("lo"), F.least(F.col("q3"), F.col("q2") + span).alias("hi"))


def valid(df: DataFrame, columns: list[str], peak: tuple[str, str, str, str] | None = None, farthest: float = math.inf) -> DataFrame:
    """Rows whose columns are finite and, with ``peak`` (x, y, peak x, peak y), lie near their peak."""
    keep = reduce(lambda a, b: a & b, map(N.finite, columns))
    if peak:
        x, y, px, py = map(F.col, peak)
        keep &= (F.abs(x - px) < farthest) & (F.abs(y - py) < farthest)
    return df.where(keep)


def mad_cut(df: DataFrame, column: str, k: float = 3.0) -> DataFrame:
    """Rows not above median + k robust standard deviations; no task holds all values."""
    from .phase import percentile

    x = N.present(column)
    centre = percentile(df, x)
    spread = percentile(df, F.abs(x - F.lit(centre).cast("double")))
    return df.where(N.compare("<=", N.double(column), F.lit((centre or 0.0) + k * 1.4826 * (spread or 0.0))))


def below_quantile(df: DataFrame, column: str, fraction: float, low: bool = True) -> DataFrame:
    """Rows below (or not below) a quantile of the column; no task holds all values."""
    from .phase import percentile

    less = N.compare("<", N.double(column), F.lit(percentile(df, N.present(column), fraction)))
    return df.where(less if low else ~less)


def frame_subset(df: DataFrame, start: int | None, end: int | None, shift: int = 0, frame: str = "frame") -> DataFrame:
    """Frames in [start, end), renumbered by ``shift``."""
    keep = F.lit(True)
    if start is not None:
        keep &= F.col(frame) >= start
    if end is not None:
        keep &= F.col(frame) < end
    return df.where(keep).withColumn(frame, F.col(frame) + shift)


def top_n(df: DataFrame, n: int, column: str, highest: bool = True, row: str = "row_id") -> DataFrame:
    """The n rows with the highest (lowest) value; ties in row order."""
    return df.orderBy(F.desc(column) if highest else F.asc(column), row).limit(n)


# Shapes -----------------------------------------------------------------------------------------------------


@dataclass
class Shape:
    """A region of the plane; its boundary counts as inside.

    kind: rect (x0, y0, x1, y1), circle (x, y, r), ellipse (x, y, a, b, angle), polygon or line (points).
    A line is the band of ``width`` around it.
    """

    kind: str
    numbers: tuple[float, ...] = ()
    points: tuple[tuple[float, float], ...] = ()
    width: float = 0.0

    def inside(self, x: Column, y: Column) -> Column:
        n = self.numbers
        if self.kind == "rect":
            return N.between(x, min(n[0], n[2]), max(n[0], n[2])) & N.between(y, min(n[1], n[3]), max(n[1], n[3]))
        if self.kind == "circle":
            return N.compare("<=", (x - n[0]) * (x - n[0]) + (y - n[1]) * (y - n[1]), F.lit(n[2] ** 2))
        if self.kind == "ellipse":
            c, s = math.cos(n[4]), math.sin(n[4])
            u, v = (x - n[0]) * c + (y - n[1]) * s, (y - n[1]) * c - (x - n[0]) * s
            return N.compare("<=", u * u / n[2] ** 2 + v * v / n[3] ** 2, F.lit(1.0))
        if self.kind == "line":
            return N.compare("<=", self.distance(x, y), F.lit(self.width / 2))
        xs, ys = zip(*self.points, strict=True)
        box = N.between(x, min(xs), max(xs)) & N.between(y, min(ys), max(ys))
        odd = F.lit(0)
        for (x0, y0), (x1, y1) in self.edges():
            if y0 != y1:
                cross = (F.lit(y0) > y) != (F.lit(y1) > y)
                odd = odd + F.when(cross & (x < (y - y0) * ((x1 - x0) / (y1 - y0)) + x0), 1).otherwise(0)
        return box & ((odd % 2 == 1) | (self.distance(x, y) <= 1e-9 * (max(xs) - min(xs) + max(ys) - min(ys))))

    def edges(self) -> list[tuple[tuple[float, float], tuple[float, float]]]:
        p = list(self.points)
        return list(zip(p, p[1:] + (p[:1] if self.kind == "polygon" else []), strict=False))

    def distance(self, x: Column, y: Column) -> Column:
        """To the outline: the nearest of its segments."""
        if self.kind == "circle":
            return F.abs(F.hypot(x - self.numbers[0], y - self.numbers[1]) - self.numbers[2])
        pairs = self.edges()
        if self.kind == "rect":
            a, b, c, d = self.numbers
            pairs = [((a, b), (c, b)), ((c, b), (c, d)), ((c, d), (a, d)), ((a, d), (a, b))]
        out = []
        for (x0, y0), (x1, y1) in pairs:
            dx, dy = x1 - x0, y1 - y0
            norm = dx * dx + dy * dy
            t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - x0) * dx + (y - y0) * dy) / norm)) if norm else F.lit(0.0)
            out.append(F.hypot(x - x0 - t * dx, y - y0 - t * dy))
        return F.least(*out) if len(out) > 1 else out[0]


def remove_region(df: DataFrame, shape: Shape, inside: bool = True, hide: str | None = None, x: str = "x_nm", y: str = "y_nm") -> DataFrame:
    """Rows outside (or inside) a shape; with ``hide`` the rows stay and a 0/1 flag is and-ed to that column."""
    keep = shape.inside(F.col(x), F.col(y))
    keep = ~keep if inside else keep
    if hide is None:
        return df.where(keep)
    old = F.col(hide) if hide in df.columns else F.lit(1.0)
    return df.withColumn(hide, F.when(keep & (old != 0), 1.0).otherwise(0.0).cast("float"))


# Conditions on attributes of regions ------------------------------------------------------------------------


def condition(text: str, names: dict[str, Column]) -> Column:
    """and, or, not, in, comparisons of names with numbers and texts. What is missing compares as false."""

    def false(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    def value(n: ast.expr):
        match n:
            case ast.Name(id=k) if k in names:
                return names[k]
            case ast.Constant(value=v):
                return F.lit(v)
            case ast.UnaryOp(op=ast.USub(), operand=ast.Constant(value=v)):
                return F.lit(-v)
        raise ValueError(f"{ast.unparse(n)} isn't a value here; known: {', '.join(names)}")

    def one(op: ast.cmpop, a: ast.expr, b: ast.expr) -> Column:
        if isinstance(op, (ast.In, ast.NotIn)):
            if not isinstance(b, (ast.List, ast.Tuple)):
                raise ValueError("in needs a list")
            found = false(value(a).isin(*[x.value for x in b.elts if isinstance(x, ast.Constant)]))
            return found if isinstance(op, ast.In) else ~found
        if any(isinstance(x, ast.Constant) and isinstance(x.value, str) for x in (a, b)):
            same = false(value(a) == value(b))
            return {ast.Eq: same, ast.NotEq: ~same}[type(op)]
        sign = {ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Eq: "==", ast.NotEq: "!="}[type(op)]
        x, y = N.double(value(a)), N.double(value(b))
        return false(N.compare(sign, x, y)) & x.isNotNull() & y.isNotNull() & ~F.isnan(F.coalesce(x, F.lit(0.0)))

    def walk(n: ast.expr) -> Column:
        match n:
            case ast.BoolOp(op=op, values=v):
                return reduce((lambda a, b: a & b) if isinstance(op, ast.And) else (lambda a, b: a | b), map(walk, v))
            case ast.UnaryOp(op=ast.Not(), operand=x):
                return ~walk(x)
            case ast.Compare(left=a, ops=ops, comparators=more):
                ends = [a, *more]
                return reduce(lambda p, q: p & q, (one(o, ends[i], ends[i + 1]) for i, o in enumerate(ops)))
            case ast.Name(id=k) if k in names:
                return false(names[k].cast("boolean"))
        raise ValueError(f"{ast.unparse(n)} isn't a condition")

    return walk(ast.parse(text.strip(), mode="eval").body)
