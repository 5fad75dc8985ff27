"""A small, safe expression language for derived columns, compiled to Spark columns.

The text is parsed to a Python syntax tree of which a whitelist is compiled; nothing is evaluated. Arithmetic
follows IEEE rules. Reductions over the whole column (``mean(x)`` and so on) are found first, computed in one
aggregate and put in as numbers.
"""

from __future__ import annotations

import ast
import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import nansafe as N


class ExpressionError(ValueError):
    pass


CONSTANTS = {"pi": math.pi, "e": math.e, "nan": math.nan, "inf": math.inf, "True": True, "False": False}

_ONE: dict[str, Callable[[Column], Column]] = {
    "sqrt": lambda x: F.sqrt(N.double(x)),
    "abs": F.abs,
    "exp": lambda x: F.exp(N.double(x)),
    "log": N.logarithm,
    "log2": lambda x: N.logarithm(x, 2),
    "log10": lambda x: N.logarithm(x, 10),
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "arcsin": F.asin,
    "arccos": F.acos,
    "arctan": F.atan,
    "floor": lambda x: F.floor(N.double(x)).cast("double"),
    "ceil": lambda x: F.ceil(N.double(x)).cast("double"),
    "round": lambda x: F.bround(N.double(x)),
    "sign": lambda x: F.signum(N.double(x)),
    "isfinite": N.finite,
    "isnan": lambda x: F.coalesce(F.isnan(N.double(x)), F.lit(True)),
    "float": N.double,
    "int": lambda x: F.when(N.finite(x), N.double(x)).cast("long"),
}
_TWO: dict[str, Callable[[Column, Column], Column]] = {
    "arctan2": F.atan2,
    "hypot": F.hypot,
    "mod": N.floor_mod,
    "rem": N.floor_mod,
    "minimum": N.lowest,
    "maximum": N.highest,
}
_REDUCE: dict[str, Callable[..., Column]] = {
    "mean": lambda x: F.avg(N.present(x)),
    "median": lambda x: F.median(N.present(x)),
    "std": lambda x: F.stddev_pop(N.present(x)),
    "sum": lambda x: F.coalesce(F.sum(N.present(x)), F.lit(0.0)),
    "min": lambda x: F.min(N.present(x)),
    "max": lambda x: F.max(N.present(x)),
    "percentile": lambda x, q=50: F.percentile(N.present(x), float(q) / 100),
    "count": lambda x: F.count(F.lit(1)).cast("double"),
}
_MANY = {"where": 3, "clip": 3}
_COMPARE = {ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Eq: "==", ast.NotEq: "!="}
FUNCTIONS = {*_ONE, *_TWO, *_REDUCE, *_MANY}


def parse(text: str) -> ast.expr:
    try:
        return ast.parse(text.strip(), mode="eval").body
    except SyntaxError as error:
        raise ExpressionError(f"{text!r} can't be read: {error.msg}") from None


def names_in(text: str) -> set[str]:
    """The columns that an expression reads."""
    return {n.id for n in ast.walk(parse(text)) if isinstance(n, ast.Name)} - FUNCTIONS - CONSTANTS.keys()


def rename_in(text: str, old: str, new: str) -> str:
    """The expression with one column renamed, all other text kept."""
    lead = len(text) - len(text.lstrip())
    at = [n.col_offset for n in ast.walk(parse(text)) if isinstance(n, ast.Name) and n.id == old]
    raw = text[lead:].encode()
    for i in sorted(at, reverse=True):
        raw = raw[:i] + new.encode() + raw[i + len(old.encode()) :]
    return text[:lead] + raw.decode()


@dataclass
class Compiled:
    column: Column
    kind: str  # float, int or bool


class Compiler:
    """Compiles a syntax tree over the columns of a schema, with reductions already known."""

    def __init__(self, schema: T.StructType, text: str, known: dict[str, float] | None = None, extra: dict[str, Column] | None = None):
        self.fields, self.text, self.known, self.extra = {f.name: f.dataType for f in schema.fields}, text, known or {}, extra or {}
        self.asked: dict[str, Column] = {}

    def fail(self, why: str):
        raise ExpressionError(f"{self.text!r}: {why}")

    def name(self, n: str) -> Compiled:
        if n in self.extra:
            return Compiled(self.extra[n], "float")
        if n in self.fields:
            t = self.fields[n]
            kind = "bool" if isinstance(t, T.BooleanType) else "int" if isinstance(t, T.IntegralType) else "float"
            if not isinstance(t, (T.BooleanType, T.NumericType)):
                self.fail(f"{n} isn't a number")
            return Compiled(F.col(f"`{n}`"), kind)
        if n in CONSTANTS:
            v = CONSTANTS[n]
            return Compiled(F.lit(v), "bool" if isinstance(v, bool) else "float")
        self.fail(f"there is no column {n}; the table has {', '.join(self.fields)}")

    def number(self, c: Compiled) -> Column:
        return c.column.cast("double") if c.kind != "int" else c.column

    def visit(self, node: ast.expr) -> Compiled:
        match node:
            case ast.Constant(value=bool(v)):
                return Compiled(F.lit(v), "bool")
            case ast.Constant(value=int(v)):
                return Compiled(F.lit(v).cast("long"), "int")
            case ast.Constant(value=float(v)):
                return Compiled(F.lit(v), "float")
            case ast.Name(id=n):
                return self.name(n)
            case ast.UnaryOp(op=ast.USub(), operand=x):
                x = self.visit(x)
                return Compiled(-self.number(x), "int" if x.kind == "int" else "float")
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return self.visit(x)
            case ast.UnaryOp(op=ast.Invert(), operand=x):
                x = self.visit(x)
                if x.kind == "float":
                    self.fail("~ is for comparisons and whole numbers; put brackets around the comparison")
                return Compiled(~x.column if x.kind == "bool" else F.bitwise_not(x.column), x.kind)
            case ast.BinOp(left=a, op=op, right=b):
                return self.binary(op, self.visit(a), self.visit(b))
            case ast.Compare(left=a, ops=[op], comparators=[b]) if type(op) in _COMPARE:
                return Compiled(N.compare(_COMPARE[type(op)], self.number(self.visit(a)), self.number(self.visit(b))), "bool")
            case ast.Compare():
                self.fail("write a chain of comparisons as (a < b) & (b < c)")
            case ast.BoolOp() | ast.UnaryOp(op=ast.Not()):
                self.fail("write & for and, | for or, ~ for not, with brackets around comparisons")
            case ast.IfExp(test=t, body=a, orelse=b):
                return self.where(self.visit(t), self.visit(a), self.visit(b))
            case ast.Call(func=ast.Name(id=f), args=args, keywords=[]):
                return self.call(f, args, node)
        self.fail("only numbers, columns, operators and the listed functions are allowed")

    def where(self, t: Compiled, a: Compiled, b: Compiled) -> Compiled:
        test = t.column if t.kind == "bool" else self.number(t) != 0
        kind = a.kind if a.kind == b.kind else "float"
        x, y = (a.column, b.column) if kind != "float" else (self.number(a).cast("double"), self.number(b).cast("double"))
        return Compiled(F.when(test, x).otherwise(y), kind)

    def binary(self, op: ast.operator, a: Compiled, b: Compiled) -> Compiled:
        if isinstance(op, (ast.BitAnd, ast.BitOr, ast.BitXor)):
            if "float" in (a.kind, b.kind):
                self.fail("& | ^ are for comparisons and whole numbers; put brackets around comparisons")
            if a.kind == b.kind == "bool":
                made = {ast.BitAnd: a.column & b.column, ast.BitOr: a.column | b.column, ast.BitXor: a.column != b.column}
                return Compiled(made[type(op)], "bool")
            x, y = a.column.cast("long"), b.column.cast("long")
            return Compiled({ast.BitAnd: x.bitwiseAND(y), ast.BitOr: x.bitwiseOR(y), ast.BitXor: x.bitwiseXOR(y)}[type(op)], "int")
        whole = a.kind != "float" and b.kind != "float"
        x, y = (a.column.cast("long"), b.column.cast("long")) if whole else (self.number(a).cast("double"), self.number(b).cast("double"))
        match op:
            case ast.Add():
                made = x + y
            case ast.Sub():
                made = x - y
            case ast.Mult():
                made = x * y
            case ast.Div():
                return Compiled(N.divide(x, y), "float")
            case ast.FloorDiv():
                d = N.divide(x, y)
                made = F.when(N.finite(d), F.floor(d).cast("double")).otherwise(d)
                return Compiled(made.cast("long") if whole else made, "int" if whole else "float")
            case ast.Mod():
                made = N.floor_mod(x, y)
                return Compiled(made.cast("long") if whole else made, "int" if whole else "float")
            case ast.Pow():
                return Compiled(F.pow(x.cast("double"), y.cast("double")), "float")
            case _:
                self.fail("this operator isn't allowed")
        return Compiled(made, "int" if whole else "float")

    def call(self, f: str, args: list[ast.expr], node: ast.Call) -> Compiled:
        if f in _REDUCE:
            key = ast.unparse(node)
            if key in self.known:
                return Compiled(F.lit(self.known[key]), "float")
            more = [a.value for a in args[1:] if isinstance(a, ast.Constant)]
            self.asked[key] = _REDUCE[f](self.number(self.visit(args[0])), *more)
            return Compiled(F.lit(math.nan), "float")
        got = [self.visit(a) for a in args]
        if f in _ONE and len(got) == 1:
            kind = "bool" if f.startswith("is") else "int" if f == "int" or (f == "abs" and got[0].kind == "int") else "float"
            return Compiled(_ONE[f](self.number(got[0])), kind)
        if f in _TWO and len(got) == 2:
            return Compiled(_TWO[f](self.number(got[0]), self.number(got[1])), "float")
        if f == "where" and len(got) == 3:
            return self.where(*got)
        if f == "clip" and len(got) == 3:
            x, lo, hi = map(self.number, got)
            return Compiled(N.lowest(N.highest(x, lo), hi), "float")
        self.fail(f"{f} isn't a function here, or has other arguments")


def evaluate(df: DataFrame, text: str, extra: dict[str, Column] | None = None) -> Compiled:
    """The expression as a column of ``df``; runs one aggregate if it holds reductions."""
    tree, known = parse(text), {}
    while True:
        c = Compiler(df.schema, text, known, extra)
        made = c.visit(tree)
        new = {k: v for k, v in c.asked.items() if k not in known}
        if not new:
            return made
        inner = [k for k in new if not any(k != o and o in k for o in new)]  # the innermost first
        row = df.agg(*[new[k].cast("double").alias(f"r{i}") for i, k in enumerate(inner)]).first()
        known |= {k: math.nan if row[i] is None else row[i] for i, k in enumerate(inner)}


def stored(c: Compiled, exact: bool = False) -> Column:
    """As a table keeps it: flags as 0 or 1, floats as float (double if ``exact``), missing as NaN."""
    if c.kind == "int":
        return c.column
    out = N.filled(c.column.cast("double") if c.kind != "bool" else c.column.cast("int"))
    return out if exact else out.cast("float")


def with_expression(df: DataFrame, name: str, text: str, where: Column | None = None, exact: bool = False) -> DataFrame:
    """``df`` with a derived column; NaN outside ``where``."""
    made = stored(evaluate(df, text), exact)
    return df.withColumn(name, made if where is None else F.when(where, made.cast("double")).otherwise(F.lit(math.nan)).cast("double" if exact else "float"))


@dataclass
class Recipe:
    """A derived column that is made again when the table it belongs to changes."""

    name: str
    text: str
    rule: str = "recompute"  # or mean sum min max any all none, for grouped tables


@dataclass
class Recipes:
    """Recipes in an order in which each reads only what is there before it."""

    items: list[Recipe] = field(default_factory=list)

    def add(self, r: Recipe) -> None:
        if r.name in names_in(r.text):
            raise ExpressionError(f"{r.name} can't read itself")
        self.items = [x for x in self.items if x.name != r.name] + [r]

    def ordered(self) -> list[Recipe]:
        left, done, out = list(self.items), set(), []
        names = {r.name for r in left}
        while left:
            ready = [r for r in left if not (names_in(r.text) & names - done)]
            if not ready:
                raise ExpressionError("recipes read each other in a circle")
            out += ready
            done |= {r.name for r in ready}
            left = [r for r in left if r not in ready]
        return out

    def apply(self, df: DataFrame, only: Iterable[str] | None = None) -> DataFrame:
        for r in self.ordered():
            if only is None or r.name in only:
                df = with_expression(df, r.name, r.text)
        return df

    def renamed(self, old: str, new: str) -> Recipes:
        return Recipes([Recipe(new if r.name == old else r.name, rename_in(r.text, old, new), r.rule) for r in self.items])

    def without(self, gone: Iterable[str]) -> Recipes:
        """Without the removed columns; what read them becomes plain values."""
        gone = set(gone)
        return Recipes([r for r in self.items if r.name not in gone and not names_in(r.text) & gone])
