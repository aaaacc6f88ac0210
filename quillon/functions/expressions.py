"""Expressions as values: built once, checked against a schema without coercion, turned into Spark columns.

Semantics: three-valued logic; NULL with any other operator gives NULL; int + - * wrap
around at 32 bits; int / truncates towards zero and fails on 0. All are built-in column
expressions, so that Catalyst sees through them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import ColumnOutOfBounds, DivisionByZero, FunctionArgumentCount, InvalidOperandTypes, TypeMismatch, UnknownFunction
from quillon.functions.types import same

ARITHMETIC = {"+", "-", "*", "/", "%"}
COMPARISONS = {"=", "<>", "<", "<=", ">", ">="}
LOGICAL = {"AND", "OR"}


def wrap_int(e: Column) -> Column:
    """The low 32 bits of a bigint as a signed int."""
    return (F.pmod(e + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)).cast("int")


def int_div(a: Column, b: Column) -> Column:
    """Integer division towards zero as an int; the least int by -1 wraps, 0 fails."""
    a, b = a.cast("bigint"), b.cast("bigint")
    # what the remainder leaves divides without rest, and a double holds such quotients exactly
    return wrap_int(((a - a % b) / b).cast("bigint"))


class Expr:
    """Base of expressions. Operators build larger ones; `==` compares expressions as values, `eq` builds a comparison."""

    def column(self, schema: T.StructType) -> Column:
        raise NotImplementedError

    def type(self, schema: T.StructType) -> T.DataType | None:
        """The static type, None for NULL; raises if a part doesn't fit."""
        raise NotImplementedError

    def parts(self) -> tuple[Expr, ...]:
        return ()

    def is_constant(self) -> bool:
        return all(p.is_constant() for p in self.parts())

    def _two(self, op: str, other: Any) -> Binary:
        return Binary(op, self, as_expr(other))

    def eq(self, other: Any) -> Binary:
        return self._two("=", other)

    def ne(self, other: Any) -> Binary:
        return self._two("<>", other)

    def lt(self, other: Any) -> Binary:
        return self._two("<", other)

    def le(self, other: Any) -> Binary:
        return self._two("<=", other)

    def gt(self, other: Any) -> Binary:
        return self._two(">", other)

    def ge(self, other: Any) -> Binary:
        return self._two(">=", other)

    def __add__(self, other: Any) -> Binary:
        return self._two("+", other)

    def __sub__(self, other: Any) -> Binary:
        return self._two("-", other)

    def __mul__(self, other: Any) -> Binary:
        return self._two("*", other)

    def __truediv__(self, other: Any) -> Binary:
        return self._two("/", other)

    def __mod__(self, other: Any) -> Binary:
        return self._two("%", other)

    def concat(self, other: Any) -> Binary:
        return self._two("||", other)

    def __and__(self, other: Any) -> Binary:
        return self._two("AND", other)

    def __or__(self, other: Any) -> Binary:
        return self._two("OR", other)

    def __invert__(self) -> Unary:
        return Unary("NOT", self)

    def __neg__(self) -> Unary:
        return Unary("-", self)

    def __pos__(self) -> Unary:
        return Unary("+", self)

    def is_null(self) -> Unary:
        return Unary("IS NULL", self)

    def is_not_null(self) -> Unary:
        return Unary("IS NOT NULL", self)

    def isin(self, *values: Any) -> In:
        return In(self, tuple(map(as_expr, values)))

    def between(self, low: Any, high: Any) -> Binary:
        return self.ge(low) & self.le(high)

    def like(self, pattern: str, escape: str = "\\") -> Like:
        return Like(self, pattern, escape)

    def starts_with(self, s: str) -> Call:
        return Call("startswith", (self, lit(s)))

    def ends_with(self, s: str) -> Call:
        return Call("endswith", (self, lit(s)))

    def cast(self, to: T.DataType) -> Cast:
        return Cast(self, to)


@dataclass(frozen=True)
class Literal(Expr):
    value: Any

    def column(self, schema: T.StructType) -> Column:
        return F.lit(self.value)

    def type(self, schema: T.StructType) -> T.DataType | None:
        v = self.value
        if v is None:
            return None
        if isinstance(v, bool):
            return T.BooleanType()
        if isinstance(v, int):
            return T.IntegerType() if -(1 << 31) <= v < 1 << 31 else T.LongType()
        if isinstance(v, str):
            return T.StringType()
        if isinstance(v, float):
            return T.DoubleType()
        raise TypeMismatch(f"no literal type for {v!r}")


@dataclass(frozen=True)
class Ref(Expr):
    """A column by position (from 0) or name."""

    key: int | str

    def field(self, schema: T.StructType) -> T.StructField:
        if isinstance(self.key, int):
            if not 0 <= self.key < len(schema):
                raise ColumnOutOfBounds(f"column {self.key} of {len(schema)}")
            return schema[self.key]
        found = [f for f in schema if f.name == self.key]
        if not found:
            raise ColumnOutOfBounds(f"no column {self.key}")
        return found[0]

    def column(self, schema: T.StructType) -> Column:
        return F.col(f"`{self.field(schema).name.replace('`', '``')}`")

    def type(self, schema: T.StructType) -> T.DataType | None:
        return self.field(schema).dataType

    def is_constant(self) -> bool:
        return False


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr

    def parts(self) -> tuple[Expr, ...]:
        return self.left, self.right

    def type(self, schema: T.StructType) -> T.DataType | None:
        a, b = self.left.type(schema), self.right.type(schema)
        bad = InvalidOperandTypes(f"{a and a.simpleString()} {self.op} {b and b.simpleString()}")
        known = a or b
        if self.op in LOGICAL:
            if not all(x is None or isinstance(x, T.BooleanType) for x in (a, b)):
                raise bad
            return T.BooleanType()
        if not same(a, b):
            raise bad
        if self.op in COMPARISONS:
            return T.BooleanType()
        if self.op == "||":
            if known is not None and not isinstance(known, T.StringType):
                raise bad
            return T.StringType()
        if self.op in ARITHMETIC:
            if known is not None and not isinstance(known, T.NumericType):
                raise bad
            if self.op in "/%" and isinstance(self.right, Literal) and self.right.value == 0 and not (isinstance(self.left, Literal) and self.left.value is None):
                raise DivisionByZero(f"{self.op} 0")
            return known
        raise UnknownFunction(self.op)

    def column(self, schema: T.StructType) -> Column:
        kind, a, b = self.type(schema), self.left.column(schema), self.right.column(schema)
        if self.op in ARITHMETIC and isinstance(kind, T.IntegerType):
            if self.op == "/":
                return int_div(a, b)
            if self.op == "%":
                return (a % b).cast("int")
            a = a.cast("bigint")
            return wrap_int(a + b if self.op == "+" else a - b if self.op == "-" else a * b)
        return {
            "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: a % b,
            "=": lambda: a == b, "<>": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b,
            "AND": lambda: a & b, "OR": lambda: a | b, "||": lambda: F.concat(a, b),
        }[self.op]()


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    of: Expr

    def parts(self) -> tuple[Expr, ...]:
        return (self.of,)

    def type(self, schema: T.StructType) -> T.DataType | None:
        a = self.of.type(schema)
        if self.op in ("IS NULL", "IS NOT NULL"):
            return T.BooleanType()
        wanted = T.BooleanType if self.op == "NOT" else T.NumericType
        if a is not None and not isinstance(a, wanted):
            raise InvalidOperandTypes(f"{self.op} {a.simpleString()}")
        return T.BooleanType() if self.op == "NOT" else a

    def column(self, schema: T.StructType) -> Column:
        kind, a = self.type(schema), self.of.column(schema)
        if self.op == "-":
            return wrap_int(-a.cast("bigint")) if isinstance(kind, T.IntegerType) else -a
        return {"NOT": lambda: ~a, "+": lambda: a, "IS NULL": a.isNull, "IS NOT NULL": a.isNotNull}[self.op]()


@dataclass(frozen=True)
class In(Expr):
    of: Expr
    values: tuple[Expr, ...]

    def parts(self) -> tuple[Expr, ...]:
        return (self.of, *self.values)

    def type(self, schema: T.StructType) -> T.DataType | None:
        for v in self.values:
            Binary("=", self.of, v).type(schema)
        return T.BooleanType()

    def column(self, schema: T.StructType) -> Column:
        self.type(schema)
        return self.of.column(schema).isin(*[v.column(schema) for v in self.values]) if self.values else F.lit(False)


@dataclass(frozen=True)
class Like(Expr):
    of: Expr
    pattern: str
    escape: str = "\\"

    def parts(self) -> tuple[Expr, ...]:
        return (self.of,)

    def type(self, schema: T.StructType) -> T.DataType | None:
        if not same(self.of.type(schema), T.StringType()):
            raise InvalidOperandTypes("LIKE needs a string")
        return T.BooleanType()

    def column(self, schema: T.StructType) -> Column:
        self.type(schema)
        return F.like(self.of.column(schema), F.lit(self.pattern), F.lit(self.escape))


@dataclass(frozen=True)
class Case(Expr):
    """CASE of (condition, value) arms and a default."""

    arms: tuple[tuple[Expr, Expr], ...]
    default: Expr = field(default_factory=lambda: Literal(None))

    def parts(self) -> tuple[Expr, ...]:
        return (*[x for arm in self.arms for x in arm], self.default)

    def type(self, schema: T.StructType) -> T.DataType | None:
        kind = self.default.type(schema)
        for cond, value in self.arms:
            check_predicate(cond, schema)
            if not same(kind, new := value.type(schema)):
                raise TypeMismatch("the arms of CASE differ in type")
            kind = kind or new
        return kind

    def column(self, schema: T.StructType) -> Column:
        self.type(schema)
        out = None
        for cond, value in self.arms:
            c, v = cond.column(schema).cast("boolean"), value.column(schema)
            out = F.when(c, v) if out is None else out.when(c, v)
        return self.default.column(schema) if out is None else out.otherwise(self.default.column(schema))


@dataclass(frozen=True)
class Cast(Expr):
    of: Expr
    to: T.DataType

    def parts(self) -> tuple[Expr, ...]:
        return (self.of,)

    def type(self, schema: T.StructType) -> T.DataType | None:
        self.of.type(schema)
        return self.to

    def column(self, schema: T.StructType) -> Column:
        return self.of.column(schema).cast(self.to)


#: Functions by name: how many arguments, types of arguments (None: any), result (None: that of the first).
FUNCTIONS: dict[str, tuple[int, type | None, T.DataType | None]] = {
    "startswith": (2, T.StringType, T.BooleanType()),
    "endswith": (2, T.StringType, T.BooleanType()),
    "upper": (1, T.StringType, None),
    "lower": (1, T.StringType, None),
    "trim": (1, T.StringType, None),
    "length": (1, T.StringType, T.IntegerType()),
    "abs": (1, T.NumericType, None),
    "coalesce": (-1, None, None),
}


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]

    def parts(self) -> tuple[Expr, ...]:
        return self.args

    def type(self, schema: T.StructType) -> T.DataType | None:
        if self.name not in FUNCTIONS:
            raise UnknownFunction(self.name)
        n, kind, out = FUNCTIONS[self.name]
        if n >= 0 and len(self.args) != n or not self.args:
            raise FunctionArgumentCount(f"{self.name}: {len(self.args)}")
        types = [a.type(schema) for a in self.args]
        if kind and any(t is not None and not isinstance(t, kind) for t in types):
            raise InvalidOperandTypes(self.name)
        first = next((t for t in types if t is not None), None)
        if n < 0 and any(not same(first, t) for t in types):
            raise InvalidOperandTypes(self.name)
        return out or first

    def column(self, schema: T.StructType) -> Column:
        self.type(schema)
        return getattr(F, self.name)(*[a.column(schema) for a in self.args])


def lit(value: Any) -> Literal:
    return Literal(value)


def col(key: int | str) -> Ref:
    return Ref(key)


def as_expr(x: Any) -> Expr:
    return x if isinstance(x, Expr) else Literal(x)


def check_predicate(e: Expr, schema: T.StructType) -> None:
    """A filter's condition is boolean, or NULL."""
    kind = e.type(schema)
    if kind is not None and not isinstance(kind, T.BooleanType):
        raise TypeMismatch(f"a condition is boolean, not {kind.simpleString()}")


def check_projection(exprs: list[Expr], schema: T.StructType) -> list[T.DataType | None]:
    return [e.type(schema) for e in exprs]


def check_assignable(kind: T.DataType | None, to: T.DataType) -> None:
    """A value fits a column of exactly its type, or is NULL."""
    if not same(kind, to):
        raise TypeMismatch(f"{kind.simpleString()} doesn't fit {to.simpleString()}")
