"""Short forms for common conditions."""

from __future__ import annotations

from functools import reduce
from typing import Any

from quillon.functions.expressions import Expr, Literal, col, lit


def column_equals(key: int | str, value: Any) -> Expr:
    return col(key).eq(value)


def column_not_equals(key: int | str, value: Any) -> Expr:
    return col(key).ne(value)


def column_lt(key: int | str, value: Any) -> Expr:
    return col(key).lt(value)


def column_le(key: int | str, value: Any) -> Expr:
    return col(key).le(value)


def column_gt(key: int | str, value: Any) -> Expr:
    return col(key).gt(value)


def column_ge(key: int | str, value: Any) -> Expr:
    return col(key).ge(value)


def column_is_null(key: int | str) -> Expr:
    return col(key).is_null()


def column_is_not_null(key: int | str) -> Expr:
    return col(key).is_not_null()


def column_like(key: int | str, pattern: str, escape: str = "\\") -> Expr:
    return col(key).like(pattern, escape)


def column_starts_with(key: int | str, prefix: str) -> Expr:
    return col(key).starts_with(prefix)


def column_ends_with(key: int | str, suffix: str) -> Expr:
    return col(key).ends_with(suffix)


def all_of(*conds: Expr) -> Expr:
    return reduce(lambda a, b: a & b, conds) if conds else Literal(True)


def any_of(*conds: Expr) -> Expr:
    return reduce(lambda a, b: a | b, conds) if conds else Literal(False)


def null() -> Expr:
    return lit(None)
