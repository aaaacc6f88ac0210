"""Relational operators: functions from DataFrame to DataFrame that Catalyst can optimise.

A condition or value may be a Spark column, a SQL string, or an `Expr`, which is checked
against the schema without coercion first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.errors import ColumnOutOfBounds, ConstraintError
from quillon.functions.expressions import Expr, check_predicate

Cond = Column | str | Expr

#: A side that Spark estimates at this many bytes or fewer may be broadcast by `theta_join`.
BROADCAST_BYTES = 64 << 20


def as_column(df: DataFrame, e: Cond) -> Column:
    if isinstance(e, Expr):
        return e.column(df.schema)
    return F.expr(e) if isinstance(e, str) else e


def scan(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table; what is used of it is read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def values(spark: SparkSession, *exprs: Column | str) -> DataFrame:
    """One row without a table."""
    return spark.range(1).select(*[F.expr(e) if isinstance(e, str) else e for e in exprs])


def where(df: DataFrame, cond: Cond) -> DataFrame:
    """Rows for which the condition is true; false and NULL drop."""
    if isinstance(cond, Expr):
        check_predicate(cond, df.schema)
        return df.where(cond.column(df.schema).cast("boolean"))
    return df.where(as_column(df, cond))


def project(df: DataFrame, columns: list[int | str | Column | Expr], names: list[str] | None = None) -> DataFrame:
    """Columns by position, name or expression, in any order and as often as wanted."""
    out = []
    for c in columns:
        if isinstance(c, int):
            if not 0 <= c < len(df.columns):
                raise ColumnOutOfBounds(f"column {c} of {len(df.columns)}")
            c = df.columns[c]
        if isinstance(c, str):
            if c not in df.columns:
                raise ColumnOutOfBounds(f"no column {c}")
            c = df[c]
        out.append(as_column(df, c))
    if names is not None:
        if len(names) != len(out):
            raise ConstraintError("as many names as columns")
        out = [c.alias(n) for c, n in zip(out, names)]
    return df.select(*out)


def order(key: str | Column, descending: bool = False, nulls_first: bool | None = None) -> Column:
    """A sort key. NULLs come first ascending and last descending unless it is said otherwise."""
    c = F.col(key) if isinstance(key, str) else key
    first = not descending if nulls_first is None else nulls_first
    if descending:
        return c.desc_nulls_first() if first else c.desc_nulls_last()
    return c.asc_nulls_first() if first else c.asc_nulls_last()


def sort(df: DataFrame, *keys: str | Column, ties: list[str] | None = None) -> DataFrame:
    """Sorted by keys made with `order`; `ties` are further columns that make the order total."""
    if not keys:
        raise ConstraintError("a sort needs a key")
    return df.orderBy(*[order(k) if isinstance(k, str) else k for k in keys], *[order(t) for t in ties or ()])


def limit(df: DataFrame, n: int | None, offset: int = 0) -> DataFrame:
    """n rows after `offset` rows; n of None is no limit."""
    if isinstance(n, bool) or n is not None and not isinstance(n, int) or not isinstance(offset, int) or offset < 0 or n is not None and n < 0:
        raise ConstraintError("LIMIT and OFFSET are non-negative integers")
    df = df.offset(offset) if offset else df
    return df if n is None else df.limit(n)


def top_k(df: DataFrame, n: int, *keys: str | Column, ties: list[str] | None = None) -> DataFrame:
    """The first n rows by the keys: each task keeps n rows, and only these meet."""
    return limit(sort(df, *keys, ties=ties), n)


def hash_join(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], residual: Cond | None = None, null_safe: bool = False, how: str = "inner") -> DataFrame:
    """Equi-join, left columns then right columns. null_safe: NULL keys match each other. residual: a further condition over both sides.

    Which side is broadcast, hashed or merged is left to Catalyst and AQE, which know the sizes.
    """
    if not left_keys or len(left_keys) != len(right_keys):
        raise ConstraintError("a hash join needs as many left keys as right keys, at least one")
    on = [left[a].eqNullSafe(right[b]) if null_safe else left[a] == right[b] for a, b in zip(left_keys, right_keys)]
    if residual is not None:
        on.append(F.expr(residual) if isinstance(residual, str) else residual)
    return left.join(right, reduce(lambda a, b: a & b, on), how)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a result's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def theta_join(left: DataFrame, right: DataFrame, cond: Column | str, how: str = "inner") -> DataFrame:
    """Join on any condition. The right side is broadcast if it is estimated small; else Spark decides, by blocks of both sides."""
    on = F.expr(cond) if isinstance(cond, str) else cond
    if estimated_bytes(right) <= BROADCAST_BYTES and how in ("inner", "left", "left_semi", "left_anti", "cross"):
        right = F.broadcast(right)
    return left.join(right, on, how)


def using_join(left: DataFrame, right: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    return left.join(right, columns, how)


def cross_join(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.crossJoin(right)


def semi_join(left: DataFrame, right: DataFrame, cond: Column) -> DataFrame:
    """Left rows with a match: EXISTS and IN."""
    return left.join(right, cond, "left_semi")


def anti_join(left: DataFrame, right: DataFrame, cond: Column) -> DataFrame:
    """Left rows without a match: NOT EXISTS."""
    return left.join(right, cond, "left_anti")


def count_all() -> Column:
    return F.count(F.lit(1))


def avg_int(c: str) -> Column:
    """The average of integers, truncated towards zero; NULL over no values."""
    return F.expr(f"CAST(sum(`{c}`) div count(`{c}`) AS INT)")


def aggregate(df: DataFrame, keys: list[str], having: Cond | None = None, **aggregates: Column) -> DataFrame:
    """Group columns then aggregates by name; NULL keys are one group. Without keys one row, even over no rows."""
    if not aggregates:
        raise ConstraintError("an aggregate needs a function")
    out = (df.groupBy(*keys) if keys else df.groupBy()).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out if having is None else where(out, having)


#: Aggregate functions by name; avg is that of integers, truncated.
CALLS = {"COUNT": F.count, "SUM": F.sum, "MIN": F.min, "MAX": F.max, "AVG": avg_int}


def aggregate_calls(df: DataFrame, keys: list[str], *calls: tuple[str, str]) -> DataFrame:
    """`aggregate` of (function, column) pairs, named FUNC(column); ("COUNT", "*") counts rows."""
    made = {}
    for name, c in calls:
        if name.upper() not in CALLS or c != "*" and c not in df.columns or c == "*" and name.upper() != "COUNT":
            raise ConstraintError(f"no aggregate {name}({c})")
        made[f"{name.upper()}({c})"] = count_all() if c == "*" else CALLS[name.upper()](c)
    return aggregate(df, keys, **made)


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def union(a: DataFrame, b: DataFrame, all_rows: bool = False) -> DataFrame:
    return a.union(b) if all_rows else a.union(b).distinct()


def intersect(a: DataFrame, b: DataFrame, all_rows: bool = False) -> DataFrame:
    return a.intersectAll(b) if all_rows else a.intersect(b)


def difference(a: DataFrame, b: DataFrame, all_rows: bool = False) -> DataFrame:
    return a.exceptAll(b) if all_rows else a.subtract(b)


def explain(df: DataFrame, mode: str = "formatted") -> str:
    """The plan as text."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)
