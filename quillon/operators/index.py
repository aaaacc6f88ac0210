"""Key lookups on a sorted copy.

An index is a copy of a table that is range-partitioned and sorted by its key columns. Parquet's row-group
statistics then let a lookup skip all files and row groups but those of its keys: a filter that Catalyst pushes down.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.errors import ConstraintError


def build(df: DataFrame, keys: list[str], path: str, partitions: int | None = None) -> None:
    """Writes the sorted copy."""
    _known(df, keys)
    order = [F.col(k).asc_nulls_first() for k in keys]
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).write.parquet(path)


def _known(df: DataFrame, keys: list[str]) -> None:
    if not keys or any(k not in df.columns for k in keys):
        raise ConstraintError("an index needs columns of its table")


def exact(df: DataFrame, keys: list[str], values: list[Any]) -> DataFrame:
    """Rows whose key columns equal the values; NULL equals NULL here."""
    if len(keys) != len(values):
        raise ConstraintError("a value for each key column")
    return prefix(df, keys, values)


def prefix(df: DataFrame, keys: list[str], values: list[Any]) -> DataFrame:
    """Rows whose first key columns equal the values."""
    _known(df, keys)
    if not values or len(values) > len(keys):
        raise ConstraintError("a prefix has one value at least, and no more than key columns")
    return df.where(reduce(lambda a, b: a & b, [_equal(F.col(k), v) for k, v in zip(keys, values)]))


def _equal(c: Column, v: Any) -> Column:
    return c.isNull() if v is None else c == F.lit(v)


def _beyond(keys: list[str], values: list[Any], up: bool, inclusive: bool) -> Column:
    """Lexicographic comparison of the leading keys with the values; NULL is lowest."""
    n = len(values)
    cond = F.lit(inclusive)
    for k, v in reversed(list(zip(keys[:n], values))):
        c = F.col(k)
        if v is None:
            past = c.isNotNull() if up else F.lit(False)
        else:
            past = c > F.lit(v) if up else (c < F.lit(v)) | c.isNull()
        cond = past | (_equal(c, v) & cond)
    return F.coalesce(cond, F.lit(False))


def range_(df: DataFrame, keys: list[str], start: list[Any] | None = None, end: list[Any] | None = None, include_start: bool = True, include_end: bool = False, descending: bool | None = None) -> DataFrame:
    """Rows between two keys, each end open, closed or absent; sorted by key if a direction is given."""
    _known(df, keys)
    out = df
    for values, up, inclusive in ((start, True, include_start), (end, False, include_end)):
        if values is not None:
            if not values or len(values) > len(keys):
                raise ConstraintError("a bound has one value at least, and no more than key columns")
            if len(values) == 1 and values[0] is not None:  # one plain comparison reaches the scan
                c, v = F.col(keys[0]), F.lit(values[0])
                cond = (c >= v if inclusive else c > v) if up else (c <= v if inclusive else c < v)
                out = out.where(cond if up else F.coalesce(cond, F.lit(True)) if df.schema[keys[0]].nullable and start is None else cond)
            else:
                out = out.where(_beyond(keys, values, up, inclusive))
    if descending is None:
        return out
    return out.orderBy(*[F.col(k).desc_nulls_last() if descending else F.col(k).asc_nulls_first() for k in keys])
