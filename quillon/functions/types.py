"""SQL type names, and which types go together without coercion."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from quillon.errors import SqlError

#: Names without parameters.
NAMES = {
    "INT": T.IntegerType(),
    "INTEGER": T.IntegerType(),
    "SMALLINT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "BOOLEAN": T.BooleanType(),
    "TEXT": T.StringType(),
    "CHAR": T.StringType(),
    "VARCHAR": T.StringType(),
    "FLOAT": T.FloatType(),
    "REAL": T.FloatType(),
    "DOUBLE": T.DoubleType(),
    "DOUBLE PRECISION": T.DoubleType(),
    "DATE": T.DateType(),
    "TIME": T.StringType(),
    "TIMESTAMP": T.TimestampNTZType(),
    "DECIMAL": T.DecimalType(10, 0),
    "NUMERIC": T.DecimalType(10, 0),
}


def parse_type(text: str) -> T.DataType:
    """The Spark type of a SQL type. A length of CHAR or VARCHAR is accepted and not enforced; SMALLINT is stored as INT."""
    m = re.fullmatch(r"\s*([A-Za-z]+(?:\s+PRECISION)?)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?\s*", text, re.I)
    name = re.sub(r"\s+", " ", m[1]).upper() if m else ""
    if name not in NAMES:
        raise SqlError(f"unsupported data type: {text}")
    if m[2]:
        if name in ("DECIMAL", "NUMERIC"):
            return T.DecimalType(int(m[2]), int(m[3] or 0))
        if name not in ("CHAR", "VARCHAR") or m[3]:
            raise SqlError(f"{name} takes no such parameters")
    return NAMES[name]


def same(a: T.DataType | None, b: T.DataType | None) -> bool:
    """Whether values of both types compare without coercion. None is the type of NULL."""
    return a is None or b is None or a == b or isinstance(a, T.StringType) and isinstance(b, T.StringType)
