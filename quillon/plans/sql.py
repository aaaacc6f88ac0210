"""SQL statements: queries go to Spark, DDL, DML and transactions to the table store.

Tables are put before a query as common table expressions over views of unique names, so that no view of the caller is touched and
several engines may share a session.
"""

from __future__ import annotations

import datetime
import decimal
import re
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import CatalogError, ConstraintError, SqlError
from quillon.functions.types import parse_type
from quillon.operators.relational import explain
from quillon.plans.integers import with_integers
from quillon.sources.store import SYSTEM, Database, Session, show_row

LITERAL = re.compile(r"[-+]?\s*\d+|'(?:[^'\\]|'')*'|NULL|TRUE|FALSE", re.I)

TOKEN = re.compile(r"\s+|--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`|\w+|<>|<=|>=|!=|\|\||.", re.S)


@dataclass
class Result:
    """What a statement gave: rows as a DataFrame, or a count, and a tag that names both."""

    tag: str
    rows: DataFrame | None = None
    count: int | None = None

    def text(self) -> list[list[str | None]]:
        return [show_row(r) for r in self.rows.collect()] if self.rows is not None else []


class Tokens:
    """A statement's tokens with their places, and a cursor."""

    def __init__(self, sql: str):
        self.sql, self.at = sql, 0
        self.items = [(m[0], m.start(), m.end()) for m in TOKEN.finditer(sql) if not re.match(r"\s|--|/\*", m[0])]
        while self.items and self.items[-1][0] == ";":
            self.items.pop()
        if any(t == ";" for t, _, _ in self.items):
            raise SqlError("one statement at a time")
        if not self.items:
            raise SqlError("an empty statement")

    def peek(self, ahead: int = 0) -> str:
        i = self.at + ahead
        return self.items[i][0] if i < len(self.items) else ""

    def next(self) -> str:
        if not (t := self.peek()):
            raise SqlError("the statement ends too early")
        self.at += 1
        return t

    def take(self, *words: str) -> bool:
        """Passes over these words, if they stand here."""
        if all(self.peek(i).upper() == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise SqlError(f"expected {' '.join(words)} at {self.peek() or 'the end'!r}")

    def name(self) -> str:
        t = self.next()
        if t[0] in "\"`":
            return t[1:-1].replace(t[0] * 2, t[0])
        if not re.fullmatch(r"[A-Za-z_]\w*", t):
            raise SqlError(f"expected a name at {t!r}")
        return t

    def names(self) -> list[str]:
        self.need("(")
        out = [self.name()]
        while self.take(","):
            out.append(self.name())
        self.need(")")
        return out

    def until(self, *stops: str) -> str:
        """The text up to one of the words, or the end, outside brackets."""
        depth, first = 0, self.at
        while self.peek():
            t = self.peek()
            if depth == 0 and t.upper() in stops:
                break
            depth += (t == "(") - (t == ")")
            if depth < 0:
                break
            self.at += 1
        if self.at == first:
            raise SqlError(f"expected an expression at {self.peek() or 'the end'!r}")
        return self.sql[self.items[first][1] : self.items[self.at - 1][2]]

    def end(self) -> None:
        if self.peek():
            raise SqlError(f"unexpected {self.peek()!r}")


def literal(v: Any) -> str:
    """A value as SQL."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, int):
        return f"{v}" if -(1 << 31) <= v < 1 << 31 else f"{v}L"
    if isinstance(v, float):
        return f"CAST('{v!r}' AS DOUBLE)"
    if isinstance(v, decimal.Decimal):
        return f"{v}BD"
    if isinstance(v, datetime.datetime):
        return f"TIMESTAMP_NTZ '{v.isoformat(sep=' ')}'"
    if isinstance(v, datetime.date):
        return f"DATE '{v.isoformat()}'"
    if isinstance(v, (bytes, bytearray)):
        return f"X'{v.hex()}'"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "''") + "'"
    raise SqlError(f"no parameter of type {type(v).__name__}")


def bound(sql: str, args: dict[str, Any] | list[Any] | None) -> str:
    """The text with its ? or :name parameters replaced by literals."""
    if not args:
        return sql
    out, n, parts = [], 0, [m[0] for m in TOKEN.finditer(sql)]
    i = 0
    while i < len(parts):
        t = parts[i]
        if t == "?":
            if isinstance(args, dict) or n >= len(args):
                raise SqlError("a value for each ?")
            t, n = literal(args[n]), n + 1
        elif t == ":" and i + 1 < len(parts) and re.match(r"[A-Za-z_]", parts[i + 1]) and (not out or out[-1] != ":"):
            if not isinstance(args, dict) or parts[i + 1] not in args:
                raise SqlError(f"no value for :{parts[i + 1]}")
            t, i = literal(args[parts[i + 1]]), i + 1
        out.append(t)
        i += 1
    if not isinstance(args, dict) and n < len(args):
        raise SqlError("more values than ?")
    return "".join(out)


@dataclass
class Prepared:
    """A statement that is executed with new values each time."""

    engine: Engine
    sql: str

    def execute(self, args: dict[str, Any] | list[Any] | None = None) -> Result:
        return self.engine.execute(self.sql, args)


class Engine:
    """Executes SQL over the tables of a database, and over DataFrames that are attached by name."""

    def __init__(self, spark: SparkSession, database: Database, isolation: str = "repeatable read"):
        self.spark, self.session = spark, Session(database, isolation)
        self.attached: dict[str, DataFrame] = {}

    @staticmethod
    def create(spark: SparkSession, path: str) -> Engine:
        return Engine(spark, Database.create(spark, path))

    @staticmethod
    def open(spark: SparkSession, path: str) -> Engine:
        return Engine(spark, Database.open(spark, path))

    def attach(self, name: str, df: DataFrame) -> None:
        """A table that queries can read and no statement changes."""
        if name in SYSTEM or name in self.session.tables():
            raise CatalogError(f"table {name} exists")
        self.attached[name] = df

    def prepare(self, sql: str) -> Prepared:
        return Prepared(self, sql)

    def execute(self, sql: str, args: dict[str, Any] | list[Any] | None = None) -> Result:
        """One statement. args: values of its :name or ? parameters."""
        sql = bound(sql, args)
        t = Tokens(sql)
        head = t.peek().upper()
        if head in ("SELECT", "WITH", "VALUES", "("):
            return self._query(sql, t)
        if head == "EXPLAIN":
            t.next()
            inner = sql[t.items[t.at][1] :] if t.peek() else ""
            plan = explain(self._query(inner, Tokens(inner)).rows)
            return Result("EXPLAIN", self.spark.createDataFrame([(x,) for x in plan.split("\n")], "plan string"))
        parse = {"INSERT": self._insert, "UPDATE": self._update, "DELETE": self._delete, "CREATE": self._create, "DROP": self._drop, "BEGIN": self._begin, "START": self._begin, "COMMIT": self._commit, "ROLLBACK": self._rollback, "ABORT": self._rollback}.get(head)
        if parse is None:
            raise SqlError(f"no such statement: {t.peek()}")
        t.next()
        return parse(t)

    def _query(self, sql: str, t: Tokens) -> Result:
        """The query as Spark's, over this statement's snapshot of the tables it names."""
        words = {x[1:-1] if x[0] in "\"`" else x for x, _, _ in t.items}
        compared = _compared([x for x, _, _ in t.items])
        frames = {n: self.session.table_by(n, compared) for n in [*SYSTEM, *self.session.tables()] if n in words}
        frames |= {n: df for n, df in self.attached.items() if n in words and n not in frames}
        text = "".join(f"`{m[0][1:-1]}`" if m[0][0] == '"' else m[0] for m in TOKEN.finditer(sql)).strip().rstrip("; \n\t")
        return Result("SELECT", with_integers(*self._over_views(text, frames))[0])

    def _over_views(self, text: str, frames: dict[str, DataFrame]):
        """The text with the frames as common table expressions, and what runs it."""
        views = {n: f"v_{uuid.uuid4().hex}" for n in frames}
        heads = ", ".join(f"`{n}` AS (SELECT * FROM {v})" for n, v in views.items())
        if heads:
            m = re.match(r"WITH\s+(RECURSIVE\s+)?", text, re.I)
            text = f"WITH {m[1] or ''}{heads}, {text[m.end():]}" if m else f"WITH {heads} {text}"

        def run(sql: str) -> DataFrame:
            for n, v in views.items():
                frames[n].createTempView(v)
            try:
                rows = self.spark.sql(sql)
                rows.schema  # noqa: B018  resolved against these views
                return rows
            finally:
                for v in views.values():
                    self.spark.catalog.dropTempView(v)

        return text, run

    def _typed(self, expr: str, schema: T.StructType) -> tuple[str, T.DataType]:
        """An expression over a table's columns with this engine's integer semantics, and its type."""
        text, run = self._over_views(f"SELECT ({expr}) AS v FROM t__", {"t__": self.spark.createDataFrame([], schema)})
        df, sql = with_integers(text, run)
        lead = text.index("SELECT (", text.index(")")) + len("SELECT (")
        return sql[lead : sql.rindex(") AS v FROM t__")], df.schema[0].dataType

    def _insert(self, t: Tokens) -> Result:
        t.need("INTO")
        name = t.name()
        columns = t.names() if t.peek() == "(" and t.peek(1).upper() != "SELECT" else None
        if t.peek().upper() in ("SELECT", "WITH", "("):
            sql = t.sql[t.items[t.at][1] :]
            n = self.session.insert(name, self._query(sql, Tokens(sql)).rows, columns)
            return Result(f"INSERT 0 {n}", count=n)
        t.need("VALUES")
        rows = []
        while True:
            t.need("(")
            row = [t.until(",", ")")]
            while t.take(","):
                row.append(t.until(",", ")"))
            t.need(")")
            rows.append(row)
            if not t.take(","):
                break
        t.end()
        info = self.session.table_info(name)
        wanted = columns or [f.name for f in info.schema]
        if any(len(r) != len(wanted) for r in rows):
            raise ConstraintError(f"each row needs {len(wanted)} values")
        flat = [e for r in rows for e in r]
        made = {i: _plain(e) for i, e in enumerate(flat) if LITERAL.fullmatch(e)}
        rest = [i for i in range(len(flat)) if i not in made]  # expressions, which Spark evaluates
        for lo in range(0, len(rest), 256):
            some = rest[lo : lo + 256]
            text, run = f"SELECT {', '.join(f'({flat[i]}) AS c{i}' for i in some)}", self.spark.sql
            one = with_integers(text, run)[0]
            made |= {i: (v, f.dataType) for i, v, f in zip(some, one.first(), one.schema)}
        values, kinds = [made[i][0] for i in range(len(flat))], [made[i][1] for i in range(len(flat))]
        n = len(wanted)
        by_name = {f.name: f.dataType for f in info.schema}
        out = []
        for k in range(len(rows)):
            row = []
            for c, v, kind in zip(wanted, values[k * n : k * n + n], kinds[k * n : k * n + n]):
                if c not in by_name:
                    raise ConstraintError(f"no column {c}")
                row.append(_fitted(v, kind, by_name[c]))
            out.append(tuple(row))
        got = self.session.insert(name, out, columns)
        return Result(f"INSERT 0 {got}", count=got)

    def _update(self, t: Tokens) -> Result:
        name = t.name()
        info = self.session.table_info(name)
        kinds = {f.name: f.dataType for f in info.schema}
        t.need("SET")
        values = {}
        while True:
            c = t.name()
            t.need("=")
            text = t.until(",", "WHERE")
            if c not in kinds:
                raise ConstraintError(f"no column {c}")
            text, got = self._typed(text, info.schema)
            if isinstance(got, T.NullType) or got == kinds[c]:
                values[c] = F.expr(text)
            else:
                values[c] = F.expr(text) if _widens(got, kinds[c]) else _mismatch(got, kinds[c])
            if not t.take(","):
                break
        cond = self._where(t, info.schema)
        n = self.session.update(name, values, cond)
        return Result(f"UPDATE {n}", count=n)

    def _delete(self, t: Tokens) -> Result:
        t.need("FROM")
        name = t.name()
        n = self.session.delete(name, self._where(t, self.session.table_info(name).schema))
        return Result(f"DELETE {n}", count=n)

    def _where(self, t: Tokens, schema: T.StructType) -> str | None:
        cond = None
        if t.take("WHERE"):
            cond = t.until()
            cond, kind = self._typed(cond, schema)
            if not isinstance(kind, (T.BooleanType, T.NullType)):
                raise SqlError(f"a condition is boolean, not {kind.simpleString()}")
        t.end()
        return cond

    def _create(self, t: Tokens) -> Result:
        unique = t.take("UNIQUE")
        if t.take("INDEX"):
            name = t.name()
            t.need("ON")
            table, keys = t.name(), t.names()
            t.end()
            self.session.create_index(name, table, keys, unique)
            return Result("CREATE INDEX")
        if unique:
            raise SqlError("expected INDEX")
        t.need("TABLE")
        if t.take("IF", "NOT", "EXISTS") and t.peek() in self.session.tables():
            return Result("CREATE TABLE")
        name = t.name()
        t.need("(")
        fields, tied = [], []
        while True:
            if t.peek().upper() in ("PRIMARY", "UNIQUE", "CHECK", "FOREIGN", "CONSTRAINT"):
                text = t.until(",")
                if m := re.search(r"(?:PRIMARY\s+KEY|UNIQUE)\s*\(([^)]*)\)", text, re.I):
                    tied += [c.strip().strip('"`') for c in m[1].split(",")]
            else:
                c, text = t.name(), t.until(",")
                m = re.match(r"\w+(?:\s+PRECISION)?(?:\s*\([^)]*\))?", text, re.I)
                fields.append(T.StructField(c, parse_type(m[0] if m else text)))
            if not t.take(","):
                break
        t.need(")")
        t.end()
        if not set(tied) <= {f.name for f in fields}:
            raise ConstraintError("a constraint names a column that isn't there")
        self.session.create_table(name, T.StructType(fields))
        return Result("CREATE TABLE")

    def _drop(self, t: Tokens) -> Result:
        what = t.next().upper()
        if what not in ("TABLE", "INDEX"):
            raise SqlError(f"can't drop {what}")
        maybe = t.take("IF", "EXISTS")
        name = t.name()
        t.end()
        (self.session.drop_table if what == "TABLE" else self.session.drop_index)(name, maybe)
        return Result(f"DROP {what}")

    def _over(self, t: Tokens) -> None:
        t.take("TRANSACTION") or t.take("WORK")
        t.end()

    def _begin(self, t: Tokens) -> Result:
        self._over(t)
        self.session.begin()
        return Result("BEGIN")

    def _commit(self, t: Tokens) -> Result:
        self._over(t)
        self.session.commit()
        return Result("COMMIT")

    def _rollback(self, t: Tokens) -> Result:
        self._over(t)
        self.session.rollback()
        return Result("ROLLBACK")


def _compared(tokens: list[str]) -> set[str]:
    """Names, in lower case, that stand beside a comparison with a constant.

    They only decide whether a table is read by an index, which holds the same rows; Spark filters.
    """
    out = set()
    for i, t in enumerate(tokens):
        if t in ("=", "<", ">", "<=", ">=") or t.upper() in ("BETWEEN", "IN"):
            before, after = tokens[i - 1] if i else "", tokens[i + 1] if i + 1 < len(tokens) else ""
            if re.fullmatch(r"[-+(]|\d+\w*|'.*'", after, re.S):
                out.add(before)
            if re.fullmatch(r"\d+\w*|'.*'", before, re.S):
                # the last part of a qualified name
                out.add(tokens[i + 3] if i + 3 < len(tokens) and tokens[i + 2] == "." else after)
    return {(x[1:-1] if x[:1] in ('"', "`") else x).lower() for x in out}


def _plain(e: str) -> tuple[Any, T.DataType]:
    """The value and type of a text that is a literal."""
    word = e.upper()
    if word == "NULL":
        return None, T.NullType()
    if word in ("TRUE", "FALSE"):
        return word == "TRUE", T.BooleanType()
    if e[0] == "'":
        return e[1:-1].replace("''", "'"), T.StringType()
    v = int(re.sub(r"\s", "", e))
    return v, T.IntegerType() if -(1 << 31) <= v < 1 << 31 else T.LongType()


def _widens(kind: T.DataType, to: T.DataType) -> bool:
    """Numbers may be stored in a column of another numeric type, as ANSI assignment does; the cast fails on overflow."""
    return isinstance(kind, T.NumericType) and isinstance(to, T.NumericType)


def _mismatch(kind: T.DataType, to: T.DataType):
    from quillon.errors import TypeMismatch

    raise TypeMismatch(f"{kind.simpleString()} doesn't fit {to.simpleString()}")


def _fitted(v: Any, kind: T.DataType, to: T.DataType) -> Any:
    """A constant's value for a column: numbers go between numeric types without loss, anything else must fit as it is."""
    if v is None:
        return None
    if isinstance(to, (T.DateType, T.TimestampNTZType)) and isinstance(v, str):
        return (datetime.date if isinstance(to, T.DateType) else datetime.datetime).fromisoformat(v)
    if _widens(kind, to):
        if isinstance(to, (T.FloatType, T.DoubleType)):
            return float(v)
        if isinstance(to, T.DecimalType):
            return decimal.Decimal(v)
        if int(v) == v:
            return int(v)
    elif kind == to:
        return v
    return _mismatch(kind, to)


__all__ = ["CatalogError", "Engine", "Result", "Tokens"]
