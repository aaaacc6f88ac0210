"""Versioned Parquet tables: snapshots, INSERT, UPDATE, DELETE, catalog, indexes and transactions.

A database is a folder. `_log/<version>.json` holds the state of the catalog after each commit; a table is a
list of Parquet files that are never changed. INSERT adds files; UPDATE and DELETE rewrite only those
files that hold a row to change. A commit publishes the next version by exclusive creation; if another
transaction has changed one of its tables since, it fails. Readers keep the files of their version.
"""

from __future__ import annotations

import json
import random
import time
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import CatalogError, ConflictError, ConstraintError, TransactionError
from quillon.functions.expressions import Expr, Literal, check_assignable, check_predicate
from quillon.operators import index as ix
from quillon.sources.files import Files

#: System tables and their columns (fixed values of the catalog); ids of user tables follow theirs.
SYSTEM = {
    "pg_tables": (1, "table_id int, table_name string, first_page_id int"),
    "pg_attribute": (2, "table_id int, column_name string, column_type string, column_order int"),
    "pg_index": (3, "index_id int, index_name string, table_id int, key_column_names string, root_page_id int, is_unique boolean"),
}
FIRST_USER_ID = 4
COMMIT_TRIES = 30
#: An index of more sorted copies than this is built anew, as one.
MOST_RUNS = 16
#: The column of a sorted copy that holds a row's file in the table.
OF_FILE = "of_file__"


@dataclass
class Index:
    id: int
    name: str
    keys: list[str]
    unique: bool
    runs: dict[str, list[str]] = field(default_factory=dict)  # sorted copies: folder to the table's files that it holds


@dataclass
class Table:
    id: int
    name: str
    schema: T.StructType
    files: list[str] = field(default_factory=list)
    indexes: dict[str, Index] = field(default_factory=dict)

    def dump(self) -> dict[str, Any]:
        return {"id": self.id, "schema": self.schema.jsonValue(), "files": self.files, "indexes": {n: vars(i) for n, i in self.indexes.items()}}

    @staticmethod
    def load(name: str, d: dict[str, Any]) -> Table:
        return Table(d["id"], name, T.StructType.fromJson(d["schema"]), d["files"], {n: Index(**i) for n, i in d["indexes"].items()})


@dataclass
class State:
    version: int
    next_table: int
    next_index: int
    tables: dict[str, Table]

    def dump(self) -> str:
        return json.dumps({"next_table": self.next_table, "next_index": self.next_index, "tables": {n: t.dump() for n, t in self.tables.items()}})

    @staticmethod
    def load(version: int, text: str) -> State:
        d = json.loads(text)
        return State(version, d["next_table"], d["next_index"], {n: Table.load(n, t) for n, t in d["tables"].items()})


class Database:
    """A folder of tables. `create` fails if it exists, `open` if it doesn't."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.files = spark, Files(spark, path)

    @staticmethod
    def create(spark: SparkSession, path: str) -> Database:
        db = Database(spark, path)
        if db.files.exists("_log"):
            raise CatalogError(f"{path} exists")
        db.files.make("_log")
        db.files.put_new("_log/00000000000000000000.json", State(0, FIRST_USER_ID, 1, {}).dump())
        return db

    @staticmethod
    def open(spark: SparkSession, path: str) -> Database:
        db = Database(spark, path)
        if not db.files.exists("_log"):
            raise CatalogError(f"no database at {path}")
        return db

    def state(self, version: int | None = None) -> State:
        """The catalog at a version, by default the last one that was published."""
        if version is None:
            version = max(int(n[:-5]) for n in self.files.names("_log") if n.endswith(".json") and not n.startswith("."))
        return State.load(version, self.files.read(f"_log/{version:020d}.json"))

    def session(self, isolation: str = "repeatable read") -> Session:
        return Session(self, isolation)

    def write(self, df: DataFrame, table: str) -> list[str]:
        """New files with the rows of `df`, as names below the folder."""
        folder = f"data/{table}/{uuid.uuid4().hex}"
        df.write.parquet(self.files.full(folder))
        return [f"{folder}/{n}" for n in self.files.names(folder) if n.endswith(".parquet")]

    def vacuum(self) -> int:
        """Deletes data folders that the last version doesn't name. Not while older versions are being read or written."""
        used = {f.split("/")[2] for t in self.state().tables.values() for f in t.files}
        used |= {path.split("/")[2] for t in self.state().tables.values() for i in t.indexes.values() for path in i.runs}
        gone = 0
        for top in ("data", "index"):
            for table in self.files.names(top) if self.files.exists(top) else []:
                for folder in self.files.names(f"{top}/{table}"):
                    if folder not in used:
                        self.files.delete(f"{top}/{table}/{folder}")
                        gone += 1
        return gone


class Session:
    """Reads and changes tables, each statement its own transaction unless one is begun.

    Repeatable read pins the version at BEGIN; read committed takes the last version at each statement. Serializable
    also fails at commit if a table that was read has changed.
    """

    LEVELS = ("read committed", "repeatable read", "serializable")

    def __init__(self, db: Database, isolation: str = "repeatable read"):
        if isolation not in self.LEVELS:
            raise TransactionError(f"no isolation level {isolation}")
        self.db, self.spark, self.isolation = db, db.spark, isolation
        self.base: State | None = None
        self.changed: dict[str, Table | None] = {}  # by name; None is dropped
        self.seen: dict[str, list[str]] = {}

    # transactions

    @property
    def in_transaction(self) -> bool:
        return self.base is not None

    def begin(self) -> None:
        if self.base is not None:
            raise TransactionError("a transaction is open")
        self.base, self.changed, self.seen = self.db.state(), {}, {}

    def rollback(self) -> None:
        if self.base is None:
            raise TransactionError("no transaction is open")
        self.base, self.changed, self.seen = None, {}, {}

    def commit(self) -> None:
        if self.base is None:
            raise TransactionError("no transaction is open")
        base, changed, seen = self.base, self.changed, self.seen
        self.rollback()
        if not changed and not (seen and self.isolation == "serializable"):
            return
        for attempt in range(COMMIT_TRIES):
            if attempt:  # another commit took the version; it may have changed other tables
                time.sleep(random.uniform(0, min(1.0, 0.02 * 2**attempt)))
            now = self.db.state()
            for name in changed:
                if _mark(base.tables.get(name)) != _mark(now.tables.get(name)):
                    raise ConflictError(f"{name} has changed since the transaction began")
            if self.isolation == "serializable":
                for name, files in seen.items():
                    if name not in changed and (t := now.tables.get(name)) is not None and t.files != files:
                        raise ConflictError(f"{name}, which was read, has changed since the transaction began")
            if not changed:
                return
            tables = dict(now.tables)
            top, top_index = now.next_table, now.next_index
            for name, t in changed.items():
                if t is None:
                    tables.pop(name, None)
                    continue
                if t.id < 0:
                    t.id, top = top, top + 1
                for i in t.indexes.values():
                    if i.id < 0:
                        i.id, top_index = top_index, top_index + 1
                tables[name] = t
            if self.db.files.put_new(f"_log/{now.version + 1:020d}.json", State(now.version + 1, top, top_index, tables).dump()):
                return
        raise ConflictError(f"no version could be published in {COMMIT_TRIES} tries")

    def __enter__(self) -> Session:
        self.begin()
        return self

    def __exit__(self, kind, *_) -> None:
        if self.base is not None:
            self.commit() if kind is None else self.rollback()

    def _do(self, change):
        """Runs `change` in the open transaction, or in one of its own."""
        if self.base is not None:
            return change()
        self.begin()
        try:
            out = change()
        except BaseException:
            self.rollback()
            raise
        self.commit()
        return out

    # catalog

    def _state(self) -> State:
        if self.base is None:
            return self.db.state()
        if self.isolation == "read committed":
            fresh = self.db.state()
            for name in (self.base.tables.keys() | fresh.tables.keys()) - self.changed.keys():
                if name in fresh.tables:
                    self.base.tables[name] = fresh.tables[name]
                else:
                    self.base.tables.pop(name, None)
        return self.base

    def tables(self) -> dict[str, Table]:
        """Tables as this session sees them, its own changes included."""
        out = dict(self._state().tables)
        for name, t in self.changed.items():
            out.pop(name, None)
            if t is not None:
                out[name] = t
        return out

    def table_info(self, name: str) -> Table:
        if (t := self.tables().get(name)) is None:
            raise CatalogError(f"no table {name}")
        return t

    def list_tables(self) -> list[str]:
        return [*SYSTEM, *[t.name for t in sorted(self.tables().values(), key=lambda t: (t.id < 0, t.id))]]

    def create_table(self, name: str, schema: T.StructType | str) -> None:
        if isinstance(schema, str):
            schema = T.StructType.fromDDL(schema)
        names = [f.name.lower() for f in schema]
        if not names or len(set(names)) < len(names):
            raise ConstraintError("a table needs columns of different names")
        if name in SYSTEM or name in self.tables():
            raise CatalogError(f"table {name} exists")

        def change():
            self.changed[name] = Table(-1, name, T.StructType([T.StructField(f.name, f.dataType, True) for f in schema]))

        self._do(change)

    def drop_table(self, name: str, if_exists: bool = False) -> bool:
        if name not in self.tables():
            if if_exists:
                return False
            raise CatalogError(f"no table {name}")

        def change():
            self.changed[name] = None

        self._do(change)
        return True

    # reading

    def table(self, name: str) -> DataFrame:
        if name in SYSTEM:
            return self._system(name)
        t = self.table_info(name)
        if self.base is not None:
            self.seen.setdefault(name, list(t.files))
        return self._read(t, t.files)

    def addressed(self, name: str) -> DataFrame:
        """A table's rows with their address: row_file, a file of the table, and row_index in it."""
        t = self.table_info(name)
        if not t.files:
            return self.spark.createDataFrame([], T.StructType([*t.schema.fields, T.StructField("row_file", T.StringType()), T.StructField("row_index", T.LongType())]))
        return self._read(t, t.files).select("*", F.concat(F.lit(f"data/{name}/"), _file_of()).alias("row_file"), F.col("_metadata.row_index").alias("row_index"))

    def fetch(self, name: str, row_file: str, row_index: int) -> DataFrame:
        """The row at an address, none if the table no longer has it: only that file is read."""
        t = self.table_info(name)
        return self._read(t, [f for f in t.files if f == row_file]).where(F.col("_metadata.row_index") == row_index) if row_file in t.files else self._read(t, [])

    def _read(self, t: Table, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], t.schema)
        return self.spark.read.schema(t.schema).parquet(*map(self.db.files.full, files))

    def _system(self, name: str) -> DataFrame:
        """The catalog as rows: bounded by the number of tables and columns."""
        users = sorted(self.tables().values(), key=lambda t: t.id)
        schemas = [(i, n, T.StructType.fromDDL(ddl)) for n, (i, ddl) in SYSTEM.items()] + [(t.id, t.name, t.schema) for t in users]
        if name == "pg_tables":
            rows = [(i, n, None) for i, n, _ in schemas]
        elif name == "pg_attribute":
            rows = [(i, f.name, f.dataType.simpleString(), k + 1) for i, _, s in schemas for k, f in enumerate(s)]
        else:
            rows = [(x.id, x.name, t.id, ",".join(x.keys), None, x.unique) for t in users for x in t.indexes.values()]
        return self.spark.createDataFrame(rows, SYSTEM[name][1])

    # changing

    def insert(self, name: str, rows: list[tuple | list] | DataFrame, columns: list[str] | None = None) -> int:
        """Appends rows; all are checked before any is written. Columns that aren't named get NULL."""
        t = self.table_info(name)
        wanted = [f.name for f in t.schema] if columns is None else columns
        if len(set(wanted)) < len(wanted) or not set(wanted) <= {f.name for f in t.schema}:
            raise ConstraintError("insert columns are different columns of the table")
        kinds = {f.name: f.dataType for f in t.schema}
        if isinstance(rows, DataFrame):
            if len(rows.columns) != len(wanted):
                raise ConstraintError(f"{len(rows.columns)} values for {len(wanted)} columns")
            for f, c in zip(rows.schema, wanted):
                check_assignable(None if isinstance(f.dataType, T.NullType) else f.dataType, kinds[c])
            df = rows.toDF(*wanted)
        else:
            for r in rows:
                if len(r) != len(wanted):
                    raise ConstraintError(f"{len(r)} values for {len(wanted)} columns")
                for v, c in zip(r, wanted):
                    _check_value(v, kinds[c])
            df = self.spark.createDataFrame([tuple(r) for r in rows], T.StructType([T.StructField(c, kinds[c]) for c in wanted])).coalesce(1)
        df = df.select(*[(F.col(f"`{f.name}`") if f.name in wanted else F.lit(None)).cast(f.dataType).alias(f.name) for f in t.schema])

        def change():
            new = self.db.write(df, name)
            self._unique(t, t.files, new)
            self._put(t, t.files + new, new)
            return self._read(t, new).count() if isinstance(rows, DataFrame) else len(rows)

        return self._do(change)

    def update(self, name: str, values: dict[str, Column | Expr | Any], cond: Column | Expr | str | None = None) -> int:
        """Sets columns of rows for which the condition is true, from their values before; returns how many matched."""
        t = self.table_info(name)
        kinds = {f.name: f.dataType for f in t.schema}
        if not values or not set(values) <= kinds.keys():
            raise ConstraintError(f"no such column: {sorted(set(values) - kinds.keys())}")
        new = {}
        for c, v in values.items():
            if not isinstance(v, Column):
                v = v if isinstance(v, Expr) else Literal(v)
                if isinstance(v, Literal):
                    _check_value(v.value, kinds[c])
                else:
                    check_assignable(v.type(t.schema), kinds[c])
                v = v.column(t.schema)
            new[c] = v.cast(kinds[c])
        hit = self._cond(t, cond)

        def change():
            return self._rewrite(t, hit, lambda df: df.select(*[F.when(hit, new[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in new else F.col(f"`{c}`") for c in kinds]), set(new))

        return self._do(change)

    def delete(self, name: str, cond: Column | Expr | str | None = None) -> int:
        """Removes rows for which the condition is true; returns how many."""
        t = self.table_info(name)
        hit = self._cond(t, cond)

        def change():
            if cond is None:  # nothing is left to write
                n = self._read(t, t.files).count()
                self._put(t, [], [])
                return n
            return self._rewrite(t, hit, lambda df: df.where(~hit))

        return self._do(change)

    def _cond(self, t: Table, cond: Column | Expr | str | None) -> Column:
        if cond is None:
            return F.lit(True)
        if isinstance(cond, Expr):
            check_predicate(cond, t.schema)
            cond = cond.column(t.schema)
        return F.coalesce(F.expr(cond) if isinstance(cond, str) else cond, F.lit(False))

    def _rewrite(self, t: Table, hit: Column, make, changes: set[str] = frozenset()) -> int:
        """Replaces the files that hold a hit. One pass counts hits by file; the count of files bounds what it returns. changes: columns with new values."""
        if not t.files:
            return 0
        counts = self._read(t, t.files).where(hit).groupBy(F.input_file_name().alias("file")).count().collect()
        if not counts:
            return 0
        names = {self.db.files.full(f).split("/data/")[-1]: f for f in t.files}
        old = {names[_unquoted(r.file).split("/data/")[-1]] for r in counts}
        new = self.db.write(make(self._read(t, sorted(old))), t.name)
        left = [f for f in t.files if f not in old]
        self._unique(t, left, new, changes)
        self._put(t, left + new, new)
        return sum(r["count"] for r in counts)

    def _put(self, t: Table, files: list[str], new: list[str]) -> None:
        self.changed[t.name] = Table(t.id, t.name, t.schema, files, {n: self._followed(t, i, files, new) for n, i in t.indexes.items()})

    def _followed(self, t: Table, i: Index, files: list[str], new: list[str]) -> Index:
        """The index after a change: the new files get a sorted copy of their own, so the work is that of the change.

        Rows of files that are gone stay in older copies and are passed over by readers, until the copies or such files
        are too many and the index is built as one.
        """
        live = set(files)
        runs = {path: held for path, held in i.runs.items() if live & set(held)}
        held = sum(map(len, runs.values()))
        gone = held - sum(len(live & set(h)) for h in runs.values())
        if len(runs) + bool(new) > MOST_RUNS or 2 * gone > max(held, 1):
            runs, new = {}, files
        return Index(i.id, i.name, i.keys, i.unique, runs | self._sorted(t, i, new))

    def _sorted(self, t: Table, i: Index, files: list[str]) -> dict[str, list[str]]:
        """A sorted copy of some files, as a run."""
        if not files:
            return {}
        path = f"index/{i.name}/{uuid.uuid4().hex}"
        rows = self._read(t, files).select("*", _file_of().alias(OF_FILE))
        ix.build(rows, i.keys, self.db.files.full(path))
        return {path: list(files)}

    def _unique(self, t: Table, old: list[str], new: list[str], changes: set[str] | None = None) -> None:
        """Fails if a unique key of the new files stands twice in them, or in the old ones too. NULL keys don't count. changes: only indexes over one of these columns."""
        for i in t.indexes.values():
            if not i.unique or changes is not None and not changes & set(i.keys):
                continue
            keys = [F.col(f"`{k}`") for k in i.keys]
            fresh = self._read(t, new).select(*keys).dropna()
            twice = not fresh.groupBy(*keys).count().where("count > 1").isEmpty()
            # Spark sees the size of the new files and broadcasts their keys where these are few
            if twice or old and not self._read(t, old).select(*keys).join(fresh, i.keys, "left_semi").isEmpty():
                raise ConstraintError(f"index {i.name}: a key would not be unique")

    # indexes

    def create_index(self, name: str, table: str, keys: list[str], unique: bool = False) -> None:
        t = self.table_info(table)
        if any(name in x.indexes for x in self.tables().values()):
            raise CatalogError(f"index {name} exists")
        if not keys or not set(keys) <= {f.name for f in t.schema}:
            raise ConstraintError("an index needs columns of its table")

        def change():
            made = Table(t.id, t.name, t.schema, t.files, {**t.indexes, name: Index(-1, name, keys, unique)})
            self._unique(made, [], t.files)
            made.indexes[name].runs = self._sorted(t, made.indexes[name], t.files)
            self.changed[table] = made

        self._do(change)

    def drop_index(self, name: str, if_exists: bool = False) -> bool:
        t = next((t for t in self.tables().values() if name in t.indexes), None)
        if t is None:
            if if_exists:
                return False
            raise CatalogError(f"no index {name}")

        def change():
            self.changed[t.name] = Table(t.id, t.name, t.schema, t.files, {n: i for n, i in t.indexes.items() if n != name})

        self._do(change)
        return True

    def index(self, name: str) -> tuple[DataFrame, list[str]]:
        """The table of an index as its sorted copies hold it, and the keys; what lies outside a range of keys isn't read."""
        t = next((t for t in self.tables().values() if name in t.indexes), None)
        if t is None:
            raise CatalogError(f"no index {name}")
        return self._by_index(t, t.indexes[name]), t.indexes[name].keys

    def _by_index(self, t: Table, i: Index) -> DataFrame:
        if self.base is not None:
            self.seen.setdefault(t.name, list(t.files))
        if not t.files:
            return self._read(t, [])
        df = self.spark.read.schema(T.StructType([*t.schema.fields, T.StructField(OF_FILE, T.StringType())])).parquet(*map(self.db.files.full, i.runs))
        gone = sorted({f for held in i.runs.values() for f in held} - set(t.files))
        return (df.where(~F.col(OF_FILE).isin([f.split("/", 2)[2] for f in gone])) if gone else df).drop(OF_FILE)

    def table_by(self, name: str, compared: set[str]) -> DataFrame:
        """A table for a query that compares these columns with constants: by the index that the most leading keys of are among them, if any."""
        if name in SYSTEM:
            return self.table(name)
        t = self.table_info(name)

        def led(i: Index) -> int:
            return next((n for n, k in enumerate(i.keys) if k.lower() not in compared), len(i.keys))

        best = max(t.indexes.values(), key=led, default=None)
        return self._by_index(t, best) if best is not None and led(best) else self.table(name)

    def lookup(self, name: str, values: list[Any]) -> DataFrame:
        """Rows of a table by all or the first of an index's keys."""
        df, keys = self.index(name)
        return ix.prefix(df, keys, values)

    def cursor(self, name: str) -> Cursor:
        return Cursor(self, name)

    def lookup_range(self, name: str, start: list[Any] | None = None, end: list[Any] | None = None, **how: Any) -> DataFrame:
        df, keys = self.index(name)
        return ix.range_(df, keys, start, end, **how)


class Cursor:
    """Walks an index in both directions, a page at a time; fails once the table has changed.

    A page is a top-k over what lies beyond the place reached, so its cost doesn't grow with the pages before.
    """

    def __init__(self, session: Session, name: str):
        self.session, self.name = session, name
        self.df, self.keys = session.index(name)
        self.mark = self._files()
        self.at: Row | None = None  # the last row given

    def _files(self) -> list[str]:
        return next((list(t.files) for t in self.session.tables().values() if self.name in t.indexes), [])

    def _page(self, n: int, down: bool, start: list[Any] | None = None) -> list[Row]:
        if self._files() != self.mark:
            raise ConflictError(f"the table of {self.name} has changed under the cursor")
        rows = self.df.select("*", F.col("_metadata.file_path").alias("file__"), F.col("_metadata.row_index").alias("row__")) if self.mark else self.df.withColumns({"file__": F.lit(""), "row__": F.lit(0)})
        order = [*self.keys, "file__", "row__"]
        if start is not None:
            rows = ix.range_(rows, self.keys, start, None)
        elif self.at is not None:
            here = [self.at[c] for c in order]
            rows = ix.range_(rows, order, None if down else here, here if down else None, include_start=False)
        return rows.orderBy(*[F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_first() for c in order]).limit(n).collect()

    def _give(self, page: list[Row]) -> list[Row]:
        if page:
            self.at = page[-1]
        return [Row(**{k: v for k, v in r.asDict().items() if k not in ("file__", "row__")}) for r in page]

    def seek(self, values: list[Any]) -> Row | None:
        """Goes to the first row whose keys are at or after the values."""
        return next(iter(self._give(self._page(1, False, values))), None)

    def advance(self, n: int = 1) -> list[Row]:
        """The next rows in the order of the keys, from the first if the cursor is new."""
        return self._give(self._page(n, False))

    def back(self, n: int = 1) -> list[Row]:
        """The rows before, backwards, from the last if the cursor is new."""
        return self._give(self._page(n, True))


def _mark(t: Table | None):
    return None if t is None else (t.id, t.files, sorted(t.indexes))


def _file_of() -> Column:
    """A row's file, by its name below its table's folder."""
    return F.regexp_extract(F.col("_metadata.file_path"), "data/[^/]+/([^/]+/[^/]+)$", 1)


def _unquoted(path: str) -> str:
    from urllib.parse import unquote

    return unquote(path)


def _check_value(v: Any, kind: T.DataType) -> None:
    """A Python value of exactly a column's type, or None."""
    if v is None:
        return
    if isinstance(kind, (T.IntegerType, T.LongType)) and isinstance(v, int) and not isinstance(v, bool):
        bits = 31 if isinstance(kind, T.IntegerType) else 63
        if -(1 << bits) <= v < 1 << bits:
            return
        raise ConstraintError(f"{v} is out of range")
    if isinstance(kind, (T.FloatType, T.DoubleType)) and isinstance(v, float):
        return
    if not isinstance(kind, (T.IntegerType, T.LongType, T.FloatType, T.DoubleType)):
        import datetime
        import decimal

        wanted = {T.BooleanType: bool, T.StringType: str, T.DateType: datetime.date, T.TimestampNTZType: datetime.datetime, T.TimestampType: datetime.datetime, T.DecimalType: decimal.Decimal, T.BinaryType: (bytes, bytearray)}
        if isinstance(v, wanted.get(type(kind), object)):
            return
    check_assignable(Literal(v).type(T.StructType()), kind)


def show_row(row: Row) -> list[str | None]:
    """Cells as text: booleans t and f, numbers in decimal, NULL as None."""
    return [None if v is None else ("t" if v else "f") if isinstance(v, bool) else str(v) for v in row]
