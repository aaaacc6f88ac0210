"""Registered queries of the relational engine, each with the DuckDB SQL for the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import expressions as E
from quillon.functions.expressions import col, lit
from quillon.operators import filters as fb
from quillon.operators import relational as R
from quillon.plans.sql import Engine, Tokens
from quillon.sources.store import Session

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return R.scan(spark, f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE[key] = sql
        return f

    return add


def on_table(name: str, source: str, sql: str, make: Callable[[DataFrame], DataFrame]) -> None:
    """A query over one table."""
    query(sql, name)(lambda spark, d: make(table(spark, d, source)))


DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _engine(spark: SparkSession, d: str | None = None, text: str = "") -> Engine:
    """A new database in the cluster's shared folder: that of checkpoints, else the warehouse; /tmp serves local mode only. d: from where to attach the tables that `text` names."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = tempfile.gettempdir() if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local" else spark.conf.get("spark.sql.warehouse.dir")
    e = Engine.create(spark, f"{root}/quillon/{uuid.uuid4().hex}")
    words = {t for t, _, _ in Tokens(text).items} if text else set()
    for t in DRIVER_TABLES:
        if t in words:
            e.attach(t, table(spark, d, t))
    return e


def through_sql(name: str, text: str, oracle: str | None = None, args: list | dict | None = None) -> None:
    """A query that the engine executes over the driver's tables; DuckDB runs the same text unless told otherwise."""
    query(text if oracle is None else oracle, name)(lambda spark, d: _engine(spark, d, text).execute(text, args).rows)


def _plain_names(df: DataFrame) -> DataFrame:
    """SUM(x) becomes sum_x, for drivers that select columns by text."""
    return df.toDF(*[c.lower().replace("*", "all").replace("(", "_").rstrip(")") for c in df.columns])


# scans, projections, filters

on_table("scan_project", "nation", "SELECT n_name, n_nationkey FROM nation", lambda n: R.project(n, ["n_name", "n_nationkey"]))
on_table("project_duplicate", "region", "SELECT r_name AS a, r_name AS b FROM region", lambda r: R.project(r, [1, 1], ["a", "b"]))
on_table("project_computed", "region", "SELECT r_regionkey, r_regionkey + 1 AS next, upper(r_name) AS big, 'x' AS x FROM region", lambda r: R.project(r, [0, col(0) + 1, E.Call("upper", (col("r_name"),)), lit("x")], ["r_regionkey", "next", "big", "x"]))
query("SELECT 1 AS one, 'a' AS a, TRUE AS yes", "values_no_from")(lambda spark, d: R.values(spark, "1 AS one", "'a' AS a", "TRUE AS yes"))
for _name, _op, _make in (("eq", "=", fb.column_equals), ("ne", "<>", fb.column_not_equals), ("lt", "<", fb.column_lt), ("le", "<=", fb.column_le), ("gt", ">", fb.column_gt), ("ge", ">=", fb.column_ge)):
    on_table(f"filter_cmp_{_name}", "part", f"SELECT p_partkey, p_size FROM part WHERE p_size {_op} 25", lambda p, make=_make: R.where(p, make("p_size", 25)).select("p_partkey", "p_size"))
on_table("filter_and_or_not", "part", "SELECT p_partkey, p_size, p_brand FROM part WHERE (p_size > 40 AND p_brand = 'Brand#13') OR NOT (p_size >= 5)", lambda p: R.where(p, (col("p_size").gt(40) & col("p_brand").eq("Brand#13")) | ~col("p_size").ge(5)).select("p_partkey", "p_size", "p_brand"))
on_table(
    "filter_null_3vl",
    "part",
    "SELECT p_partkey, s, s IS NULL AS none, s > 10 OR TRUE AS t, s > 10 AND FALSE AS f, s + 5 AS n FROM (SELECT p_partkey, nullif(p_size, 7) AS s FROM part) WHERE NOT (s = 9) OR s IS NULL",
    lambda p: (lambda x: R.project(R.where(x, ~col("s").eq(9) | col("s").is_null()), ["p_partkey", "s", col("s").is_null(), col("s").gt(10) | lit(True), col("s").gt(10) & lit(False), col("s") + 5], ["p_partkey", "s", "none", "t", "f", "n"]))(p.select("p_partkey", F.expr("nullif(p_size, 7)").alias("s"))),
)
on_table("filter_string", "orders", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus > 'F' AND o_orderpriority <= '3-MEDIUM'", lambda o: R.where(o, col("o_orderstatus").gt("F") & col("o_orderpriority").le("3-MEDIUM")).select("o_orderkey", "o_orderstatus"))
on_table("filter_starts_ends", "part", "SELECT p_partkey, p_type FROM part WHERE starts_with(p_type, 'S') OR ends_with(p_type, 'L')", lambda p: R.where(p, fb.any_of(fb.column_starts_with("p_type", "S"), fb.column_ends_with("p_type", "L"))).select("p_partkey", "p_type"))

# expressions

_WRAP = "CAST((((({}) + 2147483648) % 4294967296 + 4294967296) % 4294967296) - 2147483648 AS INT)"
on_table("expr_arith", "part", "SELECT p_partkey, p_size + 3 AS a, p_size - 30 AS b, p_size * 4 AS c, -p_size AS d FROM part", lambda p: R.project(p, ["p_partkey", col("p_size") + 3, col("p_size") - 30, col("p_size") * 4, -col("p_size")], ["p_partkey", "a", "b", "c", "d"]))
_BIG = "CAST(p_size AS BIGINT)"
on_table(
    "expr_wrap",
    "part",
    f"SELECT p_partkey, {_WRAP.format(_BIG + ' + 2147483600')} AS a, {_WRAP.format('-2147483600 - ' + _BIG + ' * 3')} AS b, {_WRAP.format(_BIG + ' * 2000000011')} AS c FROM part",
    lambda p: R.project(p, ["p_partkey", col("p_size") + 2147483600, lit(-2147483600) - col("p_size") * 3, col("p_size") * 2000000011], ["p_partkey", "a", "b", "c"]),
)
on_table("expr_int_div", "part", "SELECT p_partkey, CAST((p_size - 25) // 4 AS INT) AS q, CAST(100 // p_size AS INT) AS r FROM part WHERE p_size <> 0", lambda p: R.project(R.where(p, col("p_size").ne(0)), ["p_partkey", (col("p_size") - 25) / 4, lit(100) / col("p_size")], ["p_partkey", "q", "r"]))
on_table("expr_mod", "part", "SELECT p_partkey, (p_size - 25) % 7 AS m FROM part", lambda p: R.project(p, ["p_partkey", (col("p_size") - 25) % 7], ["p_partkey", "m"]))
on_table("expr_concat", "part", "SELECT p_partkey, p_brand || ' / ' || nullif(p_type, 'SMALL') AS s FROM part", lambda p: R.project(p.withColumn("t", F.expr("nullif(p_type, 'SMALL')")), ["p_partkey", col("p_brand").concat(" / ").concat(col("t"))], ["p_partkey", "s"]))
on_table("expr_case", "part", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS size, CASE WHEN p_size = 1 THEN 1 END AS one FROM part", lambda p: R.project(p, ["p_partkey", E.Case(((col("p_size").lt(10), lit("small")), (col("p_size").lt(30), lit("middle"))), lit("large")), E.Case(((col("p_size").eq(1), lit(1)),))], ["p_partkey", "size", "one"]))
on_table("expr_cast", "part", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS s, CAST(p_size AS BIGINT) AS b, CAST(p_size AS DOUBLE) AS d FROM part", lambda p: R.project(p, ["p_partkey", col("p_size").cast(T.StringType()), col("p_size").cast(T.LongType()), col("p_size").cast(T.DoubleType())], ["p_partkey", "s", "b", "d"]))
on_table("expr_in", "part", "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 5, 49)", lambda p: R.where(p, col("p_size").isin(1, 5, 49)).select("p_partkey", "p_size"))
on_table("expr_not_in", "part", "SELECT p_partkey, p_size FROM part WHERE p_size NOT IN (1, 5, 49)", lambda p: R.where(p, ~col("p_size").isin(1, 5, 49)).select("p_partkey", "p_size"))
on_table("expr_between", "part", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20", lambda p: R.where(p, col("p_size").between(10, 20)).select("p_partkey", "p_size"))
on_table("expr_not_between", "part", "SELECT p_partkey, p_size FROM part WHERE p_size NOT BETWEEN 10 AND 20", lambda p: R.where(p, ~col("p_size").between(10, 20)).select("p_partkey", "p_size"))
on_table("expr_like", "customer", "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%1_'", lambda c: R.where(c, fb.column_like("c_name", "%1_")).select("c_custkey", "c_name"))
on_table("expr_not_like", "part", "SELECT p_partkey, p_type FROM part WHERE p_type NOT LIKE '%A%'", lambda p: R.where(p, ~fb.column_like("p_type", "%A%")).select("p_partkey", "p_type"))
on_table("expr_like_escape", "part", "SELECT p_partkey, p_brand || '%' AS b FROM part WHERE p_brand || '%' LIKE '%1!%' ESCAPE '!'", lambda p: R.where(p.select("p_partkey", F.concat("p_brand", F.lit("%")).alias("b")), fb.column_like("b", "%1!%", "!")))

# joins


@query("SELECT o_orderkey, o_orderstatus, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def hash_join_inner(spark: SparkSession, d: str) -> DataFrame:
    return R.hash_join(table(spark, d, "orders"), table(spark, d, "lineitem"), ["o_orderkey"], ["l_orderkey"]).select("o_orderkey", "o_orderstatus", "l_linenumber", "l_quantity")


@query("SELECT a.l_orderkey, a.l_linenumber, b.n FROM lineitem a JOIN (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber")
def hash_join_multi_key(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    b = R.aggregate(a, ["l_orderkey", "l_linenumber"], n=R.count_all()).toDF("k", "m", "n")
    return R.hash_join(a, b, ["l_orderkey", "l_linenumber"], ["k", "m"]).select("l_orderkey", "l_linenumber", "n")


@query("SELECT o_orderkey, o_totalprice, l_extendedprice FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_extendedprice > o_totalprice / 2")
def hash_join_residual(spark: SparkSession, d: str) -> DataFrame:
    return R.hash_join(table(spark, d, "orders"), table(spark, d, "lineitem"), ["o_orderkey"], ["l_orderkey"], "l_extendedprice > o_totalprice / 2").select("o_orderkey", "o_totalprice", "l_extendedprice")


@query("SELECT n_name, r_name FROM (SELECT n_name, nullif(n_regionkey, 2) AS k FROM nation) JOIN (SELECT r_name, nullif(r_regionkey, 2) AS j FROM region) ON k IS NOT DISTINCT FROM j")
def hash_join_null_safe(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_name", F.expr("nullif(n_regionkey, 2) AS k"))
    r = table(spark, d, "region").select("r_name", F.expr("nullif(r_regionkey, 2) AS j"))
    return R.hash_join(n, r, ["k"], ["j"], null_safe=True).select("n_name", "r_name")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey")
def theta_join(spark: SparkSession, d: str) -> DataFrame:
    return R.theta_join(table(spark, d, "nation"), table(spark, d, "region"), "n_regionkey < r_regionkey").select("n_name", "r_name")


for _how, _sql in (("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL")):

    # lines of number 7 get keys that no order has; some orders have no line at all
    @query(f"SELECT o_orderkey, k, l_linenumber FROM orders {_sql} JOIN (SELECT CASE WHEN l_linenumber = 7 THEN -l_orderkey ELSE l_orderkey END AS k, l_linenumber FROM lineitem) ON o_orderkey = k", f"join_{_how}")
    def _outer(spark: SparkSession, d: str, how: str = _how) -> DataFrame:
        l = table(spark, d, "lineitem").select(F.expr("CASE WHEN l_linenumber = 7 THEN -l_orderkey ELSE l_orderkey END AS k"), "l_linenumber")  # noqa: E741
        return R.hash_join(table(spark, d, "orders"), l, ["o_orderkey"], ["k"], how=how).select("o_orderkey", "k", "l_linenumber")


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def join_cross(spark: SparkSession, d: str) -> DataFrame:
    return R.cross_join(table(spark, d, "nation"), table(spark, d, "region")).select("n_name", "r_name")


@query("SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) JOIN (SELECT r_regionkey AS k, r_name FROM region) USING (k)")
def join_using(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("k"), "n_name")
    return R.using_join(n, table(spark, d, "region").select(F.col("r_regionkey").alias("k"), "r_name"), ["k"])


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 7)")
def join_semi(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").where("l_linenumber = 7")  # noqa: E741
    o = table(spark, d, "orders")
    return R.semi_join(o, l, o.o_orderkey == l.l_orderkey).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_anti(spark: SparkSession, d: str) -> DataFrame:
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")  # noqa: E741
    return R.anti_join(o, l, o.o_orderkey == l.l_orderkey).select("o_orderkey")


# aggregation

on_table("agg_global", "lineitem", "SELECT count(*) AS n, sum(l_linenumber)::BIGINT AS s, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM lineitem", lambda x: R.aggregate(x, [], n=R.count_all(), s=F.sum("l_linenumber"), lo=F.min("l_linenumber"), hi=F.max("l_linenumber")))
on_table("agg_empty", "lineitem", "SELECT count(*) AS n, count(l_linenumber) AS c, sum(l_linenumber)::BIGINT AS s, min(l_returnflag) AS lo FROM lineitem WHERE l_linenumber < 0", lambda x: R.aggregate(R.where(x, "l_linenumber < 0"), [], n=R.count_all(), c=F.count("l_linenumber"), s=F.sum("l_linenumber"), lo=F.min("l_returnflag")))
on_table("agg_empty_grouped", "lineitem", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_linenumber < 0 GROUP BY l_returnflag", lambda x: R.aggregate(R.where(x, "l_linenumber < 0"), ["l_returnflag"], n=R.count_all()))
on_table("agg_group1", "lineitem", "SELECT l_returnflag, count(*) AS n, sum(l_linenumber)::BIGINT AS s FROM lineitem WHERE l_linenumber <= 3 GROUP BY l_returnflag", lambda x: R.aggregate(R.where(x, col("l_linenumber").le(3)), ["l_returnflag"], n=R.count_all(), s=F.sum("l_linenumber")))
on_table("agg_group2", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus", lambda x: R.aggregate(x, ["l_returnflag", "l_linestatus"], n=R.count_all(), q=F.round(F.sum("l_quantity"), 2)))
on_table("agg_null_group", "part", "SELECT nullif(p_size % 5, 0) AS k, count(*) AS n, count(nullif(p_size, 7)) AS c FROM part GROUP BY 1", lambda p: R.aggregate(p.select(F.expr("nullif(p_size % 5, 0) AS k"), F.expr("nullif(p_size, 7) AS s")), ["k"], n=R.count_all(), c=F.count("s")))
on_table("agg_sum", "part", "SELECT p_brand, sum(nullif(p_size, 7))::BIGINT AS s FROM part GROUP BY p_brand", lambda p: R.aggregate(p.withColumn("s", F.expr("nullif(p_size, 7)")), ["p_brand"], s=F.sum("s")))
on_table("agg_avg_int", "part", "SELECT p_brand, CAST(sum(p_size - 25) // count(p_size) AS INT) AS a FROM part GROUP BY p_brand", lambda p: R.aggregate(p.withColumn("x", F.expr("p_size - 25")), ["p_brand"], a=R.avg_int("x")))
on_table("agg_avg_double", "lineitem", "SELECT l_returnflag, round(avg(l_quantity), 6) AS a FROM lineitem GROUP BY l_returnflag", lambda x: R.aggregate(x, ["l_returnflag"], a=F.round(F.avg("l_quantity"), 6)))
on_table("agg_min_max", "orders", "SELECT o_orderstatus, min(o_orderpriority) AS lo, max(o_orderpriority) AS hi, min(o_totalprice) AS a, max(o_totalprice) AS b, max(o_orderkey % 2 = 0) AS t FROM orders GROUP BY o_orderstatus", lambda o: R.aggregate(o.withColumn("even", F.expr("o_orderkey % 2 = 0")), ["o_orderstatus"], lo=F.min("o_orderpriority"), hi=F.max("o_orderpriority"), a=F.min("o_totalprice"), b=F.max("o_totalprice"), t=F.max("even")))
on_table("agg_count_distinct", "lineitem", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n, sum(DISTINCT l_linenumber)::BIGINT AS s FROM lineitem GROUP BY l_returnflag", lambda x: R.aggregate(x, ["l_returnflag"], n=F.count_distinct("l_suppkey"), s=F.sum_distinct("l_linenumber")))
on_table("having", "lineitem", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 600", lambda x: R.aggregate(x, ["l_suppkey"], having="n > 600", n=R.count_all()))
on_table("distinct", "lineitem", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", lambda x: R.distinct(x.select("l_returnflag", "l_linestatus")))

# sort, limit

_ALL = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
on_table("sort_multi_key_topk", "lineitem", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 50", lambda x: R.top_k(x.select(*_ALL), 50, R.order("l_quantity", descending=True), ties=_ALL[:4]))
for _name, _down, _first in (("asc_default", False, None), ("desc_default", True, None), ("nulls_last", False, False), ("desc_nulls_first", True, True)):
    _nulls = "FIRST" if (not _down if _first is None else _first) else "LAST"
    on_table(
        f"sort_{_name}",
        "part",
        f"SELECT s, p_partkey FROM (SELECT p_partkey, CASE WHEN p_size > 5 THEN NULL ELSE p_size END AS s FROM part) ORDER BY s {'DESC' if _down else 'ASC'} NULLS {_nulls}, p_partkey",
        lambda p, down=_down, first=_first: R.sort(p.select(F.expr("CASE WHEN p_size > 5 THEN NULL ELSE p_size END AS s"), "p_partkey"), R.order("s", down, first), ties=["p_partkey"]),
    )
_ORDERED = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey"
_orders = lambda o: R.sort(o.select("o_orderkey", "o_totalprice"), "o_orderkey")
on_table("limit_offset", "orders", f"{_ORDERED} LIMIT 20 OFFSET 35", lambda o: R.limit(_orders(o), 20, 35))
on_table("limit_zero", "orders", f"{_ORDERED} LIMIT 0", lambda o: R.limit(_orders(o), 0))
on_table("offset_past_end", "nation", "SELECT n_name FROM nation ORDER BY n_name LIMIT 10 OFFSET 1000", lambda n: R.limit(R.sort(n.select("n_name"), "n_name"), 10, 1000))

# set operations

_sets = lambda o: (o.select("o_custkey", "o_orderpriority"), o.where("o_totalprice > 100000").select("o_custkey", "o_orderpriority"))
for _name, _op, _f in (("union", "UNION", R.union), ("intersect", "INTERSECT", R.intersect), ("except", "EXCEPT", R.difference)):
    for _all in (False, True):
        on_table(
            f"{_name}{'_all' if _all else ''}",
            "orders",
            f"SELECT o_custkey, o_orderpriority FROM orders {_op}{' ALL' if _all else ''} SELECT o_custkey, o_orderpriority FROM orders WHERE o_totalprice > 100000",
            lambda o, f=_f, every=_all: f(*_sets(o), every),
        )

# lookups by key: through an index of the store on the whole table

_KEYS = ["l_orderkey", "l_linenumber"]
_LINE = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem"


def indexed(name: str, sql: str, look: Callable[[Session, str], DataFrame], source: str = "lineitem", columns: list[str] = _ALL, keys: list[str] = _KEYS) -> None:
    """A query that stores a copy of a table, indexes it and reads by the index."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        session = _engine(spark).session
        df = table(spark, d, source).select(*columns)
        session.create_table("t", df.schema)
        session.insert("t", df)
        session.create_index("by_key", "t", keys)
        return look(session, "by_key")

    query(sql, name)(run)


_ORDER = {"source": "orders", "columns": ["o_orderkey", "o_custkey"], "keys": ["o_orderkey"]}
indexed("index_exact", f"{_LINE} WHERE l_orderkey = 100 AND l_linenumber = 3", lambda s, i: s.lookup(i, [100, 3]))
indexed("index_prefix", f"{_LINE} WHERE l_orderkey = 101", lambda s, i: s.lookup(i, [101]))
indexed("index_range", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 50 AND o_orderkey < 90", lambda s, i: s.lookup_range(i, [50], [90]), **_ORDER)
indexed("index_range_composite", f"{_LINE} WHERE (l_orderkey > 40 OR l_orderkey = 40 AND l_linenumber > 3) AND (l_orderkey < 60 OR l_orderkey = 60 AND l_linenumber <= 2)", lambda s, i: s.lookup_range(i, [40, 3], [60, 2], include_start=False, include_end=True))
indexed("index_range_open", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey <= 30", lambda s, i: s.lookup_range(i, None, [30], include_end=True), **_ORDER)
indexed("index_range_ordered", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 70 ORDER BY o_orderkey DESC", lambda s, i: s.lookup_range(i, [70], None, include_start=False, descending=True), **_ORDER)


def _walk(s: Session, i: str) -> DataFrame:
    c = s.cursor(i)
    rows = [("seek", c.seek([50])), *[("next", r) for r in c.advance(3)], *[("back", r) for r in c.back(5)]]
    return s.spark.createDataFrame([(n, how, r.o_orderkey, r.o_custkey) for n, (how, r) in enumerate(rows)], "n int, how string, o_orderkey long, o_custkey long")


_AT = "(SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) AS r, count(*) FILTER (o_orderkey < 50) OVER () AS before FROM orders)"
indexed(
    "index_cursor",
    f"SELECT n, how, o_orderkey, o_custkey FROM {_AT} JOIN (VALUES (0, 'seek', 1), (1, 'next', 2), (2, 'next', 3), (3, 'next', 4), (4, 'back', 3), (5, 'back', 2), (6, 'back', 1), (7, 'back', 0), (8, 'back', -1)) v(n, how, step) ON r = before + step",
    _walk,
    **_ORDER,
)

# SQL texts

through_sql("scalar_subquery", "SELECT p_partkey, p_size FROM part WHERE p_size = (SELECT max(p_size) FROM part)")
through_sql("exists", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
through_sql("in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
through_sql("not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
through_sql("sql_alias_qualified", "SELECT t.n_name AS name, r.* FROM nation AS t JOIN region r ON t.n_regionkey = r.r_regionkey")
through_sql("sql_group_having_order", "SELECT c_mktsegment, count(*) AS n, count(DISTINCT c_nationkey) AS k FROM customer GROUP BY c_mktsegment HAVING count(*) > 10 ORDER BY n DESC, c_mktsegment LIMIT 3")
through_sql("sql_case_cast_like", "SELECT p_partkey, CASE p_size WHEN 1 THEN 'one' ELSE CAST(p_size AS STRING) END AS s FROM part WHERE p_name LIKE '%a%' AND NOT p_type LIKE 'S%'")
through_sql("sql_cte_union", "WITH a AS (SELECT n_name AS x FROM nation), b AS (SELECT r_name AS x FROM region) SELECT x FROM a UNION ALL SELECT x FROM b")
through_sql("sql_int_div", "SELECT p_partkey, (p_size - 25) / 4 AS q, p_partkey / 7 AS b, p_retailprice / 2 AS d FROM part WHERE p_size / 2 <> 3 AND (p_size + 1) / 2 * 2 - p_size < 1", "SELECT p_partkey, CAST((p_size - 25) // 4 AS INT) AS q, p_partkey // 7 AS b, p_retailprice / 2 AS d FROM part WHERE p_size // 2 <> 3 AND (p_size + 1) // 2 * 2 - p_size < 1")
through_sql("sql_wrap", "SELECT p_partkey, p_size + 2147483600 AS a, -2147483600 - p_size * 3 AS b, p_size * 2000000011 AS c FROM part WHERE 2147483647 + p_size < 0", f"SELECT p_partkey, {_WRAP.format(_BIG + ' + 2147483600')} AS a, {_WRAP.format('-2147483600 - ' + _BIG + ' * 3')} AS b, {_WRAP.format(_BIG + ' * 2000000011')} AS c FROM part WHERE p_size > 0")
through_sql("sql_unary", "SELECT p_partkey, +p_size AS a, - -p_size AS b, -(p_size - 3) AS c FROM part")
through_sql("sql_prepared", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = ? AND o_totalprice > ? AND o_orderpriority LIKE ?", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 150000.5 AND o_orderpriority LIKE '%-H%'", ["F", 150000.5, "%-H%"])
through_sql("sql_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
through_sql("sql_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (WHERE l_quantity > 25) AS big FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
through_sql("sql_functions", "SELECT p_partkey, lower(p_name) AS a, length(p_type) AS b, substring(p_brand, 7, 2) AS c, replace(p_type, 'A', '-') AS d, abs(p_size - 25) AS e, coalesce(nullif(p_size, 7), -1) AS f, trim(p_type) AS g FROM part", "SELECT p_partkey, lower(p_name) AS a, CAST(length(p_type) AS INT) AS b, substring(p_brand, 7, 2) AS c, replace(p_type, 'A', '-') AS d, abs(p_size - 25) AS e, coalesce(nullif(p_size, 7), -1) AS f, trim(p_type) AS g FROM part")
on_table("agg_default_names", "part", 'SELECT p_brand, count(*) AS count_all, sum(p_size)::BIGINT AS sum_p_size, CAST(sum(p_size) // count(p_size) AS INT) AS avg_p_size, min(p_name) AS min_p_name FROM part GROUP BY p_brand', lambda p: _plain_names(R.aggregate_calls(p, ["p_brand"], ("count", "*"), ("sum", "p_size"), ("avg", "p_size"), ("min", "p_name"))))
on_table("expr_unary", "part", "SELECT p_partkey, p_size AS a, -p_size AS b, TRUE AS c FROM part", lambda p: R.project(p, ["p_partkey", +col("p_size"), -col("p_size"), lit((lit(2) * 3).is_constant() and (lit(2) * 3).type(p.schema) == T.IntegerType())], ["p_partkey", "a", "b", "c"]))


# pipelines over several operators


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_size >= 10 AND p_retailprice < 1500 ORDER BY p_size DESC, p_partkey LIMIT 10")
def pipeline_topk(spark: SparkSession, d: str) -> DataFrame:
    p = R.where(table(spark, d, "part"), "p_size >= 10 AND p_retailprice < 1500")
    return R.project(R.top_k(p, 10, R.order("p_size", descending=True), ties=["p_partkey"]), ["p_partkey", "p_name", "p_size"])


@query(
    "SELECT n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE l_quantity > 10 GROUP BY n_name ORDER BY n DESC, n_name LIMIT 10"
)
def pipeline_join_agg_sort(spark: SparkSession, d: str) -> DataFrame:
    line = R.where(table(spark, d, "lineitem"), "l_quantity > 10")
    sales = R.hash_join(R.hash_join(line, table(spark, d, "orders"), ["l_orderkey"], ["o_orderkey"]), table(spark, d, "customer"), ["o_custkey"], ["c_custkey"])
    named = R.hash_join(sales, table(spark, d, "nation"), ["c_nationkey"], ["n_nationkey"])
    out = R.aggregate(named, ["n_name"], n=R.count_all(), revenue=F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2))
    return R.top_k(out, 10, R.order("n", descending=True), ties=["n_name"])


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q, round(sum(l_extendedprice), 2) AS base, round(avg(l_discount), 6) AS disc, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    return R.aggregate(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], q=F.round(F.sum("l_quantity"), 2), base=F.round(F.sum("l_extendedprice"), 2), disc=F.round(F.avg("l_discount"), 6), n=R.count_all())


# tables that change: a database of its own for each call


def _nation(spark: SparkSession, d: str) -> Engine:
    e = _engine(spark)
    e.execute("CREATE TABLE n (k INT PRIMARY KEY, name VARCHAR(25) NOT NULL, region INT)")
    e.session.insert("n", table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    return e


@query("SELECT n_nationkey AS k, n_name AS name, n_regionkey AS region FROM nation UNION ALL VALUES (100, 'it''s', NULL), (-1, NULL, 7)")
def dml_insert(spark: SparkSession, d: str) -> DataFrame:
    e = _nation(spark, d)
    e.execute("INSERT INTO n VALUES (100, 'it''s', NULL)")
    e.execute("INSERT INTO n (region, k) VALUES (3 + 4, -1)")
    return e.execute("SELECT * FROM n").rows


@query("SELECT n_nationkey AS k, CASE WHEN n_regionkey = 2 THEN 'two' ELSE n_name END AS name, CASE WHEN n_regionkey = 2 THEN n_nationkey + 1 ELSE n_regionkey END AS region FROM nation")
def dml_update(spark: SparkSession, d: str) -> DataFrame:
    e = _nation(spark, d)
    e.execute("UPDATE n SET name = 'two', region = k + 1 WHERE region = 2")
    return e.execute("SELECT * FROM n").rows


@query("SELECT n_nationkey AS k, n_name AS name, n_regionkey AS region FROM nation WHERE NOT (n_regionkey = 1 OR n_name LIKE '%A')")
def dml_delete(spark: SparkSession, d: str) -> DataFrame:
    e = _nation(spark, d)
    e.execute("DELETE FROM n WHERE region = 1 OR name LIKE '%A'")
    return e.execute("SELECT * FROM n").rows


@query("SELECT n_nationkey AS k, n_name AS name, 0 AS region FROM nation WHERE n_regionkey <> 3")
def transaction(spark: SparkSession, d: str) -> DataFrame:
    e = _nation(spark, d)
    for s in ("BEGIN", "DELETE FROM n", "ROLLBACK", "BEGIN TRANSACTION", "DELETE FROM n WHERE region = 3", "UPDATE n SET region = 0", "COMMIT WORK"):
        e.execute(s)
    return e.execute("SELECT * FROM n").rows


@query("SELECT n_nationkey AS k, n_name AS name, n_regionkey AS region FROM nation WHERE n_regionkey = 2")
def index_table(spark: SparkSession, d: str) -> DataFrame:
    e = _nation(spark, d)
    e.execute("CREATE INDEX by_region ON n (region, k)")
    return e.session.lookup("by_region", [2])


@query("SELECT n_nationkey AS k, n_name AS name, 2 AS region FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 2 UNION ALL VALUES (100, 'new', 2)")
def index_maintained(spark: SparkSession, d: str) -> DataFrame:
    """An index follows inserts, updates and deletes."""
    e = _nation(spark, d)
    for s in ("CREATE INDEX by_region ON n (region)", "INSERT INTO n VALUES (100, 'new', 2), (101, 'gone', 2)", "UPDATE n SET region = 2 WHERE region = 1", "DELETE FROM n WHERE k = 101"):
        e.execute(s)
        e.session.lookup("by_region", [2])
    return e.session.lookup("by_region", [2])


@query("SELECT * FROM (VALUES ('n', 0::BIGINT), ('again', 1::BIGINT)) v(table_name, indexes)")
def drop_and_create(spark: SparkSession, d: str) -> DataFrame:
    e = _nation(spark, d)
    for s in ("CREATE TABLE gone (a INT)", "CREATE INDEX i ON n (k)", "DROP INDEX i", "DROP TABLE gone", "DROP TABLE IF EXISTS gone", "CREATE TABLE again (a INT, b DOUBLE PRECISION)", "CREATE UNIQUE INDEX j ON again (b, a)"):
        e.execute(s)
    return e.execute("SELECT t.table_name, count(i.index_id) AS indexes FROM pg_tables t LEFT JOIN pg_index i ON t.table_id = i.table_id WHERE t.table_id > 3 GROUP BY t.table_name").rows


@query("SELECT n_nationkey AS k, n_name AS name, n_regionkey AS region FROM nation WHERE n_nationkey = 7")
def tuple_fetch(spark: SparkSession, d: str) -> DataFrame:
    """A row by its address in the table's heap of files."""
    s = _nation(spark, d).session
    at = s.addressed("n").where("k = 7").first()
    return s.fetch("n", at.row_file, at.row_index)


@query("SELECT n_nationkey AS k, n_name AS name, n_regionkey AS region FROM nation WHERE n_regionkey <> 3 UNION ALL VALUES (200, NULL, 4)")
def dml_prepared(spark: SparkSession, d: str) -> DataFrame:
    e = _nation(spark, d)
    e.prepare("DELETE FROM n WHERE region = ?").execute([3])
    e.prepare("INSERT INTO n VALUES (:k, :name, :k / 50)").execute({"k": 200, "name": None})
    return e.execute("SELECT * FROM n").rows


@query("SELECT * FROM (VALUES ('read committed', 1), ('repeatable read', 25), ('serializable', 25)) v(level, n)")
def isolation_levels(spark: SparkSession, d: str) -> DataFrame:
    """What a transaction counts after another one has left one row of 25."""
    out = []
    for level in Session.LEVELS:
        e = _nation(spark, d)
        reader = Engine(spark, e.session.db, level)
        reader.execute("BEGIN")
        reader.execute("SELECT count(*) FROM n").text()
        e.execute("DELETE FROM n WHERE k > 0")
        out.append((level, int(reader.execute("SELECT count(*) FROM n").text()[0][0])))
        reader.execute("ROLLBACK")
    return spark.createDataFrame(out, "level string, n int")


@query("SELECT * FROM (VALUES (TRUE, 'SELECT')) v(scans, tag)")
def explain_text(spark: SparkSession, d: str) -> DataFrame:
    text = "EXPLAIN SELECT n_name FROM nation WHERE n_regionkey = 1"
    e = _engine(spark, d, text)
    plan = e.execute(text).rows
    scans = plan.agg(F.max(F.col("plan").contains("PushedFilters: [IsNotNull(n_regionkey), EqualTo(n_regionkey,1)]"))).first()[0]
    return spark.createDataFrame([(scans, e.execute("SELECT 1").tag)], "scans boolean, tag string")


@query("SELECT * FROM (VALUES (4, 'k', 'int', 1), (4, 'name', 'string', 2), (4, 'region', 'int', 3)) v(table_id, column_name, column_type, column_order)")
def catalog_columns(spark: SparkSession, d: str) -> DataFrame:
    return _nation(spark, d).execute("SELECT table_id, column_name, column_type, column_order FROM pg_attribute WHERE table_id = 4").rows


@query("SELECT * FROM (VALUES (1, 'pg_tables'), (2, 'pg_attribute'), (3, 'pg_index'), (4, 'n')) v(table_id, table_name)")
def catalog_tables(spark: SparkSession, d: str) -> DataFrame:
    return _nation(spark, d).execute("SELECT table_id, table_name FROM pg_tables").rows


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
