"""Operators on small inputs with known results."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon import errors
from quillon.functions import expressions as E
from quillon.functions.expressions import col, lit
from quillon.functions.types import parse_type
from quillon.operators import filters as fb
from quillon.operators import index as ix
from quillon.operators import relational as R


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def emp(spark):
    return spark.createDataFrame([(1, "Alice", 10), (2, "Bob", 20), (3, "Charlie", 10)], "emp_id int, emp_name string, dept_id int")


@pytest.fixture(scope="module")
def nulls(spark):
    left = spark.createDataFrame([(1, 10), (2, None), (3, 30)], "id int, value int")
    right = spark.createDataFrame([(4, 10), (5, None), (6, 30)], "id2 int, value2 int")
    return left, right


def test_hash_join(spark, emp):
    dept = spark.createDataFrame([(10, "Sales"), (20, "IT"), (30, "HR")], "dept_id int, dept_name string")
    got = R.hash_join(emp, dept, ["dept_id"], ["dept_id"])
    assert got.columns == ["emp_id", "emp_name", "dept_id", "dept_id", "dept_name"]
    assert rows(got) == [(1, "Alice", 10, 10, "Sales"), (2, "Bob", 20, 20, "IT"), (3, "Charlie", 10, 10, "Sales")]


def test_hash_join_multi_key(spark):
    a = spark.createDataFrame([(1, 10, "A"), (2, 20, "B"), (3, 10, "A")], "id int, key1 int, key2 string")
    b = spark.createDataFrame([(10, "A", "Match1"), (20, "B", "Match2"), (10, "B", "NoMatch")], "k1 int, k2 string, data string")
    assert rows(R.hash_join(a, b, ["key1", "key2"], ["k1", "k2"]).select("id", "data")) == [(1, "Match1"), (2, "Match2"), (3, "Match1")]


def test_hash_join_residual(spark):
    a = spark.createDataFrame([(1, 100, 1), (2, 200, 1), (3, 300, 2)], "id int, value int, key int")
    b = spark.createDataFrame([(1, 150), (2, 250)], "k int, threshold int")
    assert rows(R.hash_join(a, b, ["key"], ["k"], "value > threshold").select("id")) == [(2,), (3,)]


def test_null_keys(nulls):
    left, right = nulls
    assert rows(R.hash_join(left, right, ["value"], ["value2"], null_safe=True).select("id", "id2")) == [(1, 4), (2, 5), (3, 6)]
    assert rows(R.hash_join(left, right, ["value"], ["value2"]).select("id", "id2")) == [(1, 4), (3, 6)]
    assert rows(R.theta_join(left, right, "value = value2").select("id", "id2")) == [(1, 4), (3, 6)]


def test_join_sizes_and_errors(spark, nulls):
    a = spark.range(100).select("id", (F.col("id") % 10).alias("key"))
    b = spark.range(20).select((F.col("id") % 10).alias("k"))
    assert R.hash_join(a, b, ["key"], ["k"]).count() == 200
    for keys in ([], ["value"]), ([], []):
        with pytest.raises(errors.ConstraintError):
            R.hash_join(*nulls, *keys)


def test_aggregates(spark):
    v = spark.createDataFrame([("Sales", 1000), ("IT", 2000), ("Sales", 1500), ("IT", 2500), (None, None), (None, 3)], "dept string, amount int")
    got = R.aggregate(v, ["dept"], n=R.count_all(), c=F.count("amount"), s=F.sum("amount"), a=R.avg_int("amount"), lo=F.min("amount"), hi=F.max("amount"))
    assert rows(got) == [("IT", 2, 2, 4500, 2250, 2000, 2500), ("Sales", 2, 2, 2500, 1250, 1000, 1500), (None, 2, 1, 3, 3, 3, 3)]
    none = R.aggregate(v.where("false"), [], n=R.count_all(), s=F.sum("amount"))
    assert rows(none) == [(0, None)]
    empty = spark.createDataFrame([(None,)] * 3, "x int")
    assert rows(R.aggregate(empty, [], c=F.count("x"), s=F.sum("x"), a=R.avg_int("x"), lo=F.min("x"))) == [(0, None, None, None)]
    assert rows(R.aggregate(spark.createDataFrame([(-7,), (0,)], "x int"), [], a=R.avg_int("x"))) == [(-3,)]
    with pytest.raises(errors.ConstraintError):
        R.aggregate(v, ["dept"])


def test_sort_and_nulls(spark):
    df = spark.createDataFrame([(10,), (None,), (30,), (20,), (None,)], "x int")
    take = lambda *k: [r.x for r in R.sort(df, *k).collect()]
    assert take("x") == [None, None, 10, 20, 30]
    assert take(R.order("x", descending=True)) == [30, 20, 10, None, None]
    assert take(R.order("x", nulls_first=False)) == [10, 20, 30, None, None]
    assert take(R.order("x", True, nulls_first=True)) == [None, None, 30, 20, 10]
    goods = spark.createDataFrame([("Electronics", 100, "Mouse"), ("Books", 20, "B"), ("Electronics", 200, "TV"), ("Books", 15, "A"), ("Electronics", 100, "Cable")], "c string, p int, n string")
    assert [tuple(r) for r in R.sort(goods, "c", R.order("p", True), "n").collect()] == [("Books", 20, "B"), ("Books", 15, "A"), ("Electronics", 200, "TV"), ("Electronics", 100, "Cable"), ("Electronics", 100, "Mouse")]
    with pytest.raises(errors.ConstraintError):
        R.sort(df)


def test_limit(spark):
    df = R.sort(spark.range(10), "id")
    take = lambda n, m=0: [r.id for r in R.limit(df, n, m).collect()]
    assert (take(3), take(3, 8), take(0), take(5, 10), take(99), take(None, 7)) == ([0, 1, 2], [8, 9], [], [], list(range(10)), [7, 8, 9])
    assert [take(4, at) for at in (0, 4, 8)] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]
    for bad in (-1, "x", True, 1.5):
        with pytest.raises(errors.ConstraintError):
            R.limit(df, bad)


def test_filter_and_projection(spark, emp):
    assert rows(R.where(emp, fb.all_of(fb.column_gt("dept_id", 5), fb.column_not_equals("emp_name", "Bob"))).select("emp_id")) == [(1,), (3,)]
    assert rows(R.where(emp, fb.null())) == []
    assert R.project(emp, [2, 0, 0]).columns == ["dept_id", "emp_id", "emp_id"]
    with pytest.raises(errors.ColumnOutOfBounds):
        R.project(emp, [3])
    with pytest.raises(errors.ColumnOutOfBounds):
        R.project(emp, ["nope"])
    with pytest.raises(errors.TypeMismatch):
        R.where(emp, col("dept_id") + 1)
    assert rows(R.where(emp, fb.column_starts_with("emp_name", "A") | fb.column_ends_with("emp_name", "b")).select("emp_id")) == [(1,), (2,)]
    assert "PushedFilters" not in R.explain(emp) and R.explain(emp)


def value(spark, e):
    return spark.range(1).select(e.column(T.StructType()).alias("v")).first().v


def test_expressions(spark):
    for e, want in (
        (lit(10) + 5, 15), (lit(10) - 5, 5), (lit(4) * 3, 12), (lit(10) / 3, 3), (lit(-10) / 3, -3), (lit(-7) % 3, -1), (-lit(5), -5), (+lit(5), 5), (lit(None) + 5, None), (lit(None).eq(5), None),
        (lit(False) & lit(None), False), (lit(True) & lit(None), None), (lit(True) | lit(None), True), (lit(None).is_null(), True), (lit(1).is_not_null(), True), (lit("Hello").concat(" World"), "Hello World"), (lit("a").concat(None), None),
        (lit(2147483647) + 1, -2147483648), (lit(-2147483648) - 1, 2147483647), (-lit(-2147483648), -2147483648), (lit(-2147483648) / -1, -2147483648), (lit(3).isin(1, 3), True), (lit(3).isin(1, None), None), (lit(3).between(1, 3), True),
        (lit("50%").like("%!%", "!"), True), (E.Case(((lit(None), lit(1)), (lit(True), lit(2)))), 2), (E.Call("coalesce", (lit(None), lit("x"))), "x"), (~lit(None), None), (lit(5).cast(T.StringType()), "5"), (lit(None) / 0, None),
    ):
        assert value(spark, e) == want, e
    assert (lit(1) + 2).is_constant() and not (col("a") + 1).is_constant()


def test_strict_types():
    schema = T.StructType.fromDDL("i int, s string, b boolean, l bigint")
    for bad in (col("i") + "5", col("i").eq("1"), col("s") + "a", col("b") + col("b"), ~col("i"), -col("s"), col("i") & col("b"), col("i").concat(col("s")), col("i").isin("a"), col("i").like("x"), col("i").lt(col("l")), E.Case(((col("b"), lit(1)),), lit("x"))):
        with pytest.raises(errors.TypeMismatch):
            bad.type(schema)
    with pytest.raises(errors.DivisionByZero):
        (lit(10) / 0).type(schema)
    with pytest.raises(errors.UnknownFunction):
        E.Call("nope", (lit(1),)).type(schema)
    with pytest.raises(errors.FunctionArgumentCount):
        E.Call("upper", ()).type(schema)
    with pytest.raises(errors.ColumnOutOfBounds):
        col(9).type(schema)
    assert E.check_projection([col(0) + 1, col("s"), lit(None)], schema) == [T.IntegerType(), T.StringType(), None]


INTS = st.integers(-(1 << 31), (1 << 31) - 1) | st.sampled_from([-(1 << 31), (1 << 31) - 1, 0, 1, -1])


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(INTS, INTS), min_size=1, max_size=30))
def test_wrapping_against_a_model(spark, pairs):
    wrap = lambda x: (x + (1 << 31)) % (1 << 32) - (1 << 31)
    div = lambda a, b: abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a int, b int")
    got = R.project(df, ["i", col("a") + col("b"), col("a") - col("b"), col("a") * col("b"), E.Case(((col("b").ne(0), col("a") / col("b")),)), E.Case(((col("b").ne(0), col("a") % col("b")),))], list("ipmtdr"))
    want = [(i, wrap(a + b), wrap(a - b), wrap(a * b), wrap(div(a, b)) if b else None, a - b * div(a, b) if b else None) for i, (a, b) in enumerate(pairs)]
    assert rows(got) == sorted(want, key=repr)


def test_index_lookups(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3, str(i)) for i in range(20)] + [(None, 0, "none")], "k int, m int, v string")
    ix.build(df, ["k", "m"], f"{tmp_path}/i", 4)
    copy = spark.read.parquet(f"{tmp_path}/i")
    ids = lambda x: [r.k for r in x.collect()]
    assert ids(ix.exact(copy, ["k", "m"], [7, 1])) == [7] and ids(ix.exact(copy, ["k", "m"], [7, 2])) == [] and ids(ix.exact(copy, ["k", "m"], [None, 0])) == [None]
    assert ids(ix.range_(copy, ["k", "m"], [5], [15], descending=False)) == list(range(5, 15))
    assert ids(ix.range_(copy, ["k", "m"], None, [10], include_end=True, descending=False)) == [None, *range(11)]
    assert ids(ix.range_(copy, ["k", "m"], [5], [8], include_start=False, include_end=True, descending=True)) == [8, 7, 6]
    assert ids(ix.range_(copy, ["k", "m"], [5, 2], [7, 1], include_start=False, include_end=True, descending=False)) == [6, 7]
    assert len(ids(ix.range_(copy, ["k", "m"]))) == 21
    assert "GreaterThanOrEqual(k,5)" in R.explain(ix.range_(copy, ["k"], [5], [15]))
    for bad in ([], [1, 2, 3]):
        with pytest.raises(errors.ConstraintError):
            ix.prefix(copy, ["k", "m"], bad)


def test_types():
    assert [parse_type(t).simpleString() for t in ("INT", "smallint", "BIGINT", "VARCHAR(20)", "char(3)", "TEXT", "DECIMAL(8, 2)", "double precision", "TIMESTAMP")] == ["int", "int", "bigint", "string", "string", "string", "decimal(8,2)", "double", "timestamp_ntz"]
    for bad in ("BLOB", "INT(3)", ""):
        with pytest.raises(errors.SqlError):
            parse_type(bad)
