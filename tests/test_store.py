"""Tables that change, their catalog, SQL statements and transactions."""

from __future__ import annotations

import threading

import pytest

from quillon import errors
from quillon.functions.expressions import col, lit
from quillon.plans.sql import Engine
from quillon.sources.store import Database


@pytest.fixture
def engine(spark, tmp_path):
    return Engine.create(spark, f"{tmp_path}/my db")


@pytest.fixture
def users(engine):
    engine.execute("CREATE TABLE users (id INT PRIMARY KEY, name VARCHAR(20) NOT NULL, age INT, active BOOLEAN, UNIQUE (name))")
    engine.execute("INSERT INTO users VALUES (1, 'Ann', 30, TRUE), (2, 'Bob', NULL, FALSE), (3, 'it''s; -- odd', -4, NULL)")
    return engine


def rows(engine, sql="SELECT * FROM users"):
    return sorted(map(tuple, engine.execute(sql).rows.collect()))


def test_create_and_open(spark, tmp_path, engine):
    with pytest.raises(errors.CatalogError):
        Database.create(spark, f"{tmp_path}/my db")
    with pytest.raises(errors.CatalogError):
        Database.open(spark, f"{tmp_path}/nothing")
    with pytest.raises(errors.CatalogError):
        engine.execute("SELECT 1") and engine.session.table("nothing")


def test_insert_select_text(users):
    r = users.execute("SELECT id, name, age, active FROM users WHERE id < 3 ORDER BY id;")
    assert (r.tag, r.text()) == ("SELECT", [["1", "Ann", "30", "t"], ["2", "Bob", None, "f"]])
    assert users.execute("INSERT INTO users (age, id) VALUES (2 * 3, 9)").tag == "INSERT 0 1"
    assert rows(users, "SELECT id, name, age FROM users WHERE id = 9") == [(9, None, 6)]
    assert users.execute("INSERT INTO users SELECT id + 100, name, age, active FROM users").count == 4
    assert users.execute("SELECT count(*) FROM users").text() == [["8"]]


def test_insert_checks_all_rows_first(users):
    for sql, error in (
        ("INSERT INTO users VALUES (5, 'x', 1)", errors.ConstraintError),
        ("INSERT INTO users VALUES (5, 'x', 1, TRUE), (6, 7, 1, TRUE)", errors.TypeMismatch),
        ("INSERT INTO users VALUES ('5', 'x', 1, TRUE)", errors.TypeMismatch),
        ("INSERT INTO users VALUES (3000000000, 'x', 1, TRUE)", errors.ConstraintError),
        ("INSERT INTO users (id, id) VALUES (1, 2)", errors.ConstraintError),
        ("INSERT INTO users (nope) VALUES (1)", errors.ConstraintError),
        ("INSERT INTO nope VALUES (1)", errors.CatalogError),
    ):
        with pytest.raises(error):
            users.execute(sql)
    assert len(rows(users)) == 3


def test_update(users):
    assert users.execute("UPDATE users SET age = age + 1, name = 'X' WHERE age > 0").tag == "UPDATE 1"
    assert rows(users)[0] == (1, "X", 31, True)
    assert users.execute("UPDATE users SET age = NULL").count == 3
    assert users.execute("UPDATE users SET age = 1 WHERE age > 0").count == 0
    assert users.session.update("users", {"age": lit(5), "name": col("name").concat("!")}, col("id").eq(2)) == 1
    assert rows(users)[1] == (2, "Bob!", 5, False)
    for sql, error in (("UPDATE users SET nope = 1", errors.ConstraintError), ("UPDATE users SET age = 'x'", errors.TypeMismatch), ("UPDATE users SET age = 1 WHERE age", errors.SqlError), ("UPDATE users SET age = 1 2", Exception)):
        with pytest.raises(error):
            users.execute(sql)


def test_delete(users):
    assert users.execute("DELETE FROM users WHERE age > 0 OR age < 0").tag == "DELETE 2"
    assert [r[0] for r in rows(users)] == [2]
    assert users.execute("DELETE FROM users").count == 1 and rows(users) == []
    assert users.execute("DELETE FROM users").count == 0


def test_only_files_with_hits_are_rewritten(users):
    users.execute("INSERT INTO users VALUES (50, 'z', 1, TRUE)")
    before = users.session.table_info("users").files
    users.execute("UPDATE users SET age = 2 WHERE id = 50")
    after = users.session.table_info("users").files
    assert len(set(before) & set(after)) == len(before) - 1


def test_catalog(users):
    users.execute("CREATE INDEX by_age ON users (age, id)")
    assert users.session.list_tables() == ["pg_tables", "pg_attribute", "pg_index", "users"]
    assert rows(users, "SELECT table_id, table_name FROM pg_tables WHERE table_id > 3") == [(4, "users")]
    assert rows(users, "SELECT column_name, column_type, column_order FROM pg_attribute WHERE table_id = 4") == [("active", "boolean", 4), ("age", "int", 3), ("id", "int", 1), ("name", "string", 2)]
    assert rows(users, "SELECT index_name, table_id, key_column_names, is_unique FROM pg_index") == [("by_age", 4, "age,id", False)]
    for sql in ("CREATE TABLE users (a INT)", "CREATE INDEX by_age ON users (id)", "DROP TABLE nope", "DROP INDEX nope"):
        with pytest.raises(errors.CatalogError):
            users.execute(sql)
    for sql in ("CREATE TABLE t (a INT, A INT)", "CREATE TABLE t (a INT, PRIMARY KEY (b))", "CREATE INDEX i ON users (nope)"):
        with pytest.raises(errors.ConstraintError):
            users.execute(sql)
    for sql in ("DROP TABLE IF EXISTS nope", "DROP INDEX IF EXISTS nope", "DROP INDEX by_age", "DROP TABLE users"):
        users.execute(sql)
    assert users.session.list_tables() == ["pg_tables", "pg_attribute", "pg_index"]


def test_index_follows_changes(users):
    users.execute("CREATE UNIQUE INDEX by_name ON users (name)")
    assert [r.id for r in users.session.lookup("by_name", ["Ann"]).collect()] == [1]
    users.execute("UPDATE users SET name = 'Cy' WHERE id = 1")
    assert users.session.lookup("by_name", ["Ann"]).count() == 0 and users.session.lookup("by_name", ["Cy"]).count() == 1
    assert users.session.lookup_range("by_name", ["B"], ["D"]).count() == 2
    with pytest.raises(errors.ConstraintError):
        users.execute("INSERT INTO users VALUES (7, 'Bob', 1, TRUE)")


def test_transaction_statements(users):
    for s in ("BEGIN", "INSERT INTO users VALUES (7, 'G', 1, TRUE)", "DELETE FROM users WHERE id = 1"):
        users.execute(s)
    assert [r[0] for r in rows(users)] == [2, 3, 7]
    with pytest.raises(errors.TransactionError):
        users.execute("BEGIN TRANSACTION")
    users.execute("ROLLBACK")
    assert [r[0] for r in rows(users)] == [1, 2, 3]
    for s in ("COMMIT", "ROLLBACK WORK"):
        with pytest.raises(errors.TransactionError):
            users.execute(s)
    with pytest.raises(RuntimeError), users.session as s:
        s.delete("users")
        raise RuntimeError
    assert len(rows(users)) == 3


def test_isolation(users):
    db = users.session.db
    fixed, loose, other = db.session(), db.session("read committed"), db.session()
    fixed.begin()
    loose.begin()
    assert fixed.table("users").count() == loose.table("users").count() == 3
    other.delete("users", "id = 1")
    assert (fixed.table("users").count(), loose.table("users").count()) == (3, 2)
    fixed.update("users", {"age": 1}, "id = 2")
    with pytest.raises(errors.ConflictError):
        fixed.commit()
    loose.commit()
    strict = db.session("serializable")
    strict.begin()
    strict.table("users").count()
    strict.create_table("t", "a int")
    other.delete("users", "id = 2")
    with pytest.raises(errors.ConflictError):
        strict.commit()
    with pytest.raises(errors.TransactionError):
        db.session("chaos")


def test_concurrent_commits_all_count(users):
    db = users.session.db
    for i in range(3):
        users.execute(f"CREATE TABLE t{i} (a INT)")
    work = [threading.Thread(target=lambda i=i: db.session().insert(f"t{i}", [(i,)])) for i in range(3)]
    for w in work:
        w.start()
    for w in work:
        w.join()
    assert all(rows(users, f"SELECT * FROM t{i}") == [(i,)] for i in range(3))


def test_old_versions_and_vacuum(users):
    db = users.session.db
    version = db.state().version
    users.execute("DELETE FROM users")
    assert len(db.state(version).tables["users"].files) > 0
    assert db.vacuum() >= 1 and rows(users) == []


def test_statements_that_fail(users):
    for sql in ("", ";", "SELECT 1; SELECT 2", "GRANT x", "DELETE FROM users WHERE", "DELETE users", "DROP DATABASE x", "INSERT INTO users VALUES (1", "UPDATE users SET age", "CREATE UNIQUE TABLE t (a INT)", "CREATE TABLE t (a BLOBBY)"):
        with pytest.raises(errors.SqlError):
            users.execute(sql)
    with pytest.raises(Exception, match="nope"):
        users.execute("SELECT nope FROM users")


def test_queries_with_arguments_quotes_and_plans(users):
    assert users.execute("SELECT name FROM users WHERE id = :id", {"id": 2}).text() == [["Bob"]]
    assert users.execute("SELECT name FROM users WHERE id = ?", [1]).text() == [["Ann"]]
    assert users.execute('SELECT "name" FROM "users" WHERE name = \'it\'\'s; -- odd\'').text() == [["it's; -- odd"]]
    assert users.execute("SELECT a.id FROM users a LEFT OUTER JOIN users b ON a.id = b.age WHERE b.id IS NULL ORDER BY 1").text() == [["1"], ["2"], ["3"]]
    assert any("Scan parquet" in r[0] for r in users.execute("EXPLAIN SELECT * FROM users WHERE id = 1").text())


def test_commit_survives_a_writer_that_died(users):
    """What a crash inside a commit leaves (a lock of old, a half-written text) blocks nothing; a version that is taken is never overwritten."""
    files, now = users.session.db.files, users.session.db.state().version
    for name in (f"_log/.lock-{now + 1:020d}.json", f"_log/.{now + 1:020d}.json.dead"):
        files.fs.create(files.path(name), False).close()
    assert users.execute("DELETE FROM users WHERE id = 1").count == 1
    assert users.session.db.state().version == now + 1
    assert not files.put_new(f"_log/{now + 1:020d}.json", "{}")
    assert len(rows(users)) == 2
    assert [n for n in files.names("_log") if n.endswith("-") or ".json." in n and "dead" not in n and "crc" not in n] == []


def test_commits_from_many_threads(spark, users):
    """Each has a table of its own: all succeed, by bounded retries."""
    failed = []

    def work(i):
        try:
            Engine(spark, users.session.db).execute(f"CREATE TABLE t{i} (a INT)")
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=work, args=(i,)) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and {f"t{i}" for i in range(6)} <= set(users.session.list_tables())


def test_views_of_the_caller_stay(spark, users):
    spark.range(5).createOrReplaceTempView("users")
    try:
        assert users.execute("SELECT count(*) FROM users").text() == [["3"]]
        assert users.execute("WITH x AS (SELECT id FROM users) SELECT max(users.id) FROM x JOIN users ON x.id = users.id").text() == [["3"]]
        assert spark.table("users").count() == 5
        assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("v_")]
    finally:
        spark.catalog.dropTempView("users")


def test_read_committed_sees_drops(spark, users):
    reader = Engine(spark, users.session.db, "read committed")
    reader.execute("BEGIN")
    assert reader.execute("SELECT count(*) FROM users").text() == [["3"]]
    users.execute("DROP TABLE users")
    with pytest.raises(Exception, match="users"):
        reader.execute("SELECT count(*) FROM users")


def test_unique_index_on_update_and_insert(users):
    users.execute("CREATE UNIQUE INDEX u ON users (age)")
    for sql in ("UPDATE users SET age = 1", "UPDATE users SET age = 30 WHERE id = 3", "INSERT INTO users VALUES (7, 'g', 30, TRUE)", "INSERT INTO users VALUES (7, 'g', 8, TRUE), (8, 'h', 8, TRUE)"):
        with pytest.raises(errors.ConstraintError):
            users.execute(sql)
    assert users.execute("UPDATE users SET name = 'same'").count == 3
    assert users.execute("UPDATE users SET age = age + 1").count == 3
    assert users.execute("INSERT INTO users VALUES (7, 'g', NULL, TRUE), (8, 'h', NULL, TRUE)").count == 2


def test_integers_in_sql(engine):
    engine.execute("CREATE TABLE t (a INT, b INT, c BIGINT, d DOUBLE)")
    engine.execute("INSERT INTO t VALUES (7, -2, 9, 5.0), (2147483647 + 1, 3 / 2, -7, 1.0)")
    assert rows(engine, "SELECT a, b FROM t") == [(-(1 << 31), 1), (7, -2)]
    assert rows(engine, "SELECT a FROM t WHERE a / 2 = 3") == [(7,)]
    assert rows(engine, "SELECT a / b, c / 2, d / 2, (a + 1) * (b - 1) / 5, a - b - 1, -a / b * 2 FROM t WHERE a = 7") == [(-3, 4, 2.5, -4, 8, 6)]
    assert engine.execute("SELECT a / 2, a /* x / y */ + 1 AS n FROM t").rows.dtypes == [("(a / 2)", "int"), ("n", "int")]
    assert rows(engine, "SELECT CASE WHEN a / 2 > 0 THEN a * 1000000000 ELSE a - 1 END FROM t") == [(-1589934592,), (2147483647,)]
    assert rows(engine, "SELECT sum(a / 2), count(*) FROM t WHERE EXISTS (SELECT 1 FROM t u WHERE u.a / 2 = 3) AND a IN (SELECT a * 1 FROM t)") == [(3 - (1 << 30), 2)]
    assert engine.execute("UPDATE t SET b = a + 2147483647 WHERE a / 2 = 3").count == 1
    assert rows(engine, "SELECT b FROM t WHERE a = 7") == [(-2147483642,)]
    with pytest.raises(Exception, match="(?i)zero"):
        engine.execute("SELECT a / 0 FROM t").rows.collect()


def test_parameters_in_every_statement(engine):
    engine.execute("CREATE TABLE t (a INT, s TEXT)")
    insert = engine.prepare("INSERT INTO t VALUES (?, ?)")
    for a, s in ((1, "it's"), (None, None), (3, "back\\slash ? :x")):
        assert insert.execute([a, s]).count == 1
    assert rows(engine, "SELECT s FROM t WHERE a = 3") == [("back\\slash ? :x",)]
    assert engine.execute("UPDATE t SET a = :n WHERE s = :s", {"n": 9, "s": "it's"}).count == 1
    assert engine.execute("SELECT a FROM t WHERE s = ?", ["it's"]).text() == [["9"]]
    assert engine.execute("DELETE FROM t WHERE a = ?", [9]).count == 1
    for sql, args in (("SELECT ?", [1, 2]), ("SELECT ?, ?", [1]), ("SELECT :a", {"b": 1}), ("SELECT ?", [object()])):
        with pytest.raises(errors.SqlError):
            engine.execute(sql, args)


def test_many_rows_of_values(engine):
    engine.execute("CREATE TABLE t (a INT, s TEXT, b BOOLEAN)")
    assert engine.execute("INSERT INTO t VALUES " + ", ".join(f"({i}, 'x''{i}', {'TRUE' if i % 2 else 'NULL'})" for i in range(3000))).count == 3000
    assert engine.execute("SELECT count(*), sum(a), count(b), min(s) FROM t").text() == [["3000", "4498500", "1500", "x'0"]]


def test_cursor_and_addresses(users):
    users.execute("CREATE INDEX by_age ON users (age)")
    c = users.session.cursor("by_age")
    assert [r.age for r in c.advance(2)] == [None, -4] and [r.age for r in c.advance(5)] == [30] and c.advance() == []
    assert [r.age for r in c.back(2)] == [-4, None] and c.seek([0]).age == 30 and c.seek([31]) is None
    at = users.session.addressed("users").where("id = 2").first()
    assert [r.name for r in users.session.fetch("users", at.row_file, at.row_index).collect()] == ["Bob"]
    users.execute("DELETE FROM users WHERE id = 2")
    assert users.session.fetch("users", at.row_file, at.row_index).count() == 0
    with pytest.raises(errors.ConflictError):
        c.advance()


def test_index_work_is_that_of_the_change(users, monkeypatch):
    from quillon.sources import store

    users.execute("CREATE INDEX by_age ON users (age, id)")

    def runs():
        return users.session.table_info("users").indexes["by_age"].runs

    def held():
        """What the index gives is what the table has."""
        by_index = sorted(map(str, users.session.index("by_age")[0].collect()))
        assert by_index == sorted(map(str, users.session.table("users").collect()))

    first = set(runs())
    assert len(first) == 1
    users.execute("INSERT INTO users VALUES (4, 'Dan', 30, TRUE)")
    assert first < set(runs()) and len(runs()) == 2
    held()
    users.execute("UPDATE users SET age = 31 WHERE id = 4")
    assert first < set(runs()) and len(runs()) == 2  # the copy of the file that went is dropped
    held()
    users.execute("DELETE FROM users WHERE id = 2")
    held()
    monkeypatch.setattr(store, "MOST_RUNS", 3)
    for k in range(10, 15):
        users.execute(f"INSERT INTO users VALUES ({k}, 'x', {k}, NULL)")
        assert len(runs()) <= 3
        held()
    users.execute("BEGIN")
    users.execute("DELETE FROM users WHERE age > 11")
    held()
    users.execute("ROLLBACK")
    held()
    users.execute("DELETE FROM users")
    assert runs() == {}
    held()


def test_queries_read_by_an_index(users):
    users.execute("INSERT INTO users SELECT id + 10, name, age, active FROM users")
    users.execute("CREATE INDEX by_age ON users (age, id)")
    users.execute("CREATE INDEX by_name ON users (name)")

    def through(sql, args=None):
        rows_ = users.execute(sql, args).rows
        kinds = {"by_age" if "/index/by_age/" in f else "by_name" if "/index/by_name/" in f else "table" for f in rows_.inputFiles()}
        return kinds, sorted(r[0] for r in rows_.collect())

    assert through("SELECT id FROM users") == ({"table"}, [1, 2, 3, 11, 12, 13])
    assert through("SELECT id FROM users WHERE id = 1") == ({"table"}, [1])
    assert through("SELECT id FROM users WHERE age = 30") == ({"by_age"}, [1, 11])
    assert through("SELECT u.id FROM users u WHERE 0 < u.AGE AND u.id = 11") == ({"by_age"}, [11])
    assert through("SELECT id FROM users WHERE age = -4 OR name = 'Bob'")[1] == [2, 3, 12, 13]
    assert through('SELECT id FROM users WHERE "name" = ?', ["Ann"]) == ({"by_name"}, [1, 11])
    assert through("SELECT a.id FROM users a JOIN users b ON a.id = b.id WHERE a.age BETWEEN 0 AND 40")[1] == [1, 11]
    users.execute("UPDATE users SET age = 5 WHERE id = 11")
    assert through("SELECT id FROM users WHERE age IN (5, 30)") == ({"by_age"}, [1, 11])


def test_row_addresses_of_odd_names(engine):
    engine.session.create_table("ü t", "a int")
    engine.session.insert("ü t", [(1,), (2,)])
    engine.session.create_index("i", "ü t", ["a"])
    at = engine.session.addressed("ü t").where("a = 2").first()
    assert [r.a for r in engine.session.fetch("ü t", at.row_file, at.row_index).collect()] == [2]
    engine.session.delete("ü t", "a = 1")
    assert [r.a for r in engine.session.lookup_range("i", [0]).collect()] == [2]
