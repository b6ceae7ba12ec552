import random
import re

import pytest

from gridsift.plans.dialect import rewritten, strftime_pattern
from gridsift.plans.gate import check_read_only, run_sql


@pytest.mark.parametrize("sql", ["SELECT 1", "WITH a AS (SELECT 1) SELECT * FROM a", "SHOW TABLES", "DESCRIBE SELECT 1", "EXPLAIN SELECT 1", "SELECT 'drop table x; insert'", "SELECT 1 AS `update`"])
def test_reading_is_allowed(spark, sql):
    check_read_only(spark, sql)


@pytest.mark.parametrize("sql", ["", "DROP TABLE x", "INSERT INTO x VALUES (1)", "WITH a AS (SELECT 1) INSERT INTO x SELECT * FROM a", "FROM y INSERT INTO x SELECT *", "CREATE TABLE x AS SELECT 1", "SET a = 1", "CACHE TABLE x", "ADD JAR 'x'", "DELETE FROM x", "UPDATE x SET a = 1", "SELECT 1; SELECT 2", "TRUNCATE TABLE x", "EXPLAIN INSERT INTO x VALUES (1)"])
def test_changing_is_refused(spark, sql):
    with pytest.raises(ValueError):
        check_read_only(spark, sql)


def test_rewrites():
    assert rewritten("SELECT 部门 FROM t") == "SELECT `部门` FROM t"
    assert rewritten("SELECT '部门', \"部\" FROM t;") == "SELECT '部门', \"部\" FROM t"
    assert rewritten("SELECT * FROM a.b", {"a.b": "a.b"}) == "SELECT * FROM `a.b`"
    assert "max_by(x, y)" in rewritten("SELECT arg_max(x, y) FROM t")
    assert rewritten("SELECT [1, 2][0], a[1] FROM t") == "SELECT array(1, 2)[0], a[1] FROM t"
    assert strftime_pattern("%Y-%m-%dT%H") == "yyyy-MM-dd'T'HH"
    for sql in ("SELECT * FROM a ASOF JOIN b ON a.t >= b.t", "SELECT * FROM a POSITIONAL JOIN b"):
        with pytest.raises(ValueError):
            rewritten(sql)


def test_statements(spark):
    spark.range(6).selectExpr("id", "id % 2 AS k").createOrReplaceTempView("six")
    assert run_sql(spark, "SUMMARIZE six").count() == 2
    assert sorted(map(tuple, run_sql(spark, "PIVOT (SELECT k FROM six) ON k USING count(*)").collect())) == [(3, 3)]
    # Without GROUP BY, all columns that the statement does not use make the groups; without USING, rows are counted.
    assert sorted(map(tuple, run_sql(spark, "PIVOT six ON k").collect())) == [(i, 1 - i % 2, i % 2) for i in range(6)]
    assert run_sql(spark, "UNPIVOT six ON id, k INTO NAME n VALUE v").count() == 12
    assert [r.id for r in run_sql(spark, "SELECT * FROM six QUALIFY row_number() OVER (PARTITION BY k ORDER BY id DESC) = 1 ORDER BY id").collect()] == [4, 5]
    assert run_sql(spark, "SELECT * FROM six ORDER BY id LIMIT 5", 3).count() == 3
    assert run_sql(spark, "FROM six").count() == 6


def test_the_gate_lets_no_code_or_path_through(spark):
    spark.range(3).createOrReplaceTempView("t3")
    for sql in ("SELECT java_method('java.lang.System', 'setProperty', 'jx', 'y')", "SELECT `reflect`('java.lang.Math', 'random')", "SELECT try_reflect('java.lang.Math', 'random')", "SELECT * FROM parquet.`/tmp/x`", "SELECT * FROM `text`.`/etc/passwd`", "EXECUTE IMMEDIATE 'SELECT 1'", "SELECT TRANSFORM(id) USING 'cat' AS (x) FROM t3", "FROM t3 MAP id USING 'cat' AS x", "INSERT INTO t3 VALUES (1)", ""):
        with pytest.raises(ValueError):
            run_sql(spark, sql)
    assert spark._jvm.java.lang.System.getProperty("jx") is None
    assert run_sql(spark, "SELECT 'reflect(1)' AS a, id FROM t3 -- java_method(").count() == 3


def test_the_gate_looks_at_what_names_mean(spark, tmp_path):
    """Names made of text, classes of formats, paths, code in the expressions of PIVOT, and tables that are no views."""
    spark.range(3).selectExpr("id", "id % 2 AS k", "'x' AS reflected").createOrReplaceTempView("t4")
    (tmp_path / "secret").write_text("s")
    path = f"{tmp_path}/secret"
    formats = "org.apache.spark.sql.execution.datasources"
    for sql in (
        "SELECT IDENTIFIER('java_method')('java.lang.System', 'setProperty', 'jx2', 'y')",
        "SELECT id FROM t4 WHERE IDENTIFIER('ref' || 'lect')('java.lang.System', 'setProperty', 'jx2', 'y') = 'z'",
        f"SELECT * FROM IDENTIFIER('text.`{path}`')",
        f"SELECT * FROM `{formats}.text.TextFileFormat`.`{path}`",
        f"SELECT * FROM `{formats}.v2.text.TextDataSourceV2`.`{path}`",
        f"SELECT * FROM t4 WHERE EXISTS (SELECT 1 FROM `{formats}.text.TextFileFormat`.`{path}`)",
        f"WITH a AS (SELECT * FROM IDENTIFIER('text.`{path}`')) SELECT count(*) FROM a, t4",
        "PIVOT t4 ON k USING first(java_method('java.lang.System', 'setProperty', 'jx2', 'y'))",
        "PIVOT t4 ON k USING first(IDENTIFIER('java_method')('java.lang.System', 'setProperty', 'jx2', 'y')) GROUP BY id",
        f"PIVOT IDENTIFIER('text.`{path}`') ON value USING count(*)",
        f"SUMMARIZE IDENTIFIER('text.`{path}`')",
    ):
        with pytest.raises(ValueError):
            run_sql(spark, sql).collect()
    assert spark._jvm.java.lang.System.getProperty("jx2") is None
    spark.sql("CREATE TABLE IF NOT EXISTS stored_t4 USING parquet AS SELECT 1 AS a")
    with pytest.raises(ValueError):
        run_sql(spark, "SELECT * FROM stored_t4")
    spark.sql("DROP TABLE stored_t4")
    assert run_sql(spark, "SELECT reflected, IDENTIFIER('id') AS i FROM IDENTIFIER('t4') JOIN range(2) r USING (id)").count() == 2
    assert run_sql(spark, "WITH RECURSIVE n(x) AS (SELECT 1 UNION ALL SELECT x + 1 FROM n WHERE x < 5) SELECT x FROM n").count() == 5
    assert run_sql(spark, "SHOW COLUMNS IN t4").count() == 3 and run_sql(spark, "DESCRIBE t4").count() == 3


def test_pivot_on_several_columns(spark):
    spark.createDataFrame([(1, "a", 1, 5), (1, "a", 2, 6), (2, "b", 1, 7), (2, None, 1, 8), (2, "b", None, 9)], "g int, s string, n int, v int").createOrReplaceTempView("p4")
    got = run_sql(spark, "PIVOT p4 ON s, n USING sum(v) GROUP BY g")
    assert got.columns == ["g", "a_1", "a_2", "b_1", "b_2"] and sorted(map(tuple, got.collect())) == [(1, 5, 6, None, None), (2, None, None, 7, None)]
    got = run_sql(spark, "PIVOT p4 ON s IN ('b', 'zz'), n IN (1) USING count(*) AS c, max(v) AS m GROUP BY g")
    assert got.columns == ["g", "b_1_c", "b_1_m", "zz_1_c", "zz_1_m"] and sorted(map(tuple, got.collect())) == [(1, 0, None, 0, None), (2, 1, 7, 0, None)]
    assert run_sql(spark, "PIVOT p4 ON n + 1 USING max(v) GROUP BY g").columns == ["g", "2", "3"]


def test_asof_and_positional_joins_in_text(spark):
    duckdb = pytest.importorskip("duckdb")
    r = random.Random(8)
    left = [(i, r.choice(["x", "y", None]), r.randrange(20)) for i in range(40)]
    right = [(100 + i, r.choice(["x", "y", None]), t) for i, t in enumerate(r.sample(range(20), 15))]
    con = duckdb.connect()
    for name, rows in (("la", left), ("ra", right)):
        spark.createDataFrame(rows, f"{name}_id int, k string, t int").createOrReplaceTempView(name)
        con.execute(f"CREATE TABLE {name} ({name}_id INT, k VARCHAR, t INT)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?, ?)", rows)
    texts = [f"SELECT la_id, ra_id, ra.t FROM la ASOF {kind} JOIN ra ON la.k = ra.k AND la.t {op} ra.t" for kind in ("", "LEFT", "INNER") for op in (">=", ">", "<=", "<")]
    texts += [
        "SELECT * FROM la ASOF JOIN ra USING (k, t)",
        "SELECT l.la_id, z.ra_id FROM la AS l ASOF JOIN ra z ON l.t >= z.t WHERE z.k = 'x' ORDER BY 1",
        "SELECT count(*) AS n, max(m.ra_id) AS m FROM la ASOF LEFT JOIN (SELECT ra_id, k AS q, t + 1 AS u FROM ra) m ON q = k AND u <= t GROUP BY la.k",
        "WITH j AS (SELECT a.la_id, b.ra_id FROM la a JOIN la c ON a.la_id = c.la_id ASOF JOIN ra b ON c.k = b.k AND a.t >= b.t) SELECT j.la_id, ra.ra_id, ra.t FROM j JOIN ra ON j.ra_id = ra.ra_id",
        "SELECT la.la_id, x.ra_id, o.ra_id AS o_id FROM la ASOF JOIN ra x ON la.k = x.k AND la.t >= x.t JOIN ra o ON o.ra_id = x.ra_id",
        "SELECT a.la_id, b.ra_id FROM (SELECT la_id FROM la ORDER BY la_id DESC) a POSITIONAL JOIN (SELECT ra_id FROM ra ORDER BY ra_id) b",
    ]
    for sql in texts:
        want = con.execute(sql).fetchall()
        got = run_sql(spark, sql)
        assert [c.lower() for c in got.columns] == [d[0] for d in con.description], sql
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)), sql
    for bad in ("SELECT * FROM la ASOF JOIN ra", "SELECT * FROM la ASOF JOIN ra ON la.k = ra.k", "SELECT * FROM la ASOF JOIN ra ON la.t >= ra.t AND la.la_id >= ra.ra_id", "SELECT * FROM la ASOF JOIN IDENTIFIER('text.`/etc/hostname`') h ON la.k = h.value AND la.k >= h.value"):
        with pytest.raises(ValueError):
            run_sql(spark, bad)


def test_frames_against_another_engine(spark):
    """All units, bounds and exclusions, for all aggregates that are known, over ties and nulls."""
    duckdb = pytest.importorskip("duckdb")
    r = random.Random(6)
    rows = [(i, r.choice("ab"), r.choice([None, 1, 2, 2, 3, 5]), r.choice([None, r.randrange(50), r.randrange(50)])) for i in range(60)]
    spark.createDataFrame(rows, "i int, p string, o int, v int").createOrReplaceTempView("f4")
    con = duckdb.connect()
    con.execute("SET default_null_order = 'nulls_first'")
    con.execute("CREATE TABLE f4 (i INT, p VARCHAR, o INT, v INT)")
    con.executemany("INSERT INTO f4 VALUES (?, ?, ?, ?)", rows)
    bounds = ["BETWEEN 2 PRECEDING AND 1 FOLLOWING", "BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING", "BETWEEN 3 PRECEDING AND 1 PRECEDING", "BETWEEN 1 FOLLOWING AND 2 FOLLOWING", "2 PRECEDING"]
    frames = [f"GROUPS {b}{x}" for b in bounds for x in ("", " EXCLUDE NO OTHERS", " EXCLUDE CURRENT ROW", " EXCLUDE GROUP", " EXCLUDE TIES")]
    frames += [f"RANGE {b}{x}" for b in bounds[1:3] for x in (" EXCLUDE CURRENT ROW", " EXCLUDE GROUP", " EXCLUDE TIES")]
    items = [f"{fn} OVER (PARTITION BY p ORDER BY o {f}) AS c{k}" for k, (f, fn) in enumerate((f, fn) for f in frames for fn in ("count(*)", "sum(v)", "min(v)", "max(v)", "count(v)", "avg(v)"))]
    items += [f"{fn} OVER (PARTITION BY p ORDER BY o, i ROWS {b} EXCLUDE CURRENT ROW) AS r{k}" for k, (b, fn) in enumerate((b, fn) for b in bounds for fn in ("count(*)", "sum(v)", "max(v)"))]
    for n in range(0, len(items), 18):
        sql = f"SELECT i, {', '.join(items[n : n + 18])} FROM f4 t WHERE i < 57 ORDER BY i"
        plain = lambda x: [tuple(None if v is None else round(float(v), 6) for v in row) for row in x]
        assert plain(run_sql(spark, sql).collect()) == plain(con.execute(sql).fetchall()), sql
    assert run_sql(spark, "SELECT *, sum(v) OVER (ORDER BY o GROUPS 1 PRECEDING) AS s FROM f4").columns == ["i", "p", "o", "v", "s"]
    assert run_sql(spark, "SELECT * FROM (SELECT t.i, max(v) OVER (ORDER BY o GROUPS CURRENT ROW) AS s FROM f4 AS t) WHERE s > 3").count() > 3
    for bad in ("SELECT sum(v) OVER (GROUPS 1 PRECEDING) FROM f4", "SELECT first(v) OVER (ORDER BY o GROUPS 1 PRECEDING) FROM f4", "SELECT sum(v) OVER (ORDER BY o RANGE BETWEEN 1 PRECEDING AND CURRENT ROW EXCLUDE TIES) FROM f4", "SELECT sum(a.v) OVER (ORDER BY a.o GROUPS 1 PRECEDING) FROM f4 a JOIN f4 b USING (i)"):
        with pytest.raises(ValueError):
            run_sql(spark, bad)


def test_frames_to_the_end_run_backwards(spark):
    """No frame from a row to the end of its partition, through which Spark would go for each row; rows that an ORDER BY leaves open are in one order for all pieces."""
    duckdb = pytest.importorskip("duckdb")
    r = random.Random(9)
    rows = [(i, r.choice("ab"), r.choice([None, 1, 2, 2, 3, 5]), r.choice([None, r.randrange(50), r.randrange(50)])) for i in range(60)]
    spark.createDataFrame(rows, "i int, p string, o int, v int").repartition(3).createOrReplaceTempView("f5")
    con = duckdb.connect()
    con.execute("CREATE TABLE f5 (i INT, p VARCHAR, o INT, v INT)")
    con.executemany("INSERT INTO f5 VALUES (?, ?, ?, ?)", rows)
    whole, end = "BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING", "BETWEEN 1 PRECEDING AND UNBOUNDED FOLLOWING"
    by = "PARTITION BY p ORDER BY o NULLS FIRST"
    items = [f"{fn}({a}) OVER ({w}) AS {fn}{k}" for k, w in enumerate((f"PARTITION BY p ROWS {whole} EXCLUDE CURRENT ROW", f"ROWS {whole} EXCLUDE CURRENT ROW", f"{by} ROWS {whole} EXCLUDE CURRENT ROW", f"PARTITION BY p ORDER BY o % 2 DESC NULLS FIRST, coalesce(o, 4) ASC NULLS LAST, i ROWS {end} EXCLUDE CURRENT ROW", f"{by} GROUPS {end}", f"{by} GROUPS {end} EXCLUDE CURRENT ROW", f"{by} RANGE {whole} EXCLUDE CURRENT ROW", f"PARTITION BY p RANGE {whole} EXCLUDE CURRENT ROW")) for fn, a in (("sum", "v"), ("count", "*"), ("min", "v"), ("avg", "v"))]
    texts = [f"SELECT i, {', '.join(items[n : n + 8])} FROM f5 WHERE i <> 7" for n in range(0, len(items), 8)]
    # Of joins and groups too, which take no subquery.
    texts += [f"SELECT a.i, sum(b.v) OVER (PARTITION BY a.p ROWS {whole} EXCLUDE CURRENT ROW) AS s FROM f5 a JOIN f5 b ON a.i = b.i", f"SELECT o, sum(count(*)) OVER (ORDER BY o DESC NULLS LAST ROWS {end} EXCLUDE CURRENT ROW) AS s FROM f5 GROUP BY o"]
    plain = lambda x: sorted((tuple(None if v is None else round(float(v), 6) for v in row) for row in x), key=repr)
    for sql in texts:
        got = run_sql(spark, sql)
        assert plain(got.collect()) == plain(con.execute(sql).fetchall()), sql
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "specifiedwindowframe" in plan and not re.search(r"specifiedwindowframe\(\w+, (?!unboundedpreceding)[^,]+, unboundedfollowing", plan), sql


def test_statements_with_brackets(spark):
    spark.createDataFrame([(1, 2, 5), (2, 3, 6), (3, 4, 7)], "a int, b int, c int").createOrReplaceTempView("u3")
    got = run_sql(spark, "UNPIVOT (SELECT a, b FROM u3 WHERE b IN (2, 4)) ON b INTO NAME n VALUE v").collect()
    assert sorted(map(tuple, got)) == [(1, "b", 2), (3, "b", 4)]
    assert {r.column_name: r.n for r in run_sql(spark, "SUMMARIZE SELECT a FROM u3 WHERE b IN (2, 4)").collect()} == {"a": 2}
    assert run_sql(spark, "PIVOT (SELECT a, b FROM u3 WHERE (b) IN (2, (4))) ON b USING max(a), count(*) GROUP BY a").count() == 2
    for bad in ("PIVOT u3 USING max(a)", "UNPIVOT u3 ON b", "SELECT COLUMNS('zz') FROM u3", "SELECT * FROM u3 JOIN u3 x USING (a) USING SAMPLE 2"):
        with pytest.raises(ValueError):
            run_sql(spark, bad)


def test_samples_columns_and_functions(spark):
    spark.range(100).selectExpr("id AS key_a", "id % 7 AS key_b", "'x' AS name").createOrReplaceTempView("s100")
    assert run_sql(spark, "SELECT * FROM s100 USING SAMPLE 7").count() == 7
    assert run_sql(spark, "SELECT count(*) AS n FROM s100 WHERE key_a >= 0 USING SAMPLE reservoir(9 ROWS)").first().n == 9
    assert 0 < run_sql(spark, "SELECT count(*) AS n FROM (SELECT * FROM s100) q USING SAMPLE 50%").first().n < 100
    assert run_sql(spark, "SELECT s100.key_a FROM s100 WHERE s100.key_b = 1 USING SAMPLE 100 PERCENT").count() == 15
    assert run_sql(spark, "SELECT COLUMNS('^key'), max(COLUMNS('key_b')) OVER () AS m FROM s100 WHERE key_a < 3").columns == ["key_a", "key_b", "m"]
    assert run_sql(spark, "SELECT regexp('^x$', name) AS m, regexp_like(name, 'y') AS n FROM s100").first()[:] == (True, False)
    assert run_sql(spark, "SELECT aggregate([1, 2, 3], 0, lambda a, b: a + b) AS s").first().s == 6
