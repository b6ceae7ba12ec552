import random

import pytest
from pyspark.sql import functions as F

from gridsift.model import ROW, Condition, SearchQuery
from gridsift.operators.search import limited, search, search_stats, search_table, spans, value_counts, with_context


def test_limits_stop_early(spark, tmp_path):
    """Of a scan in order only the first blocks are read."""
    spark.range(200_000).selectExpr("id AS _row_idx", "id % 50 AS k", "md5(cast(id AS string)) AS t").coalesce(1).write.option("parquet.block.size", 65536).parquet(str(tmp_path / "t"))
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        df = spark.read.parquet(str(tmp_path / "t"))
        assert df.rdd.getNumPartitions() > 10
        query = SearchQuery("7", column="k", mode="exact", limit=40)
        want = search([("f", "s", df)], query).collect()
        store = spark._jsparkSession.sharedState().statusStore()
        before = store.executionsCount()
        got = search([("f", "s", df)], query, in_order=True)
        rows = 0
        for i in range(before, store.executionsCount()):
            e = store.executionsList().apply(i)
            metrics, nodes = store.executionMetrics(e.executionId()), store.planGraph(e.executionId()).allNodes()
            for n in range(nodes.size()):
                if "Scan parquet" in nodes.apply(n).name():
                    for m in range(nodes.apply(n).metrics().size()):
                        x = nodes.apply(n).metrics().apply(m)
                        if x.name() == "number of output rows":
                            rows += int(metrics.get(x.accumulatorId()).get().replace(",", ""))
        assert got.collect() == want and len(want) == 40 and 0 < rows < 50_000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def made(spark, rows, names=("a", "b")):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"{ROW} long, " + ", ".join(f"`{n}` string" for n in names))


def found(df, **q):
    return sorted(r[ROW] for r in search_table(df, SearchQuery(**q)).collect())


def test_modes(spark):
    df = made(spark, [("Apple", "1"), ("apple pie", "2"), ("100%", "x_y"), ("Éclair", None), ("a\nb", "")])
    assert found(df, text="APPLE") == [0, 1]
    assert found(df, text="%") == [2]
    assert found(df, text="apple", mode="exact") == []
    assert found(df, text="apple%", mode="wildcard") == [0, 1]
    assert found(df, text="_pple", mode="wildcard") == [0]
    assert found(df, text="a%b", mode="wildcard") == [4]
    assert found(df, text="^é", mode="regex") == [3]
    with pytest.raises(ValueError):
        search_table(df, SearchQuery("(", mode="regex"))
    with pytest.raises(ValueError):
        SearchQuery("x", mode="fuzzy")


def test_invert_and_conditions(spark):
    df = made(spark, [("x", "99"), ("y", "150"), ("x", "abc"), ("y", None)])
    assert found(df, text="x", invert=True) == [1, 3]
    assert found(df, text="x", column="a", invert=True, conditions=(Condition("b", ">", "100"),)) == [1]
    assert found(df, text="", conditions=(Condition("b", ">", "100"),)) == [1, 2]
    assert found(df, text="", conditions=(Condition("none", "=", ""),)) == []
    assert found(df, text="x", column="none") == []
    assert found(df, text="x", column="none", invert=True) == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        Condition("b", "~", "1")


def test_types_that_cannot_match_are_not_read(spark):
    df = spark.range(30).selectExpr(f"id AS {ROW}", "id AS n", "id % 2 = 0 AS even", "id / 4 AS q", "'x' AS s")
    plan = search_table(df, SearchQuery("x7"))._jdf.queryExecution().optimizedPlan().toString()
    assert "cast(n" not in plan and "cast(id" not in plan
    assert found(df, text="RUE") == list(range(0, 30, 2)) and found(df, text="29") == [29] and found(df, text="7.25") == [29]


def test_context_limit_stats_and_spans(spark):
    df = made(spark, [(c, str(i)) for i, c in enumerate("abcadaa")])
    out = {r[ROW]: r for r in with_context(df, search_table(df, SearchQuery("c")), 2).collect()}
    assert [[x["a"] for x in out[2][side]] for side in ("before", "after")] == [["a", "b"], ["a", "d"]]
    first, more = limited(search_table(df, SearchQuery("a")), 4)
    assert first.count() == 4 and not more
    assert limited(search_table(df, SearchQuery("a")), 3)[1]
    both = [("f", "s", df), ("f", "t", df)]
    assert [(r.sheet, r.rows_searched, r.matches) for r in search_stats(both, SearchQuery("d", sheet="t")).collect()] == [("t", 7, 1)]
    assert search(both, SearchQuery("d", context_lines=1)).count() == 2
    assert [(r.value, r.n) for r in value_counts(df, "a").collect()] == [("a", 4), ("b", 1), ("c", 1), ("d", 1)]
    assert spark.range(1).select(spans(F.lit("aXa"), SearchQuery("A")).alias("s")).first().s == ["a", "a"]


def test_against_a_plain_model(spark):
    r = random.Random(7)
    cells = ["", "a", "A", "ab", "10", "9", "1e1", "é", "É", None, "a%b", "12d"]
    rows = [tuple(r.choice(cells) for _ in range(3)) for _ in range(200)]
    df = made(spark, rows, ("p", "q", "r"))
    number = lambda s: float(s) if s in ("10", "9", "1e1") else None
    for text in ("a", "É", "1", "%"):
        for invert in (False, True):
            for bound in (None, "9.5", "a"):
                conditions = () if bound is None else (Condition("r", ">", bound),)
                want = []
                for i, row in enumerate(rows):
                    vals = [x or "" for x in row]
                    ok = any(text.lower() in v.lower() for v in vals) != invert
                    if bound is not None:
                        x, y = number(vals[2]), float(bound) if bound == "9.5" else None
                        ok = ok and (x > y if x is not None and y is not None else vals[2] > bound)
                    if ok:
                        want.append(i)
                assert found(df, text=text, invert=invert, conditions=conditions) == want


def test_limits_take_the_first_rows(spark):
    df = made(spark, [(c, str(i)) for i, c in enumerate("abcadaabca" * 30)]).repartition(7, "b")
    wanted = [i for i, c in enumerate("abcadaabca" * 30) if c == "a"]
    assert [r[ROW] for r in search_table(df, SearchQuery("a", limit=20)).collect()] == wanted[:20]
    both = search([("z", "s", df), ("f", "t", df)], SearchQuery("a", limit=len(wanted) + 2)).collect()
    assert [(r.file, r.row_index) for r in both] == [("z", i) for i in wanted] + [("f", i) for i in wanted[:2]]
    first, more = limited(search([("z", "s", df)], SearchQuery("a")), 5)
    assert [r.row_index for r in first.collect()] == wanted[:5] and more
