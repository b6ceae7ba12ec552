import random

import pytest

from gridsift.functions.names import check_table_name, column_names, schema_name
from gridsift.model import ROW
from gridsift.operators import inequality, edits, joins, profile
from gridsift.operators.quantiles import exact_quantiles
from gridsift.operators.joins import asof_join, positional_join, range_join


def made(spark, n=10):
    return spark.createDataFrame([(i, f"v{i % 3}", "" if i % 2 else str(i)) for i in range(n)], f"{ROW} long, a string, b string")


def rows(df, *names):
    return [tuple(r[n] for n in (names or df.columns)) for r in df.orderBy(ROW).collect()]


def test_slices_and_samples(spark):
    df = made(spark)
    assert [r[ROW] for r in profile.slice_rows(df, 8, 20).collect()] == [8, 9]
    assert profile.slice_rows(df, 5, 3).count() == 0
    for total in (1, 2, 7, 10, 97):
        for n in (1, 2, 3, 7, 10, 96, 97, 200):
            want = sorted({i * total // n for i in range(n)}) if n < total else list(range(total))
            assert [r[ROW] for r in profile.sample_evenly(spark.range(total).withColumnRenamed("id", ROW), n).collect()] == want, (total, n)


def test_statistics(spark):
    got = {r.column_name: r for r in profile.column_statistics(made(spark)).collect()}
    assert (got["b"].total, got["b"].non_null, got["b"].nulls, got["b"].distinct_count) == (10, 5, 5, 5)
    top = profile.top_values(made(spark), 2).orderBy("column_name", "rank").collect()
    assert [(r.column_name, r.value, r.n) for r in top] == [("a", "v0", 4), ("a", "v1", 3), ("b", "0", 1), ("b", "2", 1)]


def test_edits(spark):
    df = made(spark, 5)
    assert rows(edits.update_cell(df, 2, "a", "new"), "a")[2] == ("new",)
    for bad in ((9, "a"), (1, "zz")):
        with pytest.raises(ValueError):
            edits.update_cell(df, *bad, "x")
    out, n = edits.update_cells(df, [(0, "a", "p"), (0, "a", "q"), (7, "a", "r"), (1, "zz", "s")])
    assert n == 2 and rows(out, "a")[0] == ("q",)
    out = edits.insert_rows(df, 99, [["x"], ["y", "z", "more"]])
    assert rows(out)[5:] == [(5, "x", ""), (6, "y", "z")]
    out, n = edits.delete_rows(df, 1, 2)
    assert n == 2 and rows(out, ROW, "a") == [(0, "v0"), (1, "v0"), (2, "v1")]
    assert edits.delete_rows(df, 9, 2)[1] == 0
    for f in (lambda: edits.add_column(df, "A"), lambda: edits.rename_column(df, "a", "b"), lambda: edits.rename_column(df, "zz", "c")):
        with pytest.raises(ValueError):
            f()


def test_names():
    assert column_names(["a", "A", "", "", "a_2"]) == ["a", "A_2", "column", "column_2", "a_2_2"]
    assert schema_name("main") == "file_main" and schema_name("a b.c") == "a_b_c"
    check_table_name("_ok1")
    for bad in ("", "x" * 65, "sheet_1", "1a", "a-b", "Files"):
        with pytest.raises(ValueError):
            check_table_name(bad)


def test_joins(spark):
    left = spark.createDataFrame([(1, "k", 10), (2, "k", 5), (3, "z", 10), (4, None, 10), (5, "k", None)], "id int, k string, t int")
    right = spark.createDataFrame([("k", 5, "a"), ("k", 9, "b"), ("k", 11, "c"), (None, 1, "d")], "k string, s int, v string")
    got = {r.id: r.v for r in asof_join(left, right, by=["k"], left_on="t", right_on="s", take=["v"]).collect()}
    assert got == {1: "b", 2: "a", 3: None, 4: None, 5: None}
    assert positional_join(made(spark, 2).select(ROW, "a"), made(spark, 3).select(ROW, "b")).count() == 3
    pts = spark.createDataFrame([(float(x),) for x in range(20)], "x double")
    rng = spark.createDataFrame([(2.0, 9.0), (8.5, 8.7), (5.0, 5.0), (-3.0, 1.0)], "lo double, hi double")
    want = sorted((x, lo) for x in map(float, range(20)) for lo, hi in ((2.0, 9.0), (8.5, 8.7), (5.0, 5.0), (-3.0, 1.0)) if lo <= x < hi)
    assert sorted((r.x, r.lo) for r in range_join(pts, rng, point="x", start="lo", end="hi", width=4.0).collect()) == want


def test_asof_join_of_hot_and_null_keys(spark, monkeypatch):
    """A hot key is cut by time; null keys and times stay, and match nothing."""
    r = random.Random(1)
    left = [(i, "hot" if r.random() < 0.8 else r.choice(["a", None]), None if r.random() < 0.05 else r.randrange(400)) for i in range(300)]
    right = [(r.choice(["hot", "hot", "a", None]), None if r.random() < 0.05 else r.randrange(400), i) for i in range(120)]
    a, b = spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "k string, u int, v int")
    want = sorted((i, max(((u, v) for q, u, v in right if q == k and u is not None and u <= t), default=(0, None))[1] if k is not None and t is not None else None) for i, k, t in left)
    for rows in (10**6, 20):
        monkeypatch.setattr(joins, "HOT_ROWS", rows)
        assert sorted((x.id, x.v) for x in joins.asof_join(a, b, by=["k"], left_on="t", right_on="u", take=["v"]).collect()) == want


def test_asof_join_of_crowded_times(spark, monkeypatch):
    """Nearly all rows of a key at one time, and bursts: parts are quantiles, not equal widths."""
    r = random.Random(4)
    for times in ([5] * 190 + [1, 4, 6, 9, 1000], [r.choice([0, 1, 2, 10**9]) for _ in range(150)], [7] * 100):
        left = [(i, "k", t) for i, t in enumerate(times)]
        right = [("k", r.choice(times) - r.choice([0, 0, 1]), i) for i in range(90)]
        a, b = spark.createDataFrame(left, "id int, k string, t long"), spark.createDataFrame(right, "k string, u long, v int")
        want = sorted((i, max(((u, v) for _, u, v in right if u <= t), default=(0, None))[1]) for i, _, t in left)
        for rows in (10**6, 20):
            monkeypatch.setattr(joins, "HOT_ROWS", rows)
            assert sorted((x.id, x.v) for x in joins.asof_join(a, b, by=["k"], left_on="t", right_on="u", take=["v"]).collect()) == want


def test_range_join_of_long_ranges(spark):
    points = spark.createDataFrame([(i, float(i * 37 % 1000)) for i in range(200)], "p int, x double")
    ranges = spark.createDataFrame([(1, 0.0, 1e9), (2, 5.0, 6.0), (3, 10.0, 10.0), (4, None, 5.0), (5, 100.0, 333.3), (6, -50.0, 3.0)], "r int, lo double, hi double")
    got = joins.range_join(points, ranges, point="x", start="lo", end="hi", width=2.0)
    want = sorted((p, r) for p in range(200) for r, lo, hi in ((1, 0, 1e9), (2, 5, 6), (5, 100, 333.3), (6, -50, 3)) if lo <= p * 37 % 1000 < hi)
    assert sorted((x.p, x.r) for x in got.collect()) == want


def test_exact_quantiles(spark, monkeypatch):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), r.choice([None, 5.0, r.uniform(0, 9)])) for _ in range(400)] + [("one", 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double")

    def quantile(values, q):
        values = sorted(v for v in values if v is not None)
        if not values:
            return None
        at = q * (len(values) - 1)
        low, high = values[int(at)], values[min(int(at) + 1, len(values) - 1)]
        return round(low + (high - low) * (at - int(at)), 9)

    shares = {"a0": 0.0, "q": 0.31, "m": 0.5, "a1": 1.0}
    for tile in (10**6, 5):
        monkeypatch.setattr(inequality, "TILE_ROWS", tile)
        got = {x.g: [v if v is None else round(v, 9) for v in x[1:]] for x in exact_quantiles(df, ["g"], "x", shares).collect()}
        assert got == {g: [quantile([x for h, x in rows if h == g], q) for q in shares.values()] for g in {g for g, _ in rows}}
        assert round(exact_quantiles(df, [], "x", {"m": 0.5}).first().m, 9) == quantile([x for _, x in rows], 0.5)
    assert exact_quantiles(df.limit(0), ["g"], "x", shares).count() == 0 and exact_quantiles(df.limit(0), [], "x", shares).first()[:] == (None,) * 4


def test_top_values_of_long_texts(spark):
    """Texts alike in their first characters, and all equally frequent."""
    rows = [("p" * 40 + f"{i % 30:03}", "x" * (i % 3), f"{i}") for i in range(90)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    got = sorted((x.column_name, x["rank"], x.value, x.n) for x in profile.top_values(df, 4).collect())
    want = []
    for k, name in enumerate("abc"):
        seen = {}
        for row in rows:
            seen[row[k]] = seen.get(row[k], 0) + 1
        seen.pop("", None)
        want += [(name, i, v, n) for i, (v, n) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:4], 1)]
    assert got == sorted(want)


def test_statistics_of_many_columns_and_no_rows(spark):
    df = spark.createDataFrame([("a", None), ("", "x"), ("a", "x")], "p string, q string")
    got = {r.column_name: tuple(r)[1:] for r in profile.column_statistics(df).collect()}
    assert got == {"p": (3, 2, 1, 1), "q": (3, 2, 1, 1)}
    assert {tuple(r)[1:] for r in profile.column_statistics(df.limit(0)).collect()} == {(0, 0, 0, 0)}
