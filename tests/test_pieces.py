"""A piece table against edits of a plain list."""

import random
import time

import pytest

from gridsift.model import ROW
from gridsift.operators.pieces import PieceTable, _passed
from pyspark.sql import functions as F


def rows_of(table):
    return [tuple(r)[1:] for r in table.folded().orderBy(ROW).collect()]


def test_against_a_list(spark):
    r = random.Random(3)
    plain = [[str(i), f"v{i}"] for i in range(50)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(plain)], f"{ROW} long, a string, b string").repartition(3)
    table, names = PieceTable.of(df), ["a", "b"]
    for step in range(300):
        kind, at = r.choice(["cell", "cells", "insert", "delete", "column"]), r.randrange(-3, len(plain) + 5)
        if kind == "cell" and plain:
            row, k = r.randrange(len(plain)), r.randrange(len(names))
            table = table.update_cell(row, names[k], f"c{step}")
            plain[row][k] = f"c{step}"
        elif kind == "cells":
            updates = [(r.randrange(-1, len(plain) + 2), r.choice([*names, "none"]), f"m{step}{j}") for j in range(4)]
            table, n = table.update_cells(updates)
            valid = [(i, c, v) for i, c, v in updates if 0 <= i < len(plain) and c in names]
            assert n == len(valid)
            for i, c, v in valid:
                plain[i][names.index(c)] = v
        elif kind == "insert":
            new = [[f"n{step}"], [f"x{step}", "y", *"zzzzzzzzz"]][: r.randrange(3)]
            table = table.insert_rows(at, new)
            at = min(max(at, 0), len(plain))
            plain[at:at] = [(x + [""] * len(names))[: len(names)] for x in new]
        elif kind == "delete":
            n = r.randrange(-1, 6)
            table, gone = table.delete_rows(at, n)
            begin = min(max(at, 0), len(plain))
            end = min(begin + max(n, 0), len(plain))
            assert gone == end - begin
            del plain[begin:end]
        elif r.random() < 0.1:
            table = table.add_column(f"k{step}", "d")
            names.append(f"k{step}")
            for x in plain:
                x.append("d")
        elif r.random() < 0.2:
            k = r.randrange(len(names))
            table, names[k] = table.rename_column(names[k], f"r{step}"), f"r{step}"
        if step % 40 == 0:
            assert rows_of(table) == [tuple(x) for x in plain] and table.count() == len(plain)
    got = table.folded().orderBy(ROW).collect()
    assert [tuple(x)[1:] for x in got] == [tuple(x) for x in plain] and [x[0] for x in got] == list(range(len(plain))) and table.folded().columns == [ROW, *names]


def test_errors_types_and_nothing(spark):
    df = spark.createDataFrame([(0, 5, "x"), (1, 6, None)], f"{ROW} long, n int, t string")
    table = PieceTable.of(df)
    for bad in (lambda: table.update_cell(2, "n", "1"), lambda: table.update_cell(0, "zz", "1"), lambda: table.add_column("N"), lambda: table.rename_column("n", "T"), lambda: table.rename_column("zz", "y")):
        with pytest.raises(ValueError):
            bad()
    out = table.update_cell(1, "n", "70").insert_rows(0, [["8", "new"]])
    assert out.folded().dtypes == [(ROW, "bigint"), ("n", "int"), ("t", "string")] and rows_of(out) == [(8, "new"), (5, "x"), (70, None)]
    assert rows_of(table.delete_rows(0, 9)[0]) == [] and rows_of(PieceTable.of(df.limit(0)).insert_rows(3, [["1"]])) == [(1, "")]
    assert rows_of(table) == [(5, "x"), (6, None)]


def test_a_thousand_edits_are_one_plan(spark):
    df = spark.range(5000).selectExpr(f"id AS {ROW}", "cast(id AS string) AS a", "'b' AS b")
    table, plain = PieceTable.of(df), [[str(i), "b"] for i in range(5000)]
    r = random.Random(9)
    began = time.time()
    sizes = []
    for step in range(1000):
        at = r.randrange(len(plain))
        if step % 3 == 0:
            table, plain[at][1] = table.update_cell(at, "b", f"u{step}"), f"u{step}"
        elif step % 3 == 1:
            table = table.insert_rows(at, [["new", str(step)]])
            plain.insert(at, ["new", str(step)])
        else:
            table, _ = table.delete_rows(at, 2)
            del plain[at : at + 2]
        if step in (20, 999):
            sizes.append(len(table.folded()._jdf.queryExecution().optimizedPlan().treeString().splitlines()))
    assert rows_of(table) == [tuple(x) for x in plain]
    assert sizes[0] == sizes[1] < 20 and time.time() - began < 60


def test_steps(spark):
    for n in (1, 3, 16, 17, 100, 257):
        ends = [3 * k + 2 for k in range(n)]
        got = spark.range(0, 3 * n + 9).select("id", _passed(F.col("id"), ends).alias("k")).collect()
        assert all(x.k == sum(e <= x.id for e in ends) for x in got)
