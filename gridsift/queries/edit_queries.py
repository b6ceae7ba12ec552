"""Edits of rows and columns, and session tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..model import ROW
from ..operators import edits
from ..operators.pieces import PieceTable
from .tables import numbered, table


def _on_nation(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(numbered(table(spark, sf_dir, "nation"), "n_nationkey"))

    return run


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of several kinds on one table of orders, folded into one plan."""
    orders = numbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey")
    edited = PieceTable.of(orders).delete_rows(10, 5)[0].insert_rows(3, [["-1", "7", "new"], ["-2", "8"]]).rename_column("o_orderstatus", "status").add_column("note", "n")
    edited = edited.update_cells([(0, "status", "first"), (4, "note", "second new row"), (12, "note", "after the gap"), (20, "o_custkey", "0")])[0]
    return edited.folded()


QUERIES = {
    "edit_pieces": _pieces,
    "edit_update_cell": _on_nation(lambda d: edits.update_cell(d, 3, "n_name", "NEW").drop(ROW)),
    "edit_update_cells": _on_nation(lambda d: edits.update_cells(d, [(1, "n_name", "A"), (1, "n_name", "B"), (99, "n_name", "C"), (2, "none", "D"), (4, "n_name", "E")])[0].drop(ROW)),
    "edit_insert_rows": _on_nation(lambda d: edits.insert_rows(d, 5, [["100", "X", "7"], ["101", "", "0"]])),
    "edit_delete_rows": _on_nation(lambda d: edits.delete_rows(d, 2, 4)[0]),
    "edit_add_column": _on_nation(lambda d: edits.add_column(d, "note", "none").drop(ROW)),
    "edit_rename_column": _on_nation(lambda d: edits.rename_column(d, "n_name", "title").drop(ROW)),
}

ORACLE_SQL = {
    "edit_pieces": "WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus AS status, 'n' AS note, CASE WHEN o_orderkey >= 15 THEN o_orderkey - 3 WHEN o_orderkey >= 3 THEN o_orderkey + 2 ELSE o_orderkey END AS r FROM orders WHERE o_orderkey NOT BETWEEN 10 AND 14 UNION ALL VALUES (-1, 7, 'new', 'n', 3), (-2, 8, '', 'n', 4)) SELECT o_orderkey, CASE r WHEN 20 THEN 0 ELSE o_custkey END AS o_custkey, CASE r WHEN 0 THEN 'first' ELSE status END AS status, CASE r WHEN 4 THEN 'second new row' WHEN 12 THEN 'after the gap' ELSE note END AS note, CAST(r AS BIGINT) AS _row_idx FROM o",
    "edit_update_cell": "SELECT n_nationkey, n_regionkey, CASE WHEN n_nationkey = 3 THEN 'NEW' ELSE n_name END AS n_name FROM nation",
    "edit_update_cells": "SELECT n_nationkey, n_regionkey, CASE n_nationkey WHEN 1 THEN 'B' WHEN 4 THEN 'E' ELSE n_name END AS n_name FROM nation",
    "edit_insert_rows": "SELECT n_nationkey, n_name, n_regionkey, CAST(CASE WHEN n_nationkey >= 5 THEN n_nationkey + 2 ELSE n_nationkey END AS BIGINT) AS _row_idx FROM nation UNION ALL VALUES (100, 'X', 7, 5), (101, '', 0, 6)",
    "edit_delete_rows": "SELECT n_nationkey, n_name, n_regionkey, CAST(CASE WHEN n_nationkey >= 6 THEN n_nationkey - 4 ELSE n_nationkey END AS BIGINT) AS _row_idx FROM nation WHERE n_nationkey < 2 OR n_nationkey >= 6",
    "edit_add_column": "SELECT *, 'none' AS note FROM nation",
    "edit_rename_column": "SELECT n_nationkey, n_regionkey, n_name AS title FROM nation",
}
