"""Edits of rows and columns: each gives a new version of the table, and row numbers stay gapless."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import ROW


def _need(df: DataFrame, column: str) -> None:
    if column not in df.columns or column == ROW:
        raise ValueError(f"no column {column!r}")


def update_cell(df: DataFrame, row: int, column: str, value: str) -> DataFrame:
    """Raises ValueError where there is no such row or column."""
    _need(df, column)
    if df.filter(F.col(ROW) == row).isEmpty():
        raise ValueError(f"no row {row}")
    return df.withColumn(column, F.when(F.col(ROW) == row, F.lit(value)).otherwise(F.col(f"`{column}`")))


def update_cells(df: DataFrame, updates: list[tuple[int, str, str]]) -> tuple[DataFrame, int]:
    """The table with all valid updates, the last of several for a cell, and how many were valid. Updates are a list of the caller's, so the
    patch is small; it is one map per column and needs no join.
    """
    total = df.count()
    valid = [(r, c, v) for r, c, v in updates if 0 <= r < total and c in df.columns and c != ROW]
    by_column: dict[str, dict[int, str]] = {}
    for r, c, v in valid:
        by_column.setdefault(c, {})[r] = v
    patched = {}
    for c, patch in by_column.items():
        values = F.create_map(*[x for r, v in patch.items() for x in (F.lit(r).cast("long"), F.lit(v))])
        row = F.col(ROW).cast("long")
        patched[c] = F.when(row.isin(*patch), values[row]).otherwise(F.col(f"`{c}`"))
    return df.withColumns(patched) if patched else df, len(valid)


def insert_rows(df: DataFrame, start: int, rows: list[list[str]]) -> DataFrame:
    """Rows put before number start (held to the table's range), cells filled up or cut to the columns."""
    names = [c for c in df.columns if c != ROW]
    at = min(max(start, 0), df.count())
    schema = T.StructType([T.StructField(ROW, T.LongType()), *[T.StructField(c, T.StringType()) for c in names]])
    fresh = df.sparkSession.createDataFrame([(at + i, *[r[k] if k < len(r) else "" for k in range(len(names))]) for i, r in enumerate(rows)], schema)
    moved = df.withColumn(ROW, F.when(F.col(ROW) >= at, F.col(ROW) + len(rows)).otherwise(F.col(ROW)).cast("long"))
    fresh = fresh.select(*[F.col(f"`{c}`").cast(df.schema[c].dataType).alias(c) if c != ROW else F.col(ROW) for c in df.columns])
    return moved.unionByName(fresh)


def delete_rows(df: DataFrame, start: int, count: int) -> tuple[DataFrame, int]:
    """The table without rows start to start + count, and how many that were. Rows behind are renumbered by subtraction."""
    total = df.count()
    start = min(max(start, 0), total)
    n = min(max(count, 0), total - start)
    kept = df.filter((F.col(ROW) < start) | (F.col(ROW) >= start + n))
    return kept.withColumn(ROW, F.when(F.col(ROW) >= start + n, F.col(ROW) - n).otherwise(F.col(ROW))), n


def add_column(df: DataFrame, name: str, default: str = "") -> DataFrame:
    if name.lower() in [c.lower() for c in df.columns]:
        raise ValueError(f"there is a column {name!r}")
    return df.withColumn(name, F.lit(default))


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    _need(df, old)
    if new.lower() != old.lower() and new.lower() in [c.lower() for c in df.columns]:
        raise ValueError(f"there is a column {new!r}")
    return df.withColumnRenamed(old, new)
