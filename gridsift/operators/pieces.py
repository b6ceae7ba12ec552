"""Many edits of one table as a piece table: stretches of the table's own rows, and of new ones, in order, and one table of changed cells.

An edit changes these lists alone. The table that they mean is one plan of constant depth, however many edits there were: own rows get
their new numbers by a step function, changed cells come from one join, and new rows are one more table. All that is held here is what the
caller has typed in.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field, replace
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import ROW

#: So many changed rows are broadcast at most.
BROADCAST_ROWS = 50_000


@dataclass(frozen=True)
class Piece:
    """count rows of the table (own) or of the new rows, from start on."""

    own: bool
    start: int
    count: int


@dataclass(frozen=True)
class Field:
    """A column: of the table, or (source None) a new one with one text."""

    name: str
    source: str | None
    default: str = ""


def _numbers(values: list[int]) -> Column:
    """Numbers as one array, a literal once the plan is folded."""
    return F.expr(f"cast(split('{','.join(map(str, values))}', ',') AS array<bigint>)")


def _passed(x: Column, ends: list[int]) -> Column:
    """How many of the ascending ends are x or less. Ends are looked through in two steps, so a row is compared with the square root of them, twice."""
    if len(ends) <= 16:
        return F.size(F.filter(_numbers(ends), lambda e: e <= x))
    step = max(1, int(len(ends) ** 0.5))
    groups = F.size(F.filter(_numbers(ends[step - 1 :: step]), lambda e: e <= x))
    return groups * step + F.size(F.filter(F.slice(_numbers(ends), groups * step + 1, F.lit(step)), lambda e: e <= x))


@dataclass(frozen=True)
class PieceTable:
    """df: the table, with gapless row numbers from 0; total: how many rows it has. Every edit gives a new PieceTable."""

    df: DataFrame
    total: int
    pieces: tuple[Piece, ...]
    fields: tuple[Field, ...]
    #: Cells of own rows by (row, field number), of new rows by place and field number.
    changed: dict[tuple[int, int], str] = field(default_factory=dict)
    fresh: tuple[dict[int, str], ...] = ()

    @staticmethod
    def of(df: DataFrame, total: int | None = None) -> PieceTable:
        n = df.count() if total is None else total
        return PieceTable(df, n, (Piece(True, 0, n),) if n else (), tuple(Field(c, c) for c in df.columns if c != ROW))

    def count(self) -> int:
        return sum(p.count for p in self.pieces)

    def _field(self, name: str) -> int | None:
        return next((k for k, f in enumerate(self.fields) if f.name == name), None)

    def _need(self, name: str) -> int:
        k = self._field(name)
        if k is None:
            raise ValueError(f"no column {name!r}")
        return k

    def update_cells(self, updates: list[tuple[int, str, str]]) -> tuple[PieceTable, int]:
        """With all valid updates, the last of several for a cell, and how many were valid."""
        ends = list(accumulate(p.count for p in self.pieces))
        changed, fresh, n = dict(self.changed), list(self.fresh), 0
        for row, name, value in updates:
            k = self._field(name)
            if k is None or not 0 <= row < (ends[-1] if ends else 0):
                continue
            i = bisect_right(ends, row)
            p = self.pieces[i]
            at = p.start + row - (ends[i] - p.count)
            if p.own:
                changed[at, k] = value
            else:
                fresh[at] = fresh[at] | {k: value}
            n += 1
        return replace(self, changed=changed, fresh=tuple(fresh)), n

    def update_cell(self, row: int, name: str, value: str) -> PieceTable:
        """Raises ValueError where there is no such row or column."""
        self._need(name)
        out, n = self.update_cells([(row, name, value)])
        if not n:
            raise ValueError(f"no row {row}")
        return out

    def _split(self, row: int) -> tuple[list[Piece], list[Piece]]:
        """The pieces before a row number, and those from it on."""
        before, after, passed = [], [], 0
        for p in self.pieces:
            take = min(max(row - passed, 0), p.count)
            if take:
                before.append(Piece(p.own, p.start, take))
            if take < p.count:
                after.append(Piece(p.own, p.start + take, p.count - take))
            passed += p.count
        return before, after

    def insert_rows(self, start: int, rows: list[list[str]]) -> PieceTable:
        """Rows put before number start (held to the table's range), cells filled up or cut to the columns."""
        if not rows:
            return self
        before, after = self._split(max(start, 0))
        new = tuple({k: r[k] if k < len(r) else "" for k in range(len(self.fields))} for r in rows)
        return replace(self, pieces=(*before, Piece(False, len(self.fresh), len(rows)), *after), fresh=self.fresh + new)

    def delete_rows(self, start: int, count: int) -> tuple[PieceTable, int]:
        """Without rows start to start + count, and how many that were."""
        total = self.count()
        start = min(max(start, 0), total)
        n = min(max(count, 0), total - start)
        return replace(self, pieces=(*self._split(start)[0], *self._split(start + n)[1])), n

    def _free(self, name: str) -> None:
        if name.lower() in [f.name.lower() for f in self.fields]:
            raise ValueError(f"there is a column {name!r}")

    def add_column(self, name: str, default: str = "") -> PieceTable:
        self._free(name)
        return replace(self, fields=(*self.fields, Field(name, None, default)), fresh=tuple(r | {len(self.fields): default} for r in self.fresh))

    def rename_column(self, old: str, new: str) -> PieceTable:
        k = self._need(old)
        if new.lower() != old.lower():
            self._free(new)
        return replace(self, fields=(*self.fields[:k], replace(self.fields[k], name=new), *self.fields[k + 1 :]))

    def folded(self) -> DataFrame:
        """The table as it is now: row numbers and columns."""
        spark, kinds = self.df.sparkSession, [self.df.schema[f.source].dataType if f.source else T.StringType() for f in self.fields]
        starts = [0, *accumulate(p.count for p in self.pieces)]
        placed = list(zip(self.pieces, starts))
        own = [(p, at) for p, at in placed if p.own]
        values = [F.col(f"`{f.source}`") if f.source else F.lit(f.default) for f in self.fields]
        base = self.df.select(F.col(ROW).cast("long").alias("_row"), *[v.alias(f"_f{k}") for k, v in enumerate(values)])
        # Changed cells: a row for each row that has some, a column for each column.
        touched = sorted({k for _, k in self.changed})
        if touched:
            rows: dict[int, dict[int, str]] = {}
            for (row, k), value in self.changed.items():
                rows.setdefault(row, {})[k] = value
            patch = spark.createDataFrame([(row, *[r.get(k) for k in touched]) for row, r in rows.items()], ", ".join(["_row long", *[f"_p{k} string" for k in touched]]))
            base = base.join(F.broadcast(patch) if len(rows) <= BROADCAST_ROWS else patch, "_row", "left")
        cells = [F.coalesce(F.col(f"_p{k}").cast(kinds[k]), F.col(f"_f{k}")) if k in touched else F.col(f"_f{k}") for k in range(len(self.fields))]
        number = F.col("_row")
        if not own:
            base = base.filter(F.lit(False))
        elif own != [(Piece(True, 0, self.total), 0)]:
            place = _passed(F.col("_row"), [p.start + p.count for p, _ in own])
            base = base.withColumn("_piece", place).filter(F.col("_piece") < len(own))
            begin = F.get(_numbers([p.start for p, _ in own]), F.col("_piece"))
            base = base.withColumn("_begin", begin).filter(F.col("_row") >= F.col("_begin"))
            number = F.col("_row") - F.col("_begin") + F.get(_numbers([at for _, at in own]), F.col("_piece"))
        out = base.select(number.cast("long").alias(ROW), *[c.alias(f.name) for c, f in zip(cells, self.fields)])
        new = [(at + i, *[self.fresh[p.start + i][k] for k in range(len(self.fields))]) for p, at in placed if not p.own for i in range(p.count)]
        if new:
            schema = T.StructType([T.StructField("_row", T.LongType()), *[T.StructField(f"_f{k}", T.StringType()) for k in range(len(self.fields))]])
            rows_df = spark.createDataFrame(new, schema)
            out = out.unionByName(rows_df.select(F.col("_row").alias(ROW), *[F.col(f"_f{k}").cast(kinds[k]).alias(f.name) for k, f in enumerate(self.fields)]))
        return out
