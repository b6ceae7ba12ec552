"""Delimited text whose cells may hold line ends, read by many tasks.

A line leaves quotes open or shut, by the state in which it finds them. So does a block of lines, and whoever knows what each block makes of
either state knows the state at the start of every block: blocks are scanned in parallel under both, their effects are put one after another
(a row for each block, on the driver), and then each block is parsed alone, from the first record that begins in it. Records that go on over
a block's end are put together from their pieces.

Quotes open at a cell's start alone; inside, a doubled quote is a quote; what follows a closing quote belongs to the cell. Records end at \\n,
\\r\\n or \\r outside of quotes; empty lines are none.
"""

from __future__ import annotations

import csv
import itertools
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ROW

#: A file's blocks must be the same in every scan of it, whatever the executors at hand; Spark makes at least so many of files up to some GB.
LEAST_BLOCKS = "64"
_LEAST_BLOCKS = "spark.sql.files.minPartitionNum"
_BOM = b"\xef\xbb\xbf"
_ROWS = 4096


def lines_of(value: bytes) -> list[bytes]:
    """A line up to \\n as lines with their ends, cut at lone \\r too."""
    if value.find(b"\r", 0, len(value) - 1) < 0:
        return [value + b"\n"]
    *before, last = value.split(b"\r")
    out = [x + b"\r" for x in before]
    if last:
        return [*out, last + b"\n"]
    out[-1] += b"\n"
    return out


def walk(line: bytes, is_open: bool, sep: bytes) -> tuple[bool, int]:
    """Whether a line leaves quotes open, and how many separators it has outside of them. is_open: whether it begins inside of them."""
    if b'"' not in line:
        return is_open, 0 if is_open else line.count(sep)
    at, found, starts = 0, 0, not is_open
    while True:
        if starts and line.startswith(b'"', at):
            is_open, at = True, at + 1
        if is_open:
            at = line.find(b'"', at)
            if at < 0:
                return True, found
            if line.startswith(b'"', at + 1):
                at += 2
                starts = False
                continue
            is_open, at = False, at + 1
        at = line.find(sep, at)
        if at < 0:
            return False, found
        found, at, starts = found + 1, at + 1, True


@dataclass
class _Walk:
    """What a block makes of one state at its start."""

    is_open: bool
    header: int = 0  # cells of the header
    wide: int = 0  # records that begin and end here and have more of them
    records: int = 0  # that begin here
    width: int = 0  # cells of the widest record that begins and ends here
    seps: int = 0  # of the record at hand
    head: int = -1  # separators of what goes on from the block before, if it ends here

    def __post_init__(self):
        self.outside = self.is_open

    def step(self, line: bytes, sep: bytes) -> None:
        if not self.is_open:
            if line in (b"\n", b"\r\n", b"\r"):
                return
            self.records += 1
        self.is_open, n = walk(line, self.is_open, sep)
        self.seps += n
        if not self.is_open:
            if self.outside:
                self.head, self.outside = self.seps, False
            else:
                self.width = max(self.width, self.seps + 1)
                self.wide += self.seps >= self.header
            self.seps = 0


_EFFECT = ("is_open", "records", "width", "wide", "seps", "head")


@dataclass
class Block:
    """Where a block stands: how its quotes begin and end, the records before it, and the block in which the record begins that goes on into it."""

    start: int
    is_open: bool
    ends_open: bool
    before: int
    begin: int


def _effects(sep: bytes, header: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, lines in itertools.groupby(_lines(batches), key=lambda x: x[0]):
            walks = [_Walk(False, header), _Walk(True, header)]
            for k, (_, line) in enumerate(lines):
                for w in walks:
                    w.step(line.removeprefix(_BOM) if block == 0 and k == 0 else line, sep)
            yield pa.RecordBatch.from_pydict({"block": [block]} | {f"{name}_{k}": [getattr(w, name)] for k, w in enumerate(walks) for name in _EFFECT})

    return run


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    """(block, line) of rows (block, value, ..)."""
    for batch in batches:
        for block, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for line in lines_of(value):
                yield block, line


@dataclass
class Layout:
    """A file's blocks, its records (header included), those of them that are wider than the header, and the cells of the widest one."""

    blocks: list[Block]
    records: int
    wide: int
    width: int


def _scan(spark: SparkSession, path: str) -> DataFrame:
    if spark.conf.get(_LEAST_BLOCKS, None) is None:
        spark.conf.set(_LEAST_BLOCKS, LEAST_BLOCKS)
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def layout(spark: SparkSession, path: str, sep: str, header: int) -> Layout:
    """One pass over the file, and one row for each of its blocks to the driver."""
    schema = ", ".join(["block long", *[f"{name}_{k} {'boolean' if name == 'is_open' else 'long'}" for k in (0, 1) for name in _EFFECT]])
    rows = sorted(_scan(spark, path).mapInArrow(_effects(sep.encode(), header), schema).collect(), key=lambda r: r.block)
    blocks, is_open, before, begin, seps, width, wide = [], False, 0, -1, 0, 0, 0
    for r in rows:
        k = int(is_open)
        ends, records, inside, more, tail, head = (r[f"{name}_{k}"] for name in _EFFECT)
        blocks.append(Block(r.block, is_open, ends, before, begin))
        before += records
        width, wide = max(width, inside), wide + more
        if is_open and head >= 0:
            width, wide = max(width, seps + head + 1), wide + (seps + head >= header)
        if ends:
            # What is open began here, unless the whole block is inside of it.
            whole = is_open and head < 0
            begin, seps = (begin, seps + tail) if whole else (r.block, tail)
        is_open = ends
    if is_open:
        width, wide = max(width, seps + 1), wide + (seps >= header)
    return Layout(blocks, before, wide, width)


def _parsed(sep: str, encoding: str, pieces: bool):
    """Rows (row, cells) of the records that begin and end in a block, or (begin, place, row, piece) of those that do not; from (block, value, is_open, ends_open, before, begin)."""
    field = sep.encode()

    def of_block(block: int, lines: Iterator[bytes], is_open: bool, ends_open: bool, before: int, begin: int) -> Iterator[tuple]:
        if is_open:
            head = []
            for line in lines:
                head.append(line)
                is_open, _ = walk(line, is_open, field)
                if not is_open:
                    break
            if pieces:
                yield begin, block, None, b"".join(head)
            if is_open:
                return
        held, ended = [], []

        def feed() -> Iterator[str]:
            for line in lines:
                held.append(line)
                yield line.decode(encoding, "replace")
            ended.append(True)

        csv.field_size_limit(sys.maxsize)
        records, row = csv.reader(feed(), delimiter=sep), before - 1  # the header has the number -1
        while True:
            held.clear()
            cells = next(records, None)
            if cells is None:
                return
            if not cells:
                continue
            if ended and ends_open:
                if pieces:
                    yield block, block, row, b"".join(held)
            elif not pieces and row >= 0:
                yield row, cells
            row += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple] = {}

        def noted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    blocks = np.asarray(batch.column(0), np.int64)
                    for i in [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist()]:
                        known[int(blocks[i])] = tuple(batch.column(c)[i].as_py() for c in range(2, 6))
                yield batch

        def found() -> Iterator[tuple]:
            for block, lines in itertools.groupby(_lines(noted()), key=lambda x: x[0]):
                state = known[block]
                if state[0] is None:
                    raise RuntimeError("the file is cut into other blocks than when it was opened (spark.sql.files settings have changed); read it again")
                only = (line for _, line in lines)
                if block == 0:
                    first = next(only, b"")
                    only = itertools.chain([first.removeprefix(_BOM)], only)
                yield from of_block(block, only, *state)

        rows = found()
        while batch := list(itertools.islice(rows, _ROWS)):
            columns = list(zip(*batch))
            if pieces:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["begin", "place", "row", "piece"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.list_(pa.string()))], names=["row", "cells"])

    return run


def _assembled(sep: str, encoding: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        for batch in batches:
            cells = []
            for parts in batch.column(1).to_pylist():
                values = b"".join(p["piece"] for p in parts).split(b"\n")
                lines = [x for value in (values if values[-1] else values[:-1]) for x in lines_of(value)]
                cells.append(next(csv.reader((x.decode(encoding, "replace") for x in lines), delimiter=sep)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.list_(pa.string()))], names=["row", "cells"])

    return run


def records(spark: SparkSession, path: str, sep: str, encoding: str, made: Layout) -> DataFrame:
    """(ROW, cells) of all records but the header. Rows are in no order."""
    states = spark.createDataFrame([(b.start, b.is_open, b.ends_open, b.before, b.begin) for b in made.blocks], "block long, is_open boolean, ends_open boolean, before long, begin long")
    # A row for each block of the file.
    known = _scan(spark, path).join(F.broadcast(states), "block", "left").select("block", "value", "is_open", "ends_open", "before", "begin")
    rows = known.mapInArrow(_parsed(sep, encoding, False), "row long, cells array<string>")
    over = [b.start for b in made.blocks if b.is_open or b.ends_open]
    if over:
        pieces = known.filter(F.col("block").isin(over) | F.col("is_open").isNull()).mapInArrow(_parsed(sep, encoding, True), "begin long, place long, row long, piece binary")
        whole = pieces.groupBy("begin").agg(F.max("row").alias("row"), F.array_sort(F.collect_list(F.struct("place", "piece"))).alias("parts")).filter("row >= 0")
        rows = rows.unionByName(whole.select("row", "parts").mapInArrow(_assembled(sep, encoding), "row long, cells array<string>"))
    return rows.withColumnRenamed("row", ROW)
