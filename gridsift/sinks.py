"""Exports. What can grow is written by Spark; workbooks and rendered text go through the driver, one partition at a time."""

from __future__ import annotations

import csv
import io
import json
import os
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain, islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import Catalog
from .functions.cells import text_of
from .sources.office import write_xlsx

#: So many rows go into one sheet of a workbook: the format's limit, less the header. What is more goes on in further sheets.
SHEET_ROWS = 1_048_575


def as_text(df: DataFrame) -> DataFrame:
    return df.select(*[text_of(F.col(f"`{c}`")).alias(c) for c in df.columns])


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.option("header", True).option("sep", sep).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One object per line, all values text."""
    as_text(df).write.json(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def results_table(found: DataFrame) -> DataFrame:
    """Search results (file, sheet, col_names, cells) as one table: file, sheet, and the union of all columns in order of first appearance."""
    names = found.groupBy("file", "sheet", "col_names").agg(F.min("row_index").alias("first")).orderBy("file", "sheet").select("col_names").collect()  # a row per table
    columns = list(dict.fromkeys(c for r in names for c in r.col_names))
    if not columns:
        raise ValueError("there are no results to export")
    cell = lambda c: F.get("cells", (F.array_position("col_names", c) - 1).cast("int"))
    return found.select("file", "sheet", *[F.when(F.array_contains("col_names", c), cell(c)).otherwise(F.lit("")).alias(c if c not in ("file", "sheet") else f"{c}_2") for c in columns])


def export_results_csv(found: DataFrame, path: str) -> None:
    write_csv(results_table(found), path)


def save_as(catalog: Catalog, file: str, path: str, sheet: str | None = None) -> None:
    """A file's sheets as a workbook. The new file is complete before it takes the old one's place."""
    sheets = catalog.sheets(file, sheet)
    part = f"{path}.part"
    write_xlsx(((s.name, s.columns, catalog.text_rows(s)) for s in sheets), part)
    os.replace(part, path)


def export_query(df: DataFrame, path: str) -> int:
    """All rows of a query as a workbook, streamed one partition at a time; an empty result is an error. Returns how many rows that were."""
    rows = (list(r) for r in as_text(df.toDF(*[f"c{k}" for k in range(len(df.columns))])).toLocalIterator())
    first = next(rows, None)
    if first is None:
        raise ValueError("the query has no rows to export")
    count = 0

    def sheets() -> Iterator[tuple[str, list[str], Iterator[list[str]]]]:
        left, number = chain([first], rows), 0

        def counted(part: Iterator[list[str]]) -> Iterator[list[str]]:
            nonlocal count
            for r in part:
                count += 1
                yield r

        while (head := next(left, None)) is not None:
            number += 1
            yield "Query" if number == 1 else f"Query_{number}", df.columns, counted(chain([head], islice(left, SHEET_ROWS - 1)))

    write_xlsx(sheets(), path)
    return count


def _width(text: str) -> int:
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def rendered(columns: list[str], rows: Iterable[list[str]], form: str = "table") -> Iterator[str]:
    """Lines of a result as table, markdown, simple, csv, tsv or json; another name is csv."""
    rows = list(rows)
    if form == "json":
        yield json.dumps([dict(zip(columns, r)) for r in rows], ensure_ascii=False)
    elif form == "markdown":
        row = lambda cells: "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in cells) + " |"
        yield row(columns)
        yield "|" + "---|" * len(columns)
        yield from map(row, rows)
    elif form == "simple":
        yield from ("\t".join(r) for r in [columns, *rows])
    elif form == "table":
        widths = [max([_width(c), *(_width(r[k]) for r in rows)]) for k, c in enumerate(columns)]
        line = lambda cells: " | ".join(c + " " * (w - _width(c)) for c, w in zip(cells, widths)).rstrip()
        yield line(columns)
        yield "-+-".join("-" * w for w in widths)
        yield from map(line, rows)
    else:
        out = io.StringIO()
        csv.writer(out, delimiter="\t" if form == "tsv" else ",", lineterminator="\n").writerows([columns, *rows])
        yield from out.getvalue().splitlines()


def highlighted(text: str, parts: list[str], on: str = "\x1b[1;31m", off: str = "\x1b[0m") -> str:
    """The parts (in order, as search.spans() gives them) marked in a text."""
    out, at = [], 0
    for p in parts:
        if p and (k := text.find(p, at)) >= 0:
            out += [text[at:k], on, p, off]
            at = k + len(p)
    return "".join([*out, text[at:]])
