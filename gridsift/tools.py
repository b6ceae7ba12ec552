"""The verbs of the JSON interface: one call {"tool": name, "args": {...}}, or a list of them with shared state."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import functions as F

from . import sinks
from .catalog import Catalog
from .functions.cells import text_of
from .model import Condition, SearchQuery
from .operators import profile
from .operators.search import search, search_stats

SEARCH_ROWS, SQL_ROWS, TOP_VALUES, SAMPLE_ROWS = 100, 1000, 5, 10


def _rows(df, columns: list[str]) -> list[list[str]]:
    return [list(r) for r in df.select(*[text_of(F.col(f"`{c}`")).alias(f"c{k}") for k, c in enumerate(columns)]).collect()]


class Tools:
    """Results are what json.dumps takes. Bad arguments raise ValueError or TypeError, and end a list of calls."""

    def __init__(self, catalog: Catalog):
        self.catalog = catalog

    def call(self, name: str, args: dict[str, Any]) -> Any:
        if name.startswith("_") or name in ("call", "run", "catalog") or not hasattr(self, name):
            raise ValueError(f"no tool {name!r}")
        return getattr(self, name)(**args)

    def run(self, text: str) -> Any:
        """JSON text of one call or a list."""
        given = json.loads(text)
        one = lambda c: self.call(c["tool"], c.get("args", {}))
        return [one(c) for c in given] if isinstance(given, list) else one(given)

    def import_file(self, path: str, format: str | None = None, repair: bool = False) -> list[dict]:
        sheets = self.catalog.load(path, format, repair)
        return [{"file": s.file, "sheet": s.name, "table": s.view, "columns": s.columns, "sample": self.get_sheet_data(s.file, s.name, 0, 3)["rows"]} for s in sheets]

    def list_files(self) -> list[dict]:
        return [r.asDict() for r in self.catalog.list_files().collect()]

    def get_metadata(self, file: str) -> list[dict]:
        return self.catalog.metadata(file)

    def get_sheet_sample(self, file: str, sheet: str, n: int = SAMPLE_ROWS) -> dict:
        s = self.catalog.one(file, sheet)
        return {"columns": s.columns, "rows": _rows(profile.sample_evenly(s.df, n), s.columns)}

    def get_sheet_data(self, file: str, sheet: str, start: int = 0, end: int = 500, columns: list[str] | None = None) -> dict:
        s = self.catalog.one(file, sheet)
        names = [c for c in columns if c in s.columns] if columns is not None else s.columns
        total = s.df.count()
        return {"columns": names, "rows": _rows(profile.slice_rows(s.df, start, end), names), "total": total, "truncated": end < total}

    def get_sheet_statistics(self, file: str, sheet: str, top: int = TOP_VALUES) -> list[dict]:
        s = self.catalog.one(file, sheet)
        out = {r.column_name: r.asDict() | {"top": []} for r in profile.column_statistics(s.df).collect()}
        for r in profile.top_values(s.df, top).orderBy("column_name", "rank").collect():
            out[r.column_name]["top"].append([r.value, r.n])
        return [out[c] for c in s.columns]

    def search(self, query: str, column: str | None = None, sheet: str | None = None, mode: str = "fulltext", limit: int = SEARCH_ROWS, invert: bool = False, context: int = 0, conditions: list[dict] | None = None) -> dict:
        q = SearchQuery(query, column, mode, limit + 1, sheet, invert, context, tuple(Condition(**c) for c in conditions or ()))
        tables = self.catalog.tables()
        found = search(tables, q).collect()
        stats = search_stats(tables, q).collect()
        return {"results": [r.asDict(recursive=True) for r in found[:limit]], "truncated": len(found) > limit, "rows_searched": sum(r.rows_searched for r in stats), "matches": sum(r.matches for r in stats)}

    def execute_sql(self, sql: str, limit: int = SQL_ROWS) -> dict:
        df = self.catalog.sql(sql)
        rows = _rows(df.toDF(*[f"c{k}" for k in range(len(df.columns))]).limit(limit + 1), [f"c{k}" for k in range(len(df.columns))])
        return {"columns": df.columns, "rows": rows[:limit], "truncated": len(rows) > limit}

    def export_query(self, sql: str, path: str) -> dict:
        return {"rows": sinks.export_query(self.catalog.sql(sql), path), "path": path}

    def save_as(self, file: str, path: str, sheet: str | None = None) -> dict:
        sinks.save_as(self.catalog, file, path, sheet)
        return {"path": path}

    def save(self, file: str) -> dict:
        return self.save_as(file, self.catalog.paths[file].removeprefix("file://"))

    def update_cell(self, file: str, sheet: str, row: int, column: str, value: str) -> dict:
        self.catalog.update_cell(file, sheet, row, column, value)
        return {"updated": 1}

    def update_cells(self, file: str, sheet: str, updates: list[dict]) -> dict:
        return {"updated": self.catalog.update_cells(file, sheet, [(u["row"], u["column"], u["value"]) for u in updates])}

    def insert_rows(self, file: str, sheet: str, start: int, rows: list[list[str]]) -> dict:
        self.catalog.insert_rows(file, sheet, start, rows)
        return {"inserted": len(rows)}

    def delete_rows(self, file: str, sheet: str, start: int, count: int = 1) -> dict:
        return {"deleted": self.catalog.delete_rows(file, sheet, start, count)}

    def add_column(self, file: str, sheet: str, name: str, default: str = "") -> dict:
        self.catalog.add_column(file, sheet, name, default)
        return {"added": name}

    def rename_column(self, file: str, sheet: str, old: str, new: str) -> dict:
        self.catalog.rename_column(file, sheet, old, new)
        return {"renamed": new}

    def materialize_query(self, name: str, sql: str, replace: bool = False, max_rows: int | None = None) -> dict:
        return {"table": name, "rows": self.catalog.materialize_query(name, sql, replace, max_rows)}

    def drop_temp_table(self, name: str) -> dict:
        self.catalog.drop_temp_table(name)
        return {"dropped": name}


VERBS = [n for n in vars(Tools) if not n.startswith("_") and n not in ("call", "run")]
