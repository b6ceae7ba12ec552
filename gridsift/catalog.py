"""The catalog: files and their tables, kept on the driver as names and lazy DataFrames."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.cells import text_of
from .functions.names import check_table_name, column_names, quoted
from .model import ROW, Table
from .operators.pieces import PieceTable
from .plans.gate import run_sql
from .sources import archives, delimited
from .sources.formats import READ_ONLY, detect, parse

_PARSED = "entry string, sheet_no int, sheet string, headers array<string>, widths array<double>, row long, cells array<string>, error string"


@dataclass(frozen=True)
class Sheet:
    file: str
    name: str
    view: str
    df: DataFrame
    widths: tuple[float, ...] = ()
    read_only: bool = False
    state: str = "virtual"
    #: The number of rows, where reading has told it.
    rows: int | None = None
    #: Whether a scan gives the rows in order of their numbers.
    in_order: bool = False
    #: Its edits, if there are any.
    pieces: PieceTable | None = None

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != ROW]


def _parse_files(kind: str | None, repair: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _PARSED.split(", ")]
        types = [pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.int64(), pa.list_(pa.string()), pa.string()]
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                base, data = path.rpartition("/")[2], content.as_py()
                items = archives.entries(data, base) if archives.archive_kind(base) and not kind else [("", data)]
                for entry, body in items:
                    out: list[list] = [[] for _ in names]
                    try:
                        tables = parse(body, entry or base, kind, repair)
                        error = None
                    except Exception as e:  # noqa: BLE001 - told to the caller as a row; one bad entry does not stop the others
                        tables, error = [], str(e) or type(e).__name__
                    for k, t in enumerate(x.widened() for x in tables):
                        width = len(t.headers)
                        for r, cells in enumerate([[], *t.rows], -1):  # row -1 stands for the sheet itself
                            for column, value in zip(out, (entry, k, t.name, t.headers if r < 0 else None, t.widths if r < 0 else None, r, (cells + [""] * width)[:width], None)):
                                column.append(value)
                    if error:
                        for column, value in zip(out, (entry, -1, None, None, None, -1, None, error)):
                            column.append(value)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    return run


class Catalog:
    """Files loaded, by name; every sheet is a temporary view sheet_<file>_<sheet> and "<file stem>.<sheet>"."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.files: dict[str, list[Sheet]] = {}
        self.paths: dict[str, str] = {}
        self.temps: dict[str, Sheet] = {}
        self.warnings: list[str] = []
        self._parsed: dict[str, DataFrame] = {}
        self._count = 0

    # Loading

    def load(self, path: str, kind: str | None = None, repair: bool = False, widen: bool = False) -> list[Sheet]:
        """The tables of a file of any format. Delimited text and Parquet are read by Spark in parallel and stay lazy; documents and archives are parsed by executors.

        widen: rows of delimited text that are wider than their header add columns; else the cells beyond it are cut, and warnings tell in how many rows.
        repair: of damaged workbooks, whatever can be read: files without a directory, sheets that are cut short, cells whose text is lost.
        """
        base = path.rstrip("/").rpartition("/")[2]
        found = kind or detect(base)
        stem = base.rpartition(".")[0] or base
        if not (archives.archive_kind(base) and not kind):
            if found in ("csv", "tsv"):
                got = delimited.read_counted(self.spark, path, "\t" if found == "tsv" else ",", widen=widen)
                if got and got.wide and not widen:
                    self.warnings.append(f"{base}: {got.wide} rows have more cells than the header, and lose them")
                return self._put(base, path, [(stem, got.df, (), got.rows, got.in_order)] if got else [], False)
            if found == "parquet":
                df = self.spark.read.parquet(path)
                df = df.withColumn(ROW, F.col("_metadata.row_index")).select(ROW, *[F.col(f"`{c}`") for c in df.columns])
                return self._put(base, path, [(stem, df, (), None, len(df.inputFiles()) == 1)], True)
        if base.lower().endswith(".zip.001"):
            return self._load_split(path, base)
        parsed = self.spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_parse_files(kind, repair), _PARSED).persist()
        sheets = parsed.filter("row = -1").select("entry", "sheet_no", "sheet", "headers", "widths", "error").orderBy("entry", "sheet_no").collect()  # a row per table
        bad = [s for s in sheets if s.error]
        self.warnings += [f"{base}{'::' + s.entry if s.entry else ''}: {s.error}" for s in bad]
        if bad and len(bad) == len(sheets):
            raise ValueError(self.warnings[-1])
        by_file: dict[str, list] = {}
        for s in sheets:
            if not s.error:
                names = column_names(s.headers)
                rows = parsed.filter((F.col("entry") == s.entry) & (F.col("sheet_no") == s.sheet_no) & (F.col("row") >= 0))
                df = rows.select(F.col("row").alias(ROW), *[F.get("cells", F.lit(k)).alias(n) for k, n in enumerate(names)])
                by_file.setdefault(f"{base}::{s.entry}" if s.entry else base, []).append((s.sheet, df, tuple(s.widths or ())))
        out = []
        for name, items in by_file.items() if by_file else [(base, [])]:
            out += self._put(name, path, items, bool(by_file) and (found or "") in READ_ONLY)
        self._forget(path)
        self._parsed[path] = parsed
        return out

    def _forget(self, path: str) -> None:
        if (old := self._parsed.pop(path, None)) is not None:
            old.unpersist()

    def _load_split(self, path: str, base: str) -> list[Sheet]:
        """Parts .001, .002, ... put together; they are read on the driver, as a ZIP file's directory is at its end."""
        rows = self.spark.read.format("binaryFile").load(path[:-3] + "[0-9][0-9][0-9]").select("path", "content").orderBy("path").collect()
        data = b"".join(bytes(r.content) for r in rows)
        out = []
        for entry, body in archives.entries(data, base[:-4]):
            out += self.register(f"{base[:-4]}::{entry}", parse(body, entry))
        return out

    # A folder that keeps the tables

    def has_store(self, path: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
        return target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(target)

    def save_store(self, path: str) -> None:
        """Writes every table as Parquet below path, and then the list of them, so an unfinished save leaves the last list as it was."""
        run, rows = uuid.uuid4().hex, []
        for k, s in enumerate(self.sheets()):
            s.df.write.parquet(f"{path}/tables/{run}-{k}")
            rows.append((k, s.file, s.name, self.paths.get(s.file, ""), f"tables/{run}-{k}", list(s.widths), s.read_only))
        schema = "place int, file string, sheet string, path string, data string, widths array<double>, read_only boolean"
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")

    def open_store(self, path: str) -> list[Sheet]:
        """The tables of save_store(), under their names."""
        schema = "place int, file string, sheet string, path string, data string, widths array<double>, read_only boolean"
        by_file: dict[str, list] = {}
        for r in self.spark.read.schema(schema).json(f"{path}/manifest").orderBy("place").collect():  # a row per table
            by_file.setdefault(r.file, []).append(r)
        out = []
        for file, sheets in by_file.items():
            out += self._put(file, sheets[0].path, [(r.sheet, self.spark.read.parquet(f"{path}/{r.data}"), tuple(r.widths or ())) for r in sheets], sheets[0].read_only)
        return out

    def register(self, name: str, tables: list[Table]) -> list[Sheet]:
        """Tables from memory."""
        items = []
        for t in (x.widened() for x in tables):
            names = column_names(t.headers)
            schema = ", ".join([f"{ROW} long", *[f"{quoted(n)} string" for n in names]])
            rows = [(i, *(r + [""] * len(names))[: len(names)]) for i, r in enumerate(t.rows)]
            items.append((t.name, self.spark.createDataFrame(rows, schema), tuple(t.widths)))
        return self._put(name, "", items, False)

    def _put(self, file: str, path: str, items: list, read_only: bool) -> list[Sheet]:
        self.drop(file)
        self._count += 1
        sheets = [Sheet(file, name, f"sheet_{self._count}_{k}", df, widths, read_only, rows=known[0] if known else None, in_order=bool(known and known[1])) for k, (name, df, widths, *known) in enumerate(items)]
        self.files[file], self.paths[file] = sheets, path
        for s in sheets:
            self._show(s)
        return sheets

    @staticmethod
    def alias(sheet: Sheet) -> str:
        return f"{sheet.file.rpartition('.')[0] or sheet.file}.{sheet.name}"

    def _show(self, sheet: Sheet) -> None:
        data = sheet.df.drop(ROW)
        for name in (sheet.view, self.alias(sheet)):
            data.createOrReplaceTempView(quoted(name))

    # Looking

    def sheets(self, file: str | None = None, sheet: str | None = None) -> list[Sheet]:
        found = [s for f, many in self.files.items() if file in (None, f) for s in many if sheet in (None, s.name)]
        if not found and (file or sheet):
            raise ValueError(f"no sheet {sheet!r} in {file!r}" if sheet else f"no file {file!r}")
        return found

    def one(self, file: str, sheet: str | None = None) -> Sheet:
        return self.sheets(file, sheet)[0]

    def tables(self) -> list[tuple[str, str, DataFrame]]:
        return [(s.file, s.name, s.df) for s in self.sheets()]

    def in_order(self) -> bool:
        """Whether scans of all tables give rows in order of their numbers."""
        return all(s.in_order for s in self.sheets())

    def list_files(self) -> DataFrame:
        rows = [(f, s.name, s.view, self.alias(s), s.columns, s.read_only, s.state) for f, many in self.files.items() for s in many]
        return self.spark.createDataFrame(rows, "file string, sheet string, table_name string, alias string, columns array<string>, read_only boolean, state string")

    def metadata(self, file: str) -> list[dict]:
        """What is known of a file's sheets. Rows of delimited text were counted as it was opened; those of Parquet are in its footers, and a count reads no column."""
        return [{"sheet": s.name, "columns": s.columns, "rows": s.df.count() if s.rows is None else s.rows, "widths": list(s.widths)} for s in self.sheets(file)]

    def relations(self) -> dict[str, str]:
        """Two-part names, in lower case, and their views."""
        return {self.alias(s).lower(): self.alias(s) for s in self.sheets()}

    def sql(self, text: str, limit: int | None = None) -> DataFrame:
        return run_sql(self.spark, text, limit, self.relations())

    # Changing: a sheet's edits are one piece table, and its DataFrame what that means.

    def _pieces(self, sheet: Sheet) -> PieceTable:
        if sheet.read_only:
            raise ValueError(f"{sheet.file} cannot be edited")
        return sheet.pieces or PieceTable.of(sheet.df, sheet.rows)

    def _replace(self, old: Sheet, pieces: PieceTable) -> None:
        new = replace(old, df=pieces.folded(), rows=pieces.count(), in_order=False, pieces=pieces)
        self.files[old.file] = [new if s is old else s for s in self.files[old.file]]
        self._show(new)

    def update_cell(self, file: str, sheet: str, row: int, column: str, value: str) -> None:
        s = self.one(file, sheet)
        self._replace(s, self._pieces(s).update_cell(row, column, value))

    def update_cells(self, file: str, sheet: str, updates: list[tuple[int, str, str]]) -> int:
        s = self.one(file, sheet)
        pieces, n = self._pieces(s).update_cells(updates)
        self._replace(s, pieces)
        return n

    def insert_rows(self, file: str, sheet: str, start: int, rows: list[list[str]]) -> None:
        s = self.one(file, sheet)
        self._replace(s, self._pieces(s).insert_rows(start, rows))

    def delete_rows(self, file: str, sheet: str, start: int, count: int) -> int:
        s = self.one(file, sheet)
        pieces, n = self._pieces(s).delete_rows(start, count)
        self._replace(s, pieces)
        return n

    def add_column(self, file: str, sheet: str, name: str, default: str = "") -> None:
        s = self.one(file, sheet)
        self._replace(s, self._pieces(s).add_column(name, default))

    def rename_column(self, file: str, sheet: str, old: str, new: str) -> None:
        s = self.one(file, sheet)
        self._replace(s, self._pieces(s).rename_column(old, new))

    # Session tables and states

    def materialize(self, file: str) -> None:
        """Keeps a file's tables in memory and on disk from their first use on."""
        self.files[file] = [replace(s, df=s.df.persist(), state="materialized") for s in self.sheets(file)]
        for s in self.files[file]:
            self._show(s)

    def materialize_query(self, name: str, sql: str, replace_old: bool = False, max_rows: int | None = None) -> int:
        """A session table of a query's result. The old table stays until the new one is whole."""
        check_table_name(name)
        key = name.lower()
        views = {v.lower() for s in self.sheets() for v in (s.view, self.alias(s))}
        if key in views:
            raise ValueError(f"{name} is an imported table")
        if key in self.temps and not replace_old:
            raise ValueError(f"there is a table {name}")
        df = self.sql(sql).persist()
        n = df.count()
        if max_rows is not None and n > max_rows:
            df.unpersist()
            raise ValueError(f"the query has {n} rows; {max_rows} are allowed")
        if key in self.temps:
            self.spark.catalog.dropTempView(self.temps[key].view)
            self.temps[key].df.unpersist()
        df.createOrReplaceTempView(name)
        self.temps[key] = Sheet("", name, name, df, state="materialized")
        return n

    def drop_temp_table(self, name: str) -> None:
        """Session tables alone can be dropped, never imported ones."""
        found = self.temps.pop(name.lower(), None)
        if found is None:
            raise ValueError(f"no session table {name!r}")
        self.spark.catalog.dropTempView(found.view)
        found.df.unpersist()

    def drop(self, file: str) -> None:
        for s in self.files.pop(file, []):
            for view in (s.view, self.alias(s)):
                self.spark.catalog.dropTempView(quoted(view)) or self.spark.catalog.dropTempView(view)
            if s.state == "materialized":
                s.df.unpersist()
        path = self.paths.pop(file, None)
        if path is not None and path not in self.paths.values():
            self._forget(path)

    def clear(self) -> None:
        for file in list(self.files):
            self.drop(file)
        for name in list(self.temps):
            self.drop_temp_table(name)
        self.paths.clear()
        self._count = 0

    def text_rows(self, sheet: Sheet) -> Iterator[list[str]]:
        """A sheet's rows in order, as text, one partition at a time on the driver."""
        ordered = sheet.df.orderBy(ROW).select(*[text_of(F.col(f"`{c}`")).alias(c) for c in sheet.columns])
        return (list(r) for r in ordered.toLocalIterator())
