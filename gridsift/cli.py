"""Command line: search, SQL, lists, JSON calls, and a small SQL prompt."""

from __future__ import annotations

import argparse
import json
import os
import re
import shlex
import subprocess
import sys

from . import sinks
from .catalog import Catalog
from .mcp import serve
from .model import Condition, SearchQuery
from .operators.search import search, value_counts
from .session import session
from .tools import SQL_ROWS, Tools

_CONDITION = re.compile(r"^(.*?)\s*(<=|>=|<>|!=|==|=|<|>|\bI?LIKE\b)\s*(.*)$", re.I)


def condition(text: str) -> Condition:
    m = _CONDITION.match(text)
    if not m:
        raise ValueError(f"not a condition: {text!r}")
    return Condition(m[1].strip(), m[2].upper(), m[3].strip())


def expanded(template: str, row: dict[str, str]) -> str:
    """${name} becomes the row's value, quoted for the shell; $$ is a dollar sign. An unknown name is an error."""

    def put(m: re.Match) -> str:
        if m[0] == "$$":
            return "$"
        if m[1] not in row:
            raise ValueError(f"no column {m[1]!r}")
        return shlex.quote(row[m[1]])

    return re.sub(r"\$\$|\$\{([^}]*)\}", put, template)


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gridsift", description="Search and query the tables in files.")
    p.add_argument("files", nargs="*", help="files; --as FORMAT holds for all")
    p.add_argument("--as", dest="kind", help="read all files as this format")
    p.add_argument("-q", "--query", help="text to search for")
    p.add_argument("-c", "--column")
    p.add_argument("-s", "--sheet")
    p.add_argument("-m", "--mode", default="fulltext")
    p.add_argument("-v", "--invert", action="store_true")
    p.add_argument("-C", "--context", type=int, default=0)
    p.add_argument("-w", "--where", action="append", default=[], help="a further condition: column operator value")
    p.add_argument("-g", "--group", help="count this column's values in what is found")
    p.add_argument("-x", "--sql")
    p.add_argument("-l", "--limit", type=int)
    p.add_argument("-t", "--tables", action="store_true", help="list tables")
    p.add_argument("-r", "--repair", action="store_true")
    p.add_argument("-f", "--format", default="table")
    p.add_argument("-e", "--export", help="write the result to this folder as CSV")
    p.add_argument("-X", "--exec", dest="calls", help="JSON calls; - reads them from the input")
    p.add_argument("-E", "--run", help="shell command for each row; needs --allow-shell")
    p.add_argument("--allow-shell", action="store_true")
    p.add_argument("-i", "--interactive", action="store_true")
    p.add_argument("--mcp", action="store_true", help="serve the tools over JSON-RPC lines on standard input and output")
    p.add_argument("--store", help="a folder that keeps the tables: those in it are opened first, and all are written back at the end")
    return p


def show(df, form: str, out=None) -> None:
    rows = ([str(x) for x in r] for r in sinks.as_text(df.toDF(*[f"c{k}" for k in range(len(df.columns))])).collect())
    for line in sinks.rendered(df.columns, rows, form):
        print(line, file=out or sys.stdout)


def main(args: list[str] | None = None) -> int:
    """0, or 1 if something failed."""
    a = arguments().parse_args(args)
    catalog = Catalog(session(master=os.environ.get("GRIDSIFT_MASTER")))
    try:
        if a.store and catalog.has_store(a.store):
            catalog.open_store(a.store)
        for path in a.files:
            catalog.load(path, a.kind, a.repair)
        for warning in catalog.warnings:
            print(warning, file=sys.stderr)
        if a.mcp:
            for line in serve(Tools(catalog), sys.stdin):
                print(line, flush=True)
        elif a.calls:
            text = sys.stdin.read() if a.calls == "-" else a.calls
            print(json.dumps(Tools(catalog).run(text), ensure_ascii=False, default=str))
        elif a.tables:
            show(catalog.list_files(), a.format)
        elif a.interactive:
            prompt(catalog, sys.stdin, sys.stdout)
        elif a.sql or a.query is not None:
            if a.sql:
                df = catalog.sql(a.sql, a.limit)
            else:
                found = search(catalog.tables(), SearchQuery(a.query, a.column, a.mode, a.limit, a.sheet, a.invert, a.context, tuple(map(condition, a.where))), catalog.in_order())
                df = sinks.results_table(found)
                if a.group:
                    df = value_counts(df, a.group)
            if a.run:
                return run_each(df, a.run, a.allow_shell)
            if a.export:
                sinks.write_csv(df, a.export)
            else:
                show(df, a.format)
        if a.store:
            catalog.save_store(a.store)
        return 0
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def run_each(df, template: str, allowed: bool) -> int:
    """A shell command per row, on the driver, in order. Rows whose command fails are told and counted."""
    if not allowed:
        raise ValueError("shell commands need --allow-shell")
    failed = 0
    for r in sinks.as_text(df).toLocalIterator():
        try:
            print(subprocess.run(expanded(template, r.asDict()), shell=True, check=True, capture_output=True, text=True).stdout, end="")
        except (ValueError, subprocess.CalledProcessError) as e:
            failed += 1
            print(f"error: {e}", file=sys.stderr)
    return int(failed > 0)


HELP = """.help  .tables  .files  .history  .quit
.output FILE  results go to FILE as CSV; .output alone ends that
.save FILE    the last result as csv, json, tsv or table, by the file's ending
.let NAME SQL a session table; .drop NAME removes it
SQL ends with ;"""


def prompt(catalog: Catalog, lines, out) -> None:
    """The SQL prompt over any lines: commands start with a dot, statements end with a semicolon."""
    history, last, pending, target = [], None, "", None
    for line in lines:
        line = line.rstrip("\n")
        try:
            if not pending and line.startswith("."):
                history.append(line)
                name, _, rest = line.partition(" ")
                if name == ".quit":
                    break
                elif name == ".help":
                    print(HELP, file=out)
                elif name == ".history":
                    print(*history, sep="\n", file=out)
                elif name in (".tables", ".files"):
                    show(catalog.list_files().select("file", "sheet", "table_name", "alias"), "table", out)
                elif name == ".output":
                    target = rest.strip() or None
                elif name == ".let":
                    table, _, sql = rest.strip().partition(" ")
                    print(f"{catalog.materialize_query(table, sql, True)} rows", file=out)
                elif name == ".drop":
                    catalog.drop_temp_table(rest.strip())
                elif name == ".save":
                    if last is None:
                        raise ValueError("there is no result to save")
                    ending = rest.rpartition(".")[2]
                    with open(rest.strip(), "w", encoding="utf-8") as f:
                        show(last, ending if ending in ("json", "tsv", "table") else "csv", f)
                else:
                    raise ValueError(f"no command {name}")
                continue
            pending += line + "\n"
            if pending.rstrip().endswith(";"):
                sql, pending = pending.strip().rstrip(";"), ""
                history.append(sql)
                last = catalog.sql(sql, SQL_ROWS)
                if target:
                    with open(target, "w", encoding="utf-8") as f:
                        show(last, "csv", f)
                else:
                    show(last, "table", out)
        except ValueError as e:
            print(f"error: {e}", file=out)


if __name__ == "__main__":
    sys.exit(main())
