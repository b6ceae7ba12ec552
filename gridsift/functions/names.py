"""Names of columns, schemas and session tables."""

from __future__ import annotations

import re

# Names that a session table may not take.
RESERVED = ("files", "sheets", "main", "temp", "information_schema", "pg_catalog", "sqlite_master", "sqlite_sequence", "sqlite_schema", "sqlite_temp_master")
SYSTEM_SCHEMAS = ("main", "information_schema", "pg_catalog", "sys")


def column_names(headers: list[str]) -> list[str]:
    """Headers as column names: an empty one is "column", and names that differ in case alone get _2, _3, ..."""
    taken: set[str] = set()
    names = []
    for header in headers:
        stem = header or "column"
        name, k = stem, 1
        while name.lower() in taken:
            k += 1
            name = f"{stem}_{k}"
        taken.add(name.lower())
        names.append(name)
    return names


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def schema_name(name: str) -> str:
    """Letters, digits and _ stay, all else becomes _; system schemas get a prefix."""
    plain = "".join(c if c.isalnum() or c == "_" else "_" for c in name)
    return f"file_{plain}" if plain.lower() in SYSTEM_SCHEMAS else plain


def check_table_name(name: str) -> None:
    """Raises ValueError unless name may be that of a session table."""
    if not name:
        raise ValueError("a table needs a name")
    if len(name) > 64:
        raise ValueError("a table's name has 64 characters at most")
    if name.startswith("sheet_"):
        raise ValueError("names that start with sheet_ belong to imported tables")
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError("a table's name starts with a letter or _, and has letters, digits and _ alone")
    if name.lower() in RESERVED:
        raise ValueError(f"{name} is a reserved name")
