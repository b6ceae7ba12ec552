"""What queries and catalogs are made of."""

from __future__ import annotations

from dataclasses import dataclass, field

#: The column that numbers a table's rows from 0, header not counted.
ROW = "_row_idx"

MODES = ("fulltext", "exact", "wildcard", "regex")
OPERATORS = ("=", "==", "!=", "<>", "LIKE", "ILIKE", ">", "<", ">=", "<=")


@dataclass(frozen=True)
class Condition:
    column: str
    operator: str
    value: str

    def __post_init__(self):
        if self.operator.upper() not in OPERATORS:
            raise ValueError(f"unknown operator {self.operator!r}; known: {', '.join(OPERATORS)}")


@dataclass(frozen=True)
class SearchQuery:
    """column, sheet: search there alone. context_lines: rows to show before and after each match. conditions: all must hold besides."""

    text: str
    column: str | None = None
    mode: str = "fulltext"
    limit: int | None = None
    sheet: str | None = None
    invert: bool = False
    context_lines: int = 0
    conditions: tuple[Condition, ...] = field(default=())

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}; known: {', '.join(MODES)}")


@dataclass(frozen=True)
class Table:
    """A table that a parser found: all cells are text."""

    name: str
    headers: list[str]
    rows: list[list[str]]
    widths: list[float] = field(default_factory=list)

    def widened(self) -> Table:
        """The same table with as many headers as its widest row has cells, and every row filled up to that: no cell is cut off."""
        width = max([len(self.headers), *map(len, self.rows)])
        return Table(self.name, self.headers + [""] * (width - len(self.headers)), [r + [""] * (width - len(r)) for r in self.rows], self.widths)
