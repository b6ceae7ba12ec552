"""Tables that go on over pages, as readers of paged documents hand them in."""

from __future__ import annotations

from ..model import Table


def merged(tables: list[tuple[int, Table]]) -> list[Table]:
    """(page, table)s in order as Table_1, Table_2, ...: a table of the last one's width on the next page goes on with it. A header that repeats the first one is
    left out, any other is a row.
    """
    runs: list[tuple[int, Table]] = []
    for page, t in tables:
        if runs and page == runs[-1][0] + 1 and len(t.headers) == len(runs[-1][1].headers):
            last = runs.pop()[1]
            t = Table(last.name, last.headers, [*last.rows, *([] if t.headers == last.headers else [t.headers]), *t.rows], last.widths)
        runs.append((page, t))
    return [Table(f"Table_{i}", t.headers, t.rows, t.widths) for i, (_, t) in enumerate(runs, 1)]
