"""Tables of Markdown and of plain-text reports."""

from __future__ import annotations

import re
from statistics import median

from ..model import Table

_RULE = re.compile(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")


def _cells(line: str) -> list[str]:
    body = line.strip().removeprefix("|")
    body = body[:-1] if body.endswith("|") and not body.endswith("\\|") else body
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", body)]


def markdown_tables(text: str) -> list[Table]:
    """Pipe tables outside code fences, with or without a rule below the header; named by the last heading, else Table_n."""
    found, heading, fenced, block = [], "", False, []

    def close():
        if len(block) >= 2:
            rows = [_cells(x) for x in block]
            rule = len(block) > 1 and "|" in block[1] and _RULE.match(block[1])
            body = rows[2:] if rule else rows[1:]
            if rule or len(rows[0]) > 1:
                found.append(Table(heading or f"Table_{len(found) + 1}", rows[0], body).widened())
        block.clear()

    for line in text.splitlines():
        if line.lstrip().startswith("```"):
            close()
            fenced = not fenced
        elif fenced:
            continue
        elif "|" in line and line.strip():
            block.append(line)
        else:
            close()
            if m := re.match(r"^\s{0,3}#{1,6}\s+(.*?)\s*#*\s*$", line):
                heading = m[1] or heading
    close()
    return found


def _is_dashes(line: str) -> bool:
    bare = line.strip()
    return len(bare) >= 3 and bare.count("-") >= 2 and not bare.strip("- ")


def _is_tildes(line: str) -> bool:
    bare = line.strip()
    return len(bare) >= 3 and not bare.strip("~")


def _cut(line: str, starts: list[int]) -> list[str]:
    return [line[a:b].strip() for a, b in zip(starts, [*starts[1:], max(len(line), starts[-1])])]


def _ruled(body: list[str]) -> tuple[list[str], list[list[str]]] | None:
    """A table whose columns a line of dashes shows. Lines of the header are joined by column."""
    at = next((i for i, x in enumerate(body) if _is_dashes(x)), None)
    if not at:
        return None
    starts = [m.start() for m in re.finditer("-+", body[at])]
    above = at
    while above and body[above - 1].strip():
        above -= 1
    parts = [_cut(x, starts) for x in body[above:at]]
    headers = [" ".join(p[k] for p in parts if p[k]) for k in range(len(starts))]
    rows = []
    for line in body[at + 1 :]:
        if not line.strip() or _is_dashes(line):
            if rows and not line.strip():
                break
            continue
        rows.append(_cut(line, starts))
    return (headers, rows) if rows and any(headers) else None


def _aligned(body: list[str]) -> tuple[list[str], list[list[str]]] | None:
    """A table without a rule: most lines have the same number of words, at about the same places, and the first is no row of numbers."""
    lines = [[(m.start(), m.group()) for m in re.finditer(r"\S+", x)] for x in body if x.strip()]
    if len(lines) < 3:
        return None
    counts = [len(x) for x in lines]
    mode = max(set(counts), key=lambda c: (counts.count(c), c))
    like = [x for x in lines if len(x) == mode]
    if mode < 2 or len(like) * 2 < len(lines) or len(like) < 3:
        return None
    places = [median(x[k][0] for x in like) for k in range(mode)]
    if any(abs(x[k][0] - places[k]) > 12 for x in like for k in range(mode)):
        return None
    headers = [w for _, w in like[0]]
    if all(re.fullmatch(r"[-+]?[\d.,%]+", w) for w in headers):
        return None
    return headers, [[w for _, w in x] for x in like[1:]]


def report_tables(text: str) -> list[Table]:
    """Sections have their title on the line before a line of tildes, and hold a table with a line of dashes, or one that shows by its alignment.
    Text without such sections is one section.
    """
    lines = text.splitlines()
    marks = [i for i, x in enumerate(lines) if _is_tildes(x)]
    sections = []
    if marks:
        for k, at in enumerate(marks):
            end = marks[k + 1] - 1 if k + 1 < len(marks) else len(lines)
            sections.append((lines[at - 1].strip() if at else f"Section_{k + 1}", lines[at + 1 : end]))
    else:
        sections.append(("", lines))
    found = []
    for title, body in sections:
        while body:
            if got := _ruled(body):
                found.append(Table(title or f"Table_{len(found) + 1}", *got))
                at = next(i for i, x in enumerate(body) if _is_dashes(x))
                end = next((i for i in range(at + 1 + len(got[1]), len(body)) if not body[i].strip()), len(body))
                body = body[end + 1 :]
            else:
                if (got := _aligned(body)) and title:
                    found.append(Table(title, *got))
                break
    return found


def text_tables(text: str, markdown: bool) -> list[Table]:
    """Markdown without a single pipe is read as a report."""
    return markdown_tables(text) if markdown and "|" in text else report_tables(text)
