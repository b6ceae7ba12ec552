"""Tables of Office documents: xlsx and ods workbooks, docx, pptx. All are ZIP files of XML."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from ..functions.dates import with_dates
from ..model import Table

MOST_ROWS = 1_048_576


def _bare(tag: str) -> str:
    return tag.rpartition("}")[2]


def _kids(node: ET.Element, *names: str) -> list[ET.Element]:
    """Descendants by a path of bare names."""
    found = [node]
    for name in names:
        found = [c for n in found for c in n if _bare(c.tag) == name]
    return found


def _attr(node: ET.Element | None, name: str) -> str | None:
    return None if node is None else next((v for k, v in node.attrib.items() if _bare(k) == name), None)


def _place(ref: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", ref).groups()
    column = 0
    for c in letters:
        column = column * 26 + ord(c) - 64
    return int(digits) - 1, column - 1


def number_text(raw: str) -> str:
    """A stored number as people write it: 30.0 is 30."""
    try:
        x = float(raw)
    except ValueError:
        return raw
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def _filled(grid: dict[tuple[int, int], str], merges: list[tuple[tuple[int, int], tuple[int, int]]], header: int) -> None:
    """Copies a merged region's first cell to all of it, but not into the header row."""
    for (r0, c0), (r1, c1) in merges:
        value = grid.get((r0, c0), "")
        for r in range(r0, min(r1, MOST_ROWS) + 1):
            for c in range(c0, c1 + 1):
                if r > header and (r, c) != (r0, c0):
                    grid[r, c] = value


def _as_table(name: str, grid: dict[tuple[int, int], str], merges: list, dates: set[int] = frozenset(), widths: list[float] = ()) -> Table | None:
    """Null for sheets of fewer than two rows."""
    if not grid:
        return None
    top, bottom = min(r for r, _ in grid), max(r for r, _ in grid)
    left, right = min(c for _, c in grid), max(c for _, c in grid)
    _filled(grid, merges, top)
    right = max(right, *(c for _, c in grid))
    rows = [[grid.get((r, c), "") for c in range(left, right + 1)] for r in range(top, bottom + 1)]
    if len(rows) < 2:
        return None
    return Table(name, rows[0], with_dates(rows[0], rows[1:], {c - left for c in dates}), list(widths))


_DATE_FORMATS = {*range(14, 23), 27, 28, 29, 30, 31, 34, 35, 36, *range(45, 48), 50, 57}


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ET.fromstring(book.read("xl/styles.xml"))
    custom = {int(n.get("numFmtId", 0)) for n in _kids(root, "numFmts", "numFmt") if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", n.get("formatCode", "").lower()))}
    return {i for i, xf in enumerate(_kids(root, "cellXfs", "xf")) if int(xf.get("numFmtId", 0)) in _DATE_FORMATS | custom}


class Salvaged:
    """Entries of a ZIP file whose directory or end is lost, found by their own headers; of each, what can be unpacked."""

    def __init__(self, data: bytes):
        self.parts: dict[str, bytes] = {}
        at = 0
        while (at := data.find(b"PK\x03\x04", at)) >= 0 and at + 30 <= len(data):
            flags, method = int.from_bytes(data[at + 6 : at + 8], "little"), int.from_bytes(data[at + 8 : at + 10], "little")
            size, n, more = int.from_bytes(data[at + 18 : at + 22], "little"), int.from_bytes(data[at + 26 : at + 28], "little"), int.from_bytes(data[at + 28 : at + 30], "little")
            begin = at + 30 + n + more
            name = data[at + 30 : at + 30 + n].decode("utf-8", "replace")
            if method == 0:
                end = begin + size if size or not flags & 8 else data.find(b"PK", begin)
                body = data[begin : end if end >= 0 else len(data)]
            else:
                body = self.inflated(data, begin)
            self.parts.setdefault(name, body)
            at = begin

    @staticmethod
    def inflated(data: bytes, begin: int, step: int = 512) -> bytes:
        """What a deflated stream gives up to its end or to where it is broken."""
        reader, out = zlib.decompressobj(-15), []
        for at in range(begin, len(data), step):
            try:
                out.append(reader.decompress(data[at : at + step]))
            except zlib.error:
                break
            if reader.eof:
                break
        return b"".join(out)

    def namelist(self) -> list[str]:
        return list(self.parts)

    def read(self, name: str) -> bytes:
        return self.parts[name]

    def open(self, name: str) -> io.BytesIO:
        return io.BytesIO(self.parts[name])


def _started(data: bytes, tag: str) -> list[ET.Element]:
    """The elements of a name that are whole, also where the text after them is cut short."""
    found = []
    try:
        for _, node in ET.iterparse(io.BytesIO(data), ("end",)):
            if _bare(node.tag) == tag:
                found.append(node)
    except ET.ParseError:
        pass
    return found


def xlsx_tables(data: bytes, repair: bool = False) -> list[Table]:
    """Every worksheet that can be read, in the workbook's order. Rows are read one by one; sheets that are broken are left out, or with
    repair read as far as they go, also where the file's directory, its list of sheets or some of its texts are lost."""
    book = Salvaged(data) if repair else zipfile.ZipFile(io.BytesIO(data))
    names = set(book.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.iter() if _bare(t.tag) == "t") for si in (_started(book.read("xl/sharedStrings.xml"), "si") if repair else _kids(ET.fromstring(book.read("xl/sharedStrings.xml")), "si"))]
    try:
        targets = {r.get("Id"): r.get("Target", "") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))} if "xl/_rels/workbook.xml.rels" in names else {}
        dated = _date_styles(book)
        listed = [(sheet.get("name", f"Sheet{k + 1}"), targets.get(_attr(sheet, "id"), f"worksheets/sheet{k + 1}.xml")) for k, sheet in enumerate(_kids(ET.fromstring(book.read("xl/workbook.xml")), "sheets", "sheet"))]
    except (KeyError, ET.ParseError, ValueError):
        if not repair:
            raise
        dated = set()
        numbers = sorted(int(m[1]) for n in names if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n)))
        listed = [(f"Sheet{k}", f"worksheets/sheet{k}.xml") for k in numbers]
    found = []
    for name, target in listed:
        path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        try:
            table = _worksheet(book, path, name, shared, dated, repair)
        except (KeyError, ET.ParseError, ValueError, IndexError, zipfile.BadZipFile):
            continue
        if table:
            found.append(table)
    return found


def _events(part, repair: bool) -> Iterator[tuple[str, ET.Element]]:
    """Elements as they begin and end; with repair, up to where the text is broken."""
    try:
        yield from ET.iterparse(part, ("start", "end"))
    except ET.ParseError:
        if not repair:
            raise


def _worksheet(book: zipfile.ZipFile, path: str, name: str, shared: list[str], dated: set[int], repair: bool = False) -> Table | None:
    grid: dict[tuple[int, int], str] = {}
    merges, dates, widths, row, column = [], set(), [], -1, -1
    with book.open(path) as part:
        for event, node in _events(part, repair):
            tag = _bare(node.tag)
            if event == "start":
                if tag == "row":
                    row, column = int(node.get("r", row + 2)) - 1, -1
                continue
            if tag == "c" and row < MOST_ROWS:
                r, column = _place(node.get("r")) if node.get("r") else (row, column + 1)
                kind = node.get("t", "n")
                raw = next((v.text or "" for v in _kids(node, "v")), "")
                if kind == "s" and raw:
                    value = "" if repair and not (raw.isdigit() and int(raw) < len(shared)) else shared[int(raw)]
                elif kind == "inlineStr":
                    value = "".join(t.text or "" for t in node.iter() if _bare(t.tag) == "t")
                elif kind == "b":
                    value = "true" if raw == "1" else "false"
                else:
                    value = number_text(raw) if kind == "n" else raw
                    if kind == "n" and raw and int(node.get("s", 0)) in dated:
                        dates.add(column)
                if value:
                    grid[r, column] = value
            elif tag == "row":
                node.clear()
            elif tag == "mergeCell":
                a, _, b = node.get("ref", "").partition(":")
                merges.append((_place(a), _place(b or a)))
            elif tag == "col":
                width = 0.0 if node.get("hidden") in ("1", "true") else float(node.get("width", 0))
                widths += [width] * min(int(node.get("max", 1)) - int(node.get("min", 1)) + 1, 16384 - len(widths))
    return _as_table(name, grid, merges, dates, widths)


def ods_tables(data: bytes) -> list[Table]:
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("content.xml"))
    found = []
    for sheet in (n for n in root.iter() if _bare(n.tag) == "table"):
        grid, r = {}, 0
        for row in (n for n in sheet.iter() if _bare(n.tag) == "table-row"):
            c = 0
            for cell in (n for n in row if _bare(n.tag) in ("table-cell", "covered-table-cell")):
                times = int(_attr(cell, "number-columns-repeated") or 1)
                text = "\n".join("".join(p.itertext()) for p in _kids(cell, "p"))
                if text:
                    for k in range(times):
                        grid[r, c + k] = text
                c += times
            r += int(_attr(row, "number-rows-repeated") or 1)
        if table := _as_table(_attr(sheet, "name") or f"Sheet{len(found) + 1}", grid, []):
            found.append(table)
    return found


def _texts(node: ET.Element, paragraph: str) -> str:
    lines = ["".join(t.text or "" for t in p.iter() if _bare(t.tag) == "t") for p in node.iter() if _bare(p.tag) == paragraph]
    return "\n".join(x for x in lines if x.strip()).strip()


def docx_tables(data: bytes) -> list[Table]:
    """Top-level tables, named by the heading or title before them (each names one table), else Table_n. A cell over several columns repeats, one merged downwards fills; tables of a header alone are left out."""
    body = _kids(ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")), "body")
    found, heading, n = [], "", 0
    for node in body[0] if body else ():
        if _bare(node.tag) == "p":
            style = next((_attr(s, "val") or "" for s in _kids(node, "pPr", "pStyle")), "")
            if re.match(r"(?i)heading|title", style):
                heading = _texts(node, "p") or heading
        elif _bare(node.tag) == "tbl":
            n += 1
            rows: list[list[str]] = []
            for tr in _kids(node, "tr"):
                row: list[str] = []
                for tc in _kids(tr, "tc"):
                    span = int(next((_attr(g, "val") or 1 for g in _kids(tc, "tcPr", "gridSpan")), 1))
                    merge = next(iter(_kids(tc, "tcPr", "vMerge")), None)
                    below = merge is not None and (_attr(merge, "val") or "continue") == "continue"
                    above = rows[-1][len(row)] if below and rows and len(row) < len(rows[-1]) else ""
                    row += [above if below else _texts(tc, "p")] * span
                rows.append(row)
            if len(rows) > 1:
                found.append(Table(heading or f"Table_{n}", rows[0], rows[1:]))
                heading = ""
    return found


def _slide_rows(tbl: ET.Element) -> list[list[str]]:
    """A slide table's rows. Cells over several columns or rows repeat; writers mark the covered places by merge cells, or leave them out."""
    on = lambda tc, name: tc.get(name) in ("1", "true")
    width = len(_kids(tbl, "tblGrid", "gridCol"))
    rows: list[list[str]] = []
    below: dict[int, tuple[str, int]] = {}  # column: text, and over how many more rows it reaches
    for tr in _kids(tbl, "tr"):
        cells = _kids(tr, "tc")
        spans = []
        for k, tc in enumerate(cells):
            marked = k + 1 < len(cells) and on(cells[k + 1], "hMerge")
            spans.append(1 if marked or on(tc, "hMerge") else int(tc.get("gridSpan", 1)))
        # Covered places without merge cells: as many as the row is too short, against the grid or the rows above.
        missing = max([width, *map(len, rows)]) - sum(spans)
        row: list[str] = []
        for tc, span in zip(cells, spans):
            while missing > 0 and len(row) in below:
                row.append(below[len(row)][0])
                missing -= 1
            at = len(row)
            if on(tc, "hMerge"):
                row.append(row[-1] if row else "")
            elif on(tc, "vMerge"):
                row.append(rows[-1][at] if rows and at < len(rows[-1]) else "")
            else:
                row += [_texts(tc, "p")] * span
                for c in range(at, at + span):
                    below[c] = (row[at], int(tc.get("rowSpan", 1)))
        while missing > 0 and len(row) in below:
            row.append(below[len(row)][0])
            missing -= 1
        rows.append(row)
        below = {c: (text, left - 1) for c, (text, left) in below.items() if left > 1}
    return rows


def pptx_tables(data: bytes) -> list[Table]:
    """Tables of all slides in their order, as Slide_n_Table_m. Cells over several columns or rows repeat."""
    deck = zipfile.ZipFile(io.BytesIO(data))
    slides = sorted((int(m[1]), name) for name in deck.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", name)))
    found = []
    for number, name in slides:
        for m, tbl in enumerate((x for x in ET.fromstring(deck.read(name)).iter() if _bare(x.tag) == "tbl"), 1):
            rows = _slide_rows(tbl)
            if len(rows) > 1:
                found.append(Table(f"Slide_{number}_Table_{m}", rows[0], rows[1:]))
    return found


def write_xlsx(sheets: Iterator[tuple[str, list[str], Iterator[list[str]]]], path: str) -> None:
    """Sheets (name, headers, rows) as a workbook; cells that are numbers are written as numbers. Rows are streamed, one sheet at a time."""
    from xml.sax.saxutils import escape, quoteattr

    def letters(c: int) -> str:
        out = ""
        while c >= 0:
            out, c = chr(65 + c % 26) + out, c // 26 - 1
        return out

    def cell(r: int, c: int, text: str) -> str:
        ref = f"{letters(c)}{r}"
        if re.fullmatch(r"-?(0|[1-9]\d{0,14})(\.\d+)?([eE][+-]?\d+)?", text):
            return f'<c r="{ref}"><v>{text}</v></c>'
        clean = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text)
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(clean)}</t></is></c>'

    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    names: list[str] = []
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        for name, headers, rows in sheets:
            clean = re.sub(r"[\[\]:*?/\\]", "_", name)[:31] or "Sheet"
            while clean.lower() in [n.lower() for n in names]:
                clean = f"{clean[:28]}_{len(names)}"
            names.append(clean)
            with book.open(f"xl/worksheets/sheet{len(names)}.xml", "w") as part:
                part.write(f'{head}<worksheet xmlns="{main}"><sheetData>'.encode())
                part.write(("<row r=\"1\">" + "".join(f'<c r="{letters(c)}1" t="inlineStr"><is><t>{escape(h)}</t></is></c>' for c, h in enumerate(headers)) + "</row>").encode())
                for r, row in enumerate(rows, 2):
                    part.write((f'<row r="{r}">' + "".join(cell(r, c, x) for c, x in enumerate(row) if x) + "</row>").encode())
                part.write(b"</sheetData></worksheet>")
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(names) + 1))
        book.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
        book.writestr("_rels/.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(names, 1)) + "</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1)) + "</Relationships>")
