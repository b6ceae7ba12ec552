"""Tables of dBase files and of plain XML."""

from __future__ import annotations

import datetime as dt
import struct
from xml.etree import ElementTree as ET

from ..functions.encoding import decoded
from ..model import Table


def dbf_tables(data: bytes, name: str) -> list[Table]:
    """Fields in the file's order; deleted rows and rows without any value are left out."""
    count, begin, size = struct.unpack("<IHH", data[4:12])
    fields, at = [], 32
    while at + 32 <= begin and data[at] != 0x0D:
        title = data[at : at + 11].split(b"\0")[0].decode("latin-1")
        fields.append((title, chr(data[at + 11]), data[at + 16], data[at + 17]))
        at += 32
    rows = []
    for k in range(count):
        raw = data[begin + k * size : begin + (k + 1) * size]
        if len(raw) < size or raw[:1] == b"*":
            continue
        row, pos = [], 1
        for _, kind, width, decimals in fields:
            row.append(_dbf_value(raw[pos : pos + width], kind, decimals))
            pos += width
        if any(row):
            rows.append(row)
    return [Table(name, [f[0] for f in fields], rows)] if fields and rows else []


def _dbf_value(raw: bytes, kind: str, decimals: int) -> str:
    if kind in "NF":
        text = raw.decode("ascii", "replace").strip(" \0")
        try:
            value = float(text)
        except ValueError:
            return ""
        return str(int(value)) if value == int(value) else repr(value)
    if kind == "L":
        return {b"T": "TRUE", b"t": "TRUE", b"Y": "TRUE", b"y": "TRUE", b"F": "FALSE", b"f": "FALSE", b"N": "FALSE", b"n": "FALSE"}.get(raw, "")
    if kind == "D":
        text = raw.decode("ascii", "replace")
        return f"{text[:4]}-{text[4:6]}-{text[6:]}" if text.isdigit() and len(text) == 8 else ""
    if kind == "I" and len(raw) == 4:
        return str(struct.unpack("<i", raw)[0])
    if kind == "B" and len(raw) == 8:
        return repr(struct.unpack("<d", raw)[0])
    if kind == "Y" and len(raw) == 8:
        return f"{struct.unpack('<q', raw)[0] / 10_000:.2f}"
    if kind in "T@" and len(raw) == 8:
        day, ms = struct.unpack("<ii", raw)
        return (dt.datetime(1970, 1, 1) + dt.timedelta(days=day - 2_440_588, milliseconds=ms)).strftime("%Y-%m-%d %H:%M:%S") if day else ""
    return decoded(raw).strip(" \0")


def xml_tables(data: bytes, name: str) -> list[Table]:
    """The root's children with the tag of the first are rows, the tags of the first row's children the columns. Rows of text alone have one column,
    "value". Attributes do not count; empty rows are left out.
    """
    try:
        root = ET.fromstring(data)
    except ET.ParseError:
        root = ET.fromstring(decoded(data).encode())
    bare = lambda n: n.tag.rpartition("}")[2]
    rows = [n for n in root if isinstance(n.tag, str) and bare(n) == bare(root[0])]
    if not rows:
        return []
    columns = list(dict.fromkeys(bare(c) for c in rows[0])) or ["value"]
    flat = columns == ["value"] and not len(rows[0])
    cells = [[("".join(r.itertext())).strip()] if flat else [next(("".join(c.itertext()).strip() for c in r if bare(c) == k), "") for k in columns] for r in rows]
    cells = [r for r in cells if any(r)]
    return [Table(name, columns, cells)] if cells else []
