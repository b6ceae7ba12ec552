"""Formats by file name, and the parser of each."""

from __future__ import annotations

from ..model import Table

# Endings of file names.
ENDINGS = {
    "csv": ("csv",),
    "tsv": ("tsv", "tab"),
    "html": ("html", "htm"),
    "text": ("txt",),
    "markdown": ("md", "markdown"),
    "dbf": ("dbf",),
    "xml": ("xml",),
    "docx": ("docx",),
    "pptx": ("pptx",),
    "pdf": ("pdf",),
    "parquet": ("parquet",),
    "excel": ("xlsx", "xls", "xlsm", "xlsb", "ods"),
}
#: Formats whose tables cannot be edited in place.
READ_ONLY = ("docx", "pptx", "pdf", "parquet")


def detect(name: str) -> str | None:
    ending = name.rpartition(".")[2].lower() if "." in name else ""
    return next((kind for kind, endings in ENDINGS.items() if ending in endings), None)


def parse(data: bytes, name: str, kind: str | None = None, repair: bool = False) -> list[Table]:
    """The tables in a file's bytes. kind overrides what the name says; unknown endings are tried as workbooks. repair: of damaged xlsx workbooks, what can be read."""
    from ..functions.encoding import decoded
    from . import delimited, html, office, records, text

    kind, stem = kind or detect(name) or "excel", name.rpartition("/")[2].rpartition(".")[0]
    if kind in ("csv", "tsv"):
        return delimited.parse(decoded(data), "\t" if kind == "tsv" else ",", stem)
    if kind == "html":
        return html.html_tables(decoded(data))
    if kind in ("text", "markdown"):
        return text.text_tables(decoded(data), kind == "markdown")
    if kind == "dbf":
        return records.dbf_tables(data, stem)
    if kind == "xml":
        return records.xml_tables(data, stem)
    if kind == "docx":
        return office.docx_tables(data)
    if kind == "pptx":
        return office.pptx_tables(data)
    if kind == "excel":
        if data[:4] == b"\xd0\xcf\x11\xe0" or name.lower().endswith(".xlsb"):
            raise ValueError(f"{name}: binary workbooks need a library that is not at hand")
        return office.ods_tables(data) if name.lower().endswith(".ods") else office.xlsx_tables(data, repair)
    if kind == "parquet":
        import io

        import pyarrow.parquet as pq

        found = pq.read_table(io.BytesIO(data))
        columns = [["" if v is None else str(v) for v in c.to_pylist()] for c in found.columns]
        return [Table(stem, found.column_names, [list(r) for r in zip(*columns)])]
    raise ValueError(f"{name}: no reader for {kind}")
