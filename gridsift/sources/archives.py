"""Archives: their entries as (name, bytes)."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import re
import tarfile
import zipfile
from collections.abc import Iterator

from .formats import detect

# Endings of archive names.
TARS = (".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tbz2", ".tar.xz", ".txz", ".tar.zst")
SINGLE = (".gz", ".bz2", ".xz", ".zst")


def archive_kind(name: str) -> str | None:
    """"zip", "tar" or "single"; Office documents are none, though they are ZIP files."""
    low = name.lower()
    if low.endswith(TARS):
        return "tar"
    if low.endswith(".zip") or re.search(r"\.zip\.\d{3}$", low):
        return "zip"
    return "single" if low.endswith(SINGLE) else None


def is_table_entry(name: str) -> bool:
    base = name.rpartition("/")[2]
    return bool(base) and not base.startswith((".", "~$")) and "__MACOSX" not in name and detect(base) is not None


def _unzstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().stream_reader(data).read()


def entries(data: bytes, name: str) -> Iterator[tuple[str, bytes]]:
    """The entries that may hold tables. An entry that cannot be read is left out."""
    kind, low = archive_kind(name), name.lower()
    if kind == "zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                if not info.is_dir() and is_table_entry(info.filename):
                    try:
                        yield info.filename, z.read(info)
                    except (zipfile.BadZipFile, RuntimeError, NotImplementedError):
                        continue
    elif kind == "tar":
        with tarfile.open(fileobj=io.BytesIO(_unzstd(data) if low.endswith(".zst") else data)) as t:
            for member in t:
                if member.isfile() and is_table_entry(member.name):
                    yield member.name, t.extractfile(member).read()
    elif kind == "single":
        inner = name.rpartition("/")[2].rpartition(".")[0]
        if is_table_entry(inner):
            yield inner, {".gz": gzip.decompress, ".bz2": bz2.decompress, ".xz": lzma.decompress, ".zst": _unzstd}[low[low.rindex(".") :]](data)
