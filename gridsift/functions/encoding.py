"""Text from bytes of unknown encoding."""

from __future__ import annotations

import re

# Encodings tried in this order after UTF-8 and a declared charset.
FALLBACKS = ("gbk", "gb18030", "big5", "shift_jis", "euc-jp", "euc-kr", "windows-1252", "iso-8859-1")

_DECLARED = re.compile(rb"charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.I)


# Byte-order marks. That of UTF-32 begins as that of UTF-16 does.
MARKS = {b"\xff\xfe\x00\x00": "utf-32", b"\x00\x00\xfe\xff": "utf-32", b"\xff\xfe": "utf-16", b"\xfe\xff": "utf-16"}


def marked(data: bytes) -> str | None:
    """The encoding that a byte-order mark of more than eight bits tells."""
    return next((name for mark, name in MARKS.items() if data.startswith(mark)), None)


def candidates(data: bytes) -> list[str]:
    """Encodings to try, in order, for a file that begins with data."""
    declared = _DECLARED.search(data[:4096])
    return ["utf-8", *([declared[1].decode("ascii")] if declared else []), *FALLBACKS]


def readable(data: bytes, name: str) -> bool:
    try:
        data.decode(name)
        return True
    except (UnicodeDecodeError, LookupError):
        return False


def encoding_of(data: bytes) -> str:
    """The first encoding that reads data."""
    return next((n for n in candidates(data) if readable(data, n)), "utf-8")


def decoded(data: bytes) -> str:
    if data.startswith(b"\xef\xbb\xbf"):
        data = data[3:]
    return data.decode(marked(data) or encoding_of(data), "replace")
