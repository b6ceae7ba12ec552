"""SQL text as tokens: enough to rewrite names and clauses without touching literals, quoted names or comments."""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""(?P<comment>--[^\n]*|/\*.*?\*/)
      |(?P<string>'(?:[^'\\]|\\.|'')*')
      |(?P<quoted>"(?:[^"]|"")*"|`(?:[^`]|``)*`)
      |(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)
      |(?P<word>[^\W\d]\w*)
      |(?P<space>\s+)
      |(?P<sign>::|->>|->|<>|!=|<=|>=|\|\||.)""",
    re.X | re.S,
)


@dataclass
class Token:
    kind: str
    text: str
    depth: int = 0

    def word(self) -> str:
        return self.text.upper() if self.kind == "word" else ""


def tokens(sql: str) -> list[Token]:
    """All tokens; depth counts the brackets around each (a bracket itself has the depth outside it)."""
    out, depth = [], 0
    for m in _TOKEN.finditer(sql):
        t = Token(m.lastgroup or "sign", m.group())
        if t.kind == "sign" and t.text in ")]":
            depth -= 1
        t.depth = depth
        if t.kind == "sign" and t.text in "([":
            depth += 1
        out.append(t)
    return out


def joined(parts: list[Token]) -> str:
    return "".join(t.text for t in parts)


def solid(parts: list[Token]) -> list[int]:
    """Places of the tokens that are neither space nor comment."""
    return [i for i, t in enumerate(parts) if t.kind not in ("space", "comment")]
