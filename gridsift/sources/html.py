"""Tables of HTML. A tolerant reader builds a small tree, with the end tags that writers leave out; tables are taken from that."""

from __future__ import annotations

from html.parser import HTMLParser

from ..model import Table

#: An opening tag ends these open elements, up to the named boundaries.
_CLOSES = {
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "p": ({"p"}, {"td", "th", "table", "div", "li"}),
    "li": ({"li"}, {"ul", "ol"}),
}
_VOID = {"br", "hr", "img", "input", "meta", "link", "col", "area", "base", "source", "wbr"}
_SECTIONS = ("table", "thead", "tbody", "tfoot")


class _Node:
    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def walk(self):
        todo = [iter(self.children)]
        while todo:
            for child in todo[-1]:
                yield child
                if isinstance(child, _Node):
                    todo.append(iter(child.children))
                    break
            else:
                todo.pop()

    def text(self) -> str:
        return "".join(x for x in self.walk() if isinstance(x, str)).strip()


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        ends, stops = _CLOSES.get(tag, (set(), set()))
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in stops:
                break
            if self.open[i].tag in ends:
                cut = i
                while cut > 1 and self.open[cut - 1].tag in ends and self.open[cut - 1].tag not in stops:
                    cut -= 1
                del self.open[cut:]
                break
        if tag in ("td", "th") and self.open[-1].tag in _SECTIONS:  # a bare cell opens its row
            self._push("tr", {})
        self._push(tag, dict(attrs))
        if tag in _VOID:
            self.open.pop()

    def _push(self, tag, attrs):
        node = _Node(tag, attrs)
        self.open[-1].children.append(node)
        self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag == "table" and tag in ("td", "th", "tr"):
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def html_tables(text: str) -> list[Table]:
    """Every table in document order, nested ones too: named by its summary, else the last h3 before it, else Table_n.

    The first row with th cells is the header; a row with one th has it as first cell. Without th the first row is the header.
    """
    reader = _Reader()
    reader.feed(text)
    reader.close()
    found, heading, n = [], "", 0
    for node in reader.root.walk():
        if not isinstance(node, _Node):
            continue
        if node.tag == "h3":
            heading = node.text() or heading
        elif node.tag == "table":
            n += 1
            headers: list[str] = []
            rows = []
            for tr in (x for x in node.walk() if isinstance(x, _Node) and x.tag == "tr"):
                cells = [x for x in tr.walk() if isinstance(x, _Node) and x.tag in ("td", "th")]
                heads, datas = [c.text() for c in cells if c.tag == "th"], [c.text() for c in cells if c.tag == "td"]
                if heads and not headers:
                    headers = heads
                elif datas:
                    rows.append(heads + datas if len(heads) == 1 else datas)
            if not headers and rows:
                headers = rows.pop(0)
            if headers:
                found.append(Table(node.attrs.get("summary") or heading or f"Table_{n}", headers, rows))
    return found
