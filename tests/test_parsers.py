"""Pure parsers: what tolerant readers of HTML, Markdown and text reports must make of unruly input."""

import pytest

from gridsift.model import Table
from gridsift.sources.html import html_tables
from gridsift.sources.pages import merged
from gridsift.sources.text import text_tables

HTML = {
    "a fragment of rows": ("<table><tr><th>fish<th>kg<tr><td>cod<td>4", [("Table_1", ["fish", "kg"], [["cod", "4"]])]),
    "sections": ("<table><thead><tr><th>a</th></tr></thead><tbody><tr><td>1</td></tr></tbody><tfoot><tr><td>sum</td></tr></tfoot></table>", [("Table_1", ["a"], [["1"], ["sum"]])]),
    "sections left open": ("<table><thead><tr><th>a<tbody><tr><td>1<tfoot><tr><td>2</table>", [("Table_1", ["a"], [["1"], ["2"]])]),
    "bare cells": ("<table><th>a<th>b<tr><td>1<td>2</table>", [("Table_1", ["a", "b"], [["1", "2"]])]),
    "colspan is one cell": ("<table><tr><th colspan=2>a</th><th>b</th></tr><tr><td colspan=3>x</td></tr></table>", [("Table_1", ["a", "b"], [["x"]])]),
    "entities": ("<table><tr><th>a&nbsp;b<th>&lt;i&gt;<tr><td>&#233;&amp;&eacute;<td>&copy</table>", [("Table_1", ["a\xa0b", "<i>"], [["é&é", "©"]])]),
    "markup in cells": ("<table><tr><th><b>a</b> <i>b</i><tr><td>x<br>y<td><a href='u'>link</a></table>", [("Table_1", ["a b"], [["xy", "link"]])]),
    "a head cell for each row": ("<table><tr><th>k<th>v<tr><th>one<td>1<tr><th>two<td>2</table>", [("Table_1", ["k", "v"], [["one", "1"], ["two", "2"]])]),
    "no head cells": ("<table><tr><td>k<td>v<tr><td>1<td>2</table>", [("Table_1", ["k", "v"], [["1", "2"]])]),
    "jagged": ("<table><tr><th>a<th>b<tr><td>1<tr><td>1<td>2<td>3</table>", [("Table_1", ["a", "b"], [["1"], ["1", "2", "3"]])]),
    "nested": ("<table><tr><th>o<tr><td>x<table><tr><th>i<tr><td>y</table></table>", [("Table_1", ["o"], None), ("Table_2", ["i"], [["y"]])]),
    "names": ("<h3>First</h3><table><tr><th>a</table><table summary='Own'><tr><th>b</table><h3>Next</h3><table><tr><th>c</table>", [("First", ["a"], []), ("Own", ["b"], []), ("Next", ["c"], [])]),
    "an empty table": ("<table></table><table><tr></tr></table><table><tr><th>a</table>", [("Table_3", ["a"], [])]),
    "upper case and odd spaces": ("<TABLE ><TR ><TH >A</TH ><tr\n><TD\t>1</TABLE>", [("Table_1", ["A"], [["1"]])]),
    "comments and scripts": ("<!-- <table> --><script>'<table>'</script><table><tr><th>a<!-- x --><tr><td>1</table>", [("Table_1", ["a"], [["1"]])]),
    "text that is no table": ("<p>x</p>", []),
    "end tags without a beginning": ("</td></tr></table><table><tr><th>a</th></th></tr></tr><tr><td>1</table></table>", [("Table_1", ["a"], [["1"]])]),
    "paragraphs in cells": ("<table><tr><th><p>a<tr><td><p>1<p>2<td>3</table>", [("Table_1", ["a"], [["12", "3"]])]),
    "lists in cells": ("<table><tr><th>a<tr><td><ul><li>1<li>2</ul><td>3</table>", [("Table_1", ["a"], [["12", "3"]])]),
}


@pytest.mark.parametrize("name", HTML)
def test_html(name):
    text, want = HTML[name]
    got = html_tables(text)
    assert [(t.name, t.headers) for t in got] == [w[:2] for w in want]
    assert all(w[2] is None or t.rows == w[2] for t, w in zip(got, want))


MARKDOWN = {
    "aligned": ("|a|b|\n|:-:|--:|\n|1|2|\n", [("Table_1", ["a", "b"], [["1", "2"]])]),
    "without outer pipes": ("a | b\n--- | ---\n1 | 2\n", [("Table_1", ["a", "b"], [["1", "2"]])]),
    "without a rule": ("|a|b|\n|1|2|\n", [("Table_1", ["a", "b"], [["1", "2"]])]),
    "empty cells": ("|a|b|c|\n|-|-|-|\n||x||\n", [("Table_1", ["a", "b", "c"], [["", "x", ""]])]),
    "jagged": ("|a|b|\n|-|-|\n|1|\n|1|2|3|4|\n", [("Table_1", ["a", "b", "", ""], [["1", "", "", ""], ["1", "2", "3", "4"]])]),
    "fences": ("```\n|no|table|\n|1|2|\n```\n|a|b|\n|-|-|\n|1|2|\n", [("Table_1", ["a", "b"], [["1", "2"]])]),
    "headings": ("# One\n|a|b|\n|-|-|\n|1|2|\n\n## Two ##\ntext\n\n|c|d|\n|-|-|\n|3|4|\n", [("One", ["a", "b"], [["1", "2"]]), ("Two", ["c", "d"], [["3", "4"]])]),
    "a pipe that is text": ("|a|b|\n|-|-|\n|x\\|y|z|\n", [("Table_1", ["a", "b"], [["x|y", "z"]])]),
    "one line": ("| a | b |\n", []),
}


@pytest.mark.parametrize("name", MARKDOWN)
def test_markdown(name):
    text, want = MARKDOWN[name]
    assert [(t.name, t.headers, t.rows) for t in text_tables(text, True)] == want


def test_reports():
    text = "Stock\n~~~~~\nitem      kg   note\n-------- ---  -----\nrope       4  dry\ntar       12\n\nNext\n~~~~\nday  wet  dry\nmon    1    2\ntue    3    4\n"
    got = [(t.name, t.headers, t.rows) for t in text_tables(text, False)]
    assert got == [("Stock", ["item", "kg", "note"], [["rope", "4", "dry"], ["tar", "12", ""]]), ("Next", ["day", "wet", "dry"], [["mon", "1", "2"], ["tue", "3", "4"]])]
    assert text_tables("", False) == [] == text_tables("~~~\n", False)


def test_tables_over_pages():
    page = lambda number, headers, *rows: (number, Table("", headers, [list(r) for r in rows]))
    got = merged([page(1, ["k", "v"], ("a", "1")), page(2, ["k", "v"], ("b", "2"), ("c", "3")), page(3, ["d", "4"]), page(3, ["e", "5"]), page(4, ["one"], ("x",)), page(6, ["one"])])
    assert [(t.name, t.headers, t.rows) for t in got] == [("Table_1", ["k", "v"], [["a", "1"], ["b", "2"], ["c", "3"], ["d", "4"]]), ("Table_2", ["e", "5"], []), ("Table_3", ["one"], [["x"]]), ("Table_4", ["one"], [])]
    assert merged([]) == []
