import csv
import gzip
import io
import json
import random
import tarfile
import zipfile

import pytest

from gridsift import cli, sinks
from gridsift.catalog import Catalog
from gridsift.functions.dates import from_serial, with_dates
from gridsift.functions.encoding import decoded
from gridsift.mcp import serve
from gridsift.model import ROW, SearchQuery, Table
from gridsift.operators.search import search
from gridsift.queries import file_queries as fixtures
from gridsift.sources.archives import archive_kind, entries
from gridsift.sources.formats import detect, parse
from gridsift.sources.html import html_tables
from gridsift.sources.text import text_tables
from gridsift.tools import VERBS, Tools


def shape(tables):
    return [(t.name, t.headers, t.rows) for t in tables]


@pytest.fixture
def catalog(spark):
    made = Catalog(spark)
    yield made
    made.clear()


def test_names_and_dates():
    assert [detect(n) for n in ("a.CSV", "b.tab", "c.xlsx", "d", "e.md")] == ["csv", "tsv", "excel", None, "markdown"]
    assert [archive_kind(n) for n in ("a.zip", "a.tar.gz", "a.csv.gz", "a.zip.001", "a.xlsx")] == ["zip", "tar", "single", "zip", None]
    assert [from_serial(x) for x in (0.5, 59, 61, 45000, 45000.5, -1)] == ["12:00", "1900-02-28", "1900-03-01", "2023-03-15", "2023-03-15 12:00:00", None]
    assert with_dates(["Date", "Price"], [["45000", "45000"], ["45001", "1"]]) == [["2023-03-15", "45000"], ["2023-03-16", "1"]]
    assert decoded("中文表格数据".encode("gbk")) == "中文表格数据" and decoded(b"\xef\xbb\xbfx") == "x"


def test_html_repair():
    assert shape(html_tables("<table><td>a<td>b<tr><td>1<td>2</table>")) == [("Table_1", ["a", "b"], [["1", "2"]])]
    nested = html_tables("<table><tr><th>o</th></tr><tr><td><table><tr><td>i</td></tr></table></td></tr></table>")
    assert [t.headers for t in nested] == [["o"], ["i"]]
    assert html_tables("no table") == []


def test_text():
    jagged = text_tables("| a | b |\n| 1 | 2 | 3 |\n| 4 |\n", True)[0]
    assert (jagged.headers, jagged.rows) == (["a", "b", ""], [["1", "2", "3"], ["4", "", ""]])
    assert text_tables("just prose\nof two lines\n", False) == []
    assert parse(b"", "x.csv") == [] and parse(b"a,b\n", "x.csv")[0].rows == []


def test_archives():
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("d/a.csv", "x\n1\n")
        f.writestr("readme.bin", "no")
    assert [n for n, _ in entries(z.getvalue(), "t.zip")] == ["d/a.csv"]
    t = io.BytesIO()
    with tarfile.open(fileobj=t, mode="w:gz") as f:
        info = tarfile.TarInfo("b.tsv")
        info.size = 4
        f.addfile(info, io.BytesIO(b"x\n1\n"))
    assert [n for n, _ in entries(t.getvalue(), "t.tgz")] == ["b.tsv"]
    assert list(entries(gzip.compress(b"x\n1\n"), "c.csv.gz")) == [("c.csv", b"x\n1\n")]


def test_catalog_loads_everything(catalog, tmp_path):
    (tmp_path / "people.csv").write_text('name,Name,note\nAl,1,"two\nlines"\nBo,2\nCy,3,x,y\n', encoding="utf-8")
    (tmp_path / "gbk.csv").write_bytes("姓名,城市\n张三,北京\n".encode("gbk"))
    (tmp_path / "page.html").write_text(fixtures.HTML)
    (tmp_path / "book.xlsx").write_bytes(fixtures.xlsx_fixture())
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        z.writestr("in.csv", "k,v\n1,2\n")
        z.writestr("bad.xlsx", "not a workbook")
    for name in ("people.csv", "gbk.csv", "page.html", "book.xlsx", "all.zip"):
        catalog.load(str(tmp_path / name))
    people = catalog.one("people.csv")
    assert people.columns == ["name", "Name_2", "note"]
    assert [tuple(r) for r in people.df.orderBy(ROW).collect()] == [(0, "Al", "1", "two\nlines"), (1, "Bo", "2", ""), (2, "Cy", "3", "x")]
    assert catalog.one("gbk.csv").df.first()["城市"] == "北京"
    assert [s.name for s in catalog.sheets("page.html")] == ["Top", "Sum"]
    assert catalog.sql("SELECT Region FROM book.Data WHERE Amount = '30'").first()[0] == "华北"
    assert [s.file for s in catalog.sheets("all.zip::in.csv")] == ["all.zip::in.csv"] and any("bad.xlsx" in w for w in catalog.warnings)
    assert catalog.sql("SELECT count(*) FROM people.people").first()[0] == 3


def test_row_numbers_over_many_blocks(spark, tmp_path):
    from gridsift.sources.delimited import read_delimited

    (tmp_path / "long.csv").write_text("i\n" + "\n".join(map(str, range(20_000))) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        df = read_delimited(spark, str(tmp_path / "long.csv"))
        assert df.filter(f"cast(i as bigint) <> {ROW}").count() == 0 and df.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_delimited_rows_do_not_depend_on_size(spark, tmp_path):
    """Many small blocks, and one, give the rows of a plain parser of the whole text."""
    from gridsift.sources import delimited

    texts = {
        "quoted": "i,t\n" + "".join(f'{k},"first\nsecond ""{k}"", x"\n' if k % 7 == 0 else f"{k},plain\n" for k in range(3000)),
        "stray": 'i,t,u\n1,5" pipe,"open\nshut",7" pipe\n2,a,b\n',
        "even": 'i,t\n1,5" x,"open\n2,shut",7" y\n3,z\n',
        "blanks": "i,t\n1,a\n  \n2,b\n",
        "returns": "i,t\n1,a\rb\n2,b\n",
        "mixed": "i,t\n1,a\r\n2,b\r\n3,c\r\n",
        "old": "i,t\r1,a\r2,\"b\rc\"\r3,d",
        "wide": "i,t\n" + "".join(f"{k},{k}{',x' * (k % 4)}\n" for k in range(2000)),
        "wide and quoted": "i,t\n1\n\n" + "".join(f'{k},"{k}\n"{",x" * (k % 4)}\n' for k in range(900)),
        "long": "i,t\n" + f'1,"{"line of a long cell" + chr(10) * 2}{("word " * 9 + chr(10)) * 4000}"\n2,{"x" * 300_000}\n3,"end"',
        "open": 'i,t\n1,a\n2,"never shut\n3,b\n' * 1,
        "odd": "i,t,u\n" + "".join(random.Random(k).choice(['a,b,c', '"a",b', 'a,"b""', 'c"",d', '"x', 'y",z', '""', '"', ',"",', "e\rf", '"g"h,i', "", "\r"]) + random.Random(-k).choice(["\n", "\n", "\r\n"]) for k in range(6000)),
        "plain": "i,t\r\n" + "".join(f'{k},"a ""b"", c"\r\n{k},""\r\n' for k in range(3000)),
    }
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        for name, text in texts.items():
            path = str(tmp_path / f"{name}.csv")
            with open(path, "wb") as f:
                f.write(text.encode())
            parts = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
            width = max(map(len, parts))
            want = [(k, *(r + [""] * (width - len(r)))) for k, r in enumerate(parts[1:])]
            if name == "open":  # whether the file's last line has an end is not told by a scan of lines
                want[-1] = tuple(x.rstrip("\n") if isinstance(x, str) else x for x in want[-1])
            for size in ("4k", "64m"):
                spark.conf.set("spark.sql.files.maxPartitionBytes", size)
                made = delimited.read_counted(spark, path, widen=True)
                df, n = made.df, made.rows
                got = sorted(tuple(r) for r in df.collect())
                assert made.wide == sum(len(r) > len(parts[0]) for r in parts)
                narrow = delimited.read_delimited(spark, path)
                assert narrow.columns[1:] == df.columns[1 : len(parts[0]) + 1] and sorted(map(tuple, narrow.collect()))[:-1] == [r[: len(parts[0]) + 1] for r in want[:-1]]
                if name == "open":
                    got[-1] = tuple(x.rstrip("\n") if isinstance(x, str) else x for x in got[-1])
                assert got == want and n in (None, len(want)), (name, size)
                if size == "4k" and name in ("quoted", "plain", "long", "odd"):
                    assert df.rdd.getNumPartitions() > 3
            assert (delimited.plain_records(spark, path, ",", text[:100].encode()) is not None) == (name in ("plain", "wide")), name
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def test_delimited_encodings_and_long_cells(catalog, tmp_path):
    rows = [["姓名", "注"], *[[f"张{k}", "长" * 10 + "\n北京"] for k in range(400)], ["x", "很" * 200_000]]
    text = "\n".join(",".join(f'"{c}"' for c in r) for r in rows) + "\n"
    for name, code in (("a", "gbk"), ("b", "utf-16"), ("c", "utf-8-sig"), ("d", "utf-32"), ("e", "gb18030")):
        (tmp_path / f"{name}.csv").write_bytes(text.encode(code))
        (sheet,) = catalog.load(str(tmp_path / f"{name}.csv"))
        got = sheet.df.orderBy(ROW).collect()
        assert sheet.columns == rows[0] and [list(r)[1:] for r in got] == rows[1:] and [r[0] for r in got] == list(range(401)), code
        assert catalog.metadata(f"{name}.csv")[0]["rows"] == 401
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in.csv", "k,v\n1,2,3\n4," + "x" * 200_000 + "\n")
    (sheet,) = catalog.load(str(tmp_path / "z.zip"))
    assert [len(c) for c in sheet.df.orderBy(ROW).collect()[1][1:]] == [1, 200_000, 0]
    (tmp_path / "w.csv").write_text("k,v\n1,2,3\n4,5\n")
    catalog.load(str(tmp_path / "w.csv"))
    assert catalog.warnings[-1] == "w.csv: 1 rows have more cells than the header, and lose them"
    (sheet,) = catalog.load(str(tmp_path / "w.csv"), widen=True)
    assert sorted(map(tuple, sheet.df.collect())) == [(0, "1", "2", "3"), (1, "4", "5", "")]


def test_encoding_of_late_bytes(catalog, tmp_path):
    plain = "k,v\n" + "".join(f"{k},plain text\n" for k in range(6000))
    for name, text in {"gbk": "北京数据", "shift_jis": "データの表ｱｲｳ", "windows-1252": "naïve “quote” €", "utf-8": "é北"}.items():
        data = (plain + f"6000,{text}\n").encode(name)
        assert len(data) > 1 << 16 and not data[: 1 << 16].count(b"\xe5")
        (tmp_path / f"late_{name}.csv").write_bytes(data)
        catalog.load(str(tmp_path / f"late_{name}.csv"))
        assert catalog.one(f"late_{name}.csv").df.filter("k = '6000'").first()["v"] == decoded(data).rpartition(",")[2].strip(), name
    assert catalog.one("late_gbk.csv").df.filter("v = '北京数据'").count() == 1


def test_temp_tables_and_edits(catalog):
    catalog.register("data.csv", [Table("Sheet1", ["name", "value"], [["Alice", "100"], ["Bob", "200"], ["Charlie", "300"]])])
    assert catalog.materialize_query("Big", "SELECT * FROM sheet_1_0 WHERE value::int > 150;") == 2
    with pytest.raises(ValueError):
        catalog.materialize_query("big", "SELECT 1")
    with pytest.raises(ValueError):
        catalog.materialize_query("big", "SELECT * FROM sheet_1_0", True, max_rows=1)
    assert catalog.sql("SELECT count(*) FROM big").first()[0] == 2
    catalog.drop_temp_table("BIG")
    for bad in ("big", "sheet_1_0"):
        with pytest.raises(ValueError):
            catalog.drop_temp_table(bad)
    assert catalog.delete_rows("data.csv", "Sheet1", 0, 1) == 1
    assert [r.name for r in catalog.sql("SELECT name FROM data.Sheet1").collect()] == ["Bob", "Charlie"]


def test_tools_sinks_and_cli(catalog, tmp_path, capsys):
    assert len(VERBS) == 19
    catalog.register("d.csv", [Table("S", ["a", "b"], [["x", "1"], ["y", "2.5"], ["x", ""]])])
    tools = Tools(catalog)
    out = tools.run(json.dumps([{"tool": "search", "args": {"query": "x", "limit": 1}}, {"tool": "get_sheet_statistics", "args": {"file": "d.csv", "sheet": "S"}}, {"tool": "execute_sql", "args": {"sql": "SELECT a, count(*) n FROM d.S GROUP BY a ORDER BY a", "limit": 1}}]))
    assert out[0]["truncated"] and out[0]["matches"] == 2 and out[1][0]["top"][0] == ["x", 2] and out[2] == {"columns": ["a", "n"], "rows": [["x", "2"]], "truncated": True}
    with pytest.raises(ValueError):
        tools.call("_rows", {})
    path = str(tmp_path / "out.xlsx")
    tools.save_as("d.csv", path)
    assert shape(parse(open(path, "rb").read(), "out.xlsx")) == [("S", ["a", "b"], [["x", "1"], ["y", "2.5"], ["x", ""]])]
    with pytest.raises(ValueError):
        tools.export_query("SELECT 1 AS a WHERE false", path)
    assert list(sinks.rendered(["a"], [["1|2"]], "markdown")) == ["| a |", "|---|", "| 1\\|2 |"]
    assert sinks.highlighted("aXa", ["a", "a"], "<", ">") == "<a>X<a>"
    assert cli.expanded("echo ${a} $$5", {"a": "it's"}) == "echo 'it'\"'\"'s' $5"
    with pytest.raises(ValueError):
        cli.expanded("${b}", {"a": ""})
    said = io.StringIO()
    cli.prompt(catalog, ["SELECT a FROM d.S\n", "ORDER BY a LIMIT 1;\n", ".let t SELECT 1 AS one\n", "SELECT nope;\n", ".quit\n"], said)
    assert "x" in said.getvalue() and "1 rows" in said.getvalue() and "error" in said.getvalue()
    assert cli.condition("age >= 3").operator == ">="


def test_rows_wider_than_their_header_are_found(catalog, tmp_path):
    (tmp_path / "jag.html").write_text("<table><tr><th>a<th>b<tr><td>1<td>2<td>needle<tr><td>3</table>")
    (sheet,) = catalog.load(str(tmp_path / "jag.html"))
    assert sheet.columns == ["a", "b", "column"]
    (hit,) = search(catalog.tables(), SearchQuery("needle")).collect()
    assert (hit.row_index, hit.matched_columns) == (0, ["column"])


def test_a_header_longer_than_the_first_look(catalog, tmp_path):
    names = [f"column_{'x' * 600}_{i}" for i in range(200)]
    (tmp_path / "wide.csv").write_text(",".join(names) + "\n" + ",".join(map(str, range(200))) + "\n")
    (sheet,) = catalog.load(str(tmp_path / "wide.csv"))
    assert sheet.columns == names and sheet.df.first()[-1] == "199"


def test_every_row_of_a_query_is_exported(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "SHEET_ROWS", 40)
    assert sinks.export_query(spark.range(100).selectExpr("id", "'x' AS t"), str(tmp_path / "q.xlsx")) == 100
    tables = parse((tmp_path / "q.xlsx").read_bytes(), "q.xlsx")
    assert [(t.name, len(t.rows), t.headers) for t in tables] == [("Query", 40, ["id", "t"]), ("Query_2", 40, ["id", "t"]), ("Query_3", 20, ["id", "t"])]
    assert [r[0] for t in tables for r in t.rows] == [str(i) for i in range(100)]
    with pytest.raises(ValueError):
        sinks.export_query(spark.range(0), str(tmp_path / "none.xlsx"))


def test_damaged_workbooks(catalog, tmp_path):
    whole = fixtures.xlsx_fixture()
    want = shape(parse(whole, "b.xlsx"))
    cut = whole[: whole.index(b"PK\x01\x02")]  # the directory is lost
    with pytest.raises(zipfile.BadZipFile):
        parse(cut, "b.xlsx")
    assert shape(parse(cut, "b.xlsx", repair=True)) == want == shape(parse(whole, "b.xlsx", repair=True))
    z = io.BytesIO()
    rows = "".join(f'<row r="{r}"><c r="A{r}" t="s"><v>{r - 1}</v></c><c r="B{r}"><v>{r}</v></c></row>' for r in range(1, 400))
    with zipfile.ZipFile(z, "w", zipfile.ZIP_DEFLATED) as f:
        f.writestr("xl/worksheets/sheet1.xml", f"<worksheet><sheetData>{rows}")
        f.writestr("xl/sharedStrings.xml", "<sst><si><t>head</t></si><si><t>one</t></si><si><t>tw")
    (table,) = parse(z.getvalue(), "b.xlsx", repair=True)
    # A merge, the end of the sheet, its name and most texts are gone; what is there is read.
    assert (table.name, table.headers, len(table.rows), table.rows[0], table.rows[5]) == ("Sheet1", ["head", "1"], 398, ["one", "2"], ["", "7"])
    (tmp_path / "bad.xlsx").write_bytes(cut)
    assert [s.name for s in catalog.load(str(tmp_path / "bad.xlsx"), repair=True)] == [want[0][0]]


def test_a_folder_keeps_the_tables(spark, catalog, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,x\n2,y\n")
    catalog.load(str(tmp_path / "a.csv"))
    catalog.update_cell("a.csv", "a", 1, "v", "new")
    catalog.save_store(str(tmp_path / "store"))
    again = Catalog(spark)
    assert again.has_store(str(tmp_path / "store")) and not again.has_store(str(tmp_path / "none"))
    (sheet,) = again.open_store(str(tmp_path / "store"))
    assert (sheet.file, sheet.name, sheet.columns) == ("a.csv", "a", ["k", "v"]) and [r.v for r in sheet.df.orderBy(ROW).collect()] == ["x", "new"]
    again.save_store(str(tmp_path / "store"))
    assert [r.v for r in again.open_store(str(tmp_path / "store"))[0].df.orderBy(ROW).collect()] == ["x", "new"]
    again.clear()


def test_tools_over_json_lines(catalog, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,x\n2,y\n")
    calls = [
        {"id": 1, "method": "initialize"},
        {"method": "notifications/initialized"},
        {"id": 2, "method": "tools/list"},
        {"id": 3, "method": "tools/call", "params": {"name": "import_file", "arguments": {"path": str(tmp_path / "a.csv")}}},
        {"id": 4, "method": "tools/call", "params": {"name": "search", "arguments": {"query": "y"}}},
        {"id": 5, "method": "tools/call", "params": {"name": "execute_sql", "arguments": {"sql": "DROP TABLE x"}}},
        {"id": 6, "method": "tools/call", "params": {"name": "_rows"}},
        {"id": 7, "method": "other"},
    ]
    out = [json.loads(x) for x in serve(Tools(catalog), [*map(json.dumps, calls), "", "{"])]
    assert [x.get("id") for x in out] == [1, 2, 3, 4, 5, 6, 7, None]
    tools = {t["name"]: t["inputSchema"] for t in out[1]["result"]["tools"]}
    assert set(tools) == set(VERBS) and tools["search"]["required"] == ["query"] and tools["search"]["properties"]["limit"] == {"type": "integer"} and tools["insert_rows"]["properties"]["rows"] == {"type": "array"}
    assert json.loads(out[3]["result"]["content"][0]["text"])["matches"] == 1 and not out[3]["result"]["isError"]
    assert out[4]["result"]["isError"] and [x["error"]["code"] for x in out[5:]] == [-32602, -32601, -32700]
