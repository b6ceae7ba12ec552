"""Extraction of tables from documents, readers and writers, session tables, streams."""

from __future__ import annotations

import io
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions.dates import serial_date
from ..functions.extract import extract_cells
from ..model import ROW, SearchQuery
from ..operators.profile import union_all
from ..operators.search import search
from ..session import shared_dir
from ..sinks import results_table, write_csv, write_json
from ..streaming.windows import search_stream, sessions, windowed_counts
from .tables import numbered, table

MARKDOWN = """# Boats
| Boat | Berths | Harbour |
|:---|---:|---|
| Petrel | 6 | Oban |
| Wren | 4 |
| Gannet | 8 | Wick | spare key |

```
| not | a table |
```
## Tides
| hour | metres |
|---|---|
| a\\|b | 1.9 |
"""
REPORT = """Harbour dues
~~~~~~~~~~~~
Berth          Crowns
------         -----
North quay     118.40
Long pier      96.05

Wind by hour
~~~~~~~~~~~~
hour   knots   gusts
 06      11      17
 07      13      21
"""
HTML = "<h3>Top</h3><table><tr><th>A<th>B<tr><td>1<td>x &amp; y<tr><th>r</th><td>2</td></table><table summary='Sum'><tr><td>h<td>g<tr><td>3<td>4</table>"
XML = "<fleet><boat id='1'><Vessel>Marlin</Vessel><Berth>41</Berth></boat><boat><Vessel>Tern</Vessel></boat><boat/></fleet>"
TSV = "Berth\tCargo\n17\t\"rope\ttar\"\n23\n"
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"


def _zip(**parts: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), body)
    return out.getvalue()


def docx_fixture() -> bytes:
    cell = lambda t, more="": f"<w:tc><w:tcPr>{more}</w:tcPr><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    rows = [cell("Quay") + cell("Depth"), cell("East", '<w:vMerge w:val="restart"/>') + cell("3.2"), cell("", "<w:vMerge/>") + cell("4.7"), cell("closed", '<w:gridSpan w:val="2"/>')]
    head = '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Soundings</w:t></w:r></w:p>'
    return _zip(word__document_dot_xml=f'<w:document xmlns:w="{W}"><w:body>{head}<w:tbl>{"".join(f"<w:tr>{r}</w:tr>" for r in rows)}</w:tbl></w:body></w:document>')


def pptx_fixture() -> bytes:
    """Two slides: covered places marked by merge cells, and left out."""
    cell = lambda t, more="": f"<a:tc {more}><a:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></a:txBody></a:tc>"
    marked = [cell("Crew", 'gridSpan="2"') + cell("", 'hMerge="1"') + cell("Days"), cell("Ada", 'rowSpan="2"') + cell("mate") + cell("12"), cell("", 'vMerge="1"') + cell("cook") + cell("9")]
    bare = [cell("Crew", 'gridSpan="2"') + cell("Days"), cell("Bo", 'rowSpan="2"') + cell("mate") + cell("5"), cell("cook") + cell("6")]
    slide = lambda rows: f'<p:sld xmlns:p="p" xmlns:a="{A}"><a:tbl>{"".join(f"<a:tr>{r}</a:tr>" for r in rows)}</a:tbl></p:sld>'
    return _zip(ppt__slides__slide1_dot_xml=slide(marked), ppt__slides__slide2_dot_xml=slide(bare))


def xlsx_fixture() -> bytes:
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rows = [("A1", "Region"), ("B1", "Order Date"), ("C1", "Amount"), ("A2", "华北"), ("B2", 45000), ("C2", 1.5), ("B3", 45001), ("C3", 30), ("B4", 59), ("C4", 7)]
    body = {}
    for ref, v in rows:
        xml = f'<c r="{ref}"><v>{v}</v></c>' if not isinstance(v, str) else f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
        body.setdefault(ref[1:], []).append(xml)
    sheet = "".join(f'<row r="{r}">{"".join(c)}</row>' for r, c in body.items())
    return _zip(
        xl__workbook_dot_xml=f'<workbook {main} xmlns:r="r"><sheets><sheet name="Data" sheetId="1" r:id="rId1"/></sheets></workbook>',
        xl__worksheets__sheet1_dot_xml=f'<worksheet {main}><sheetData>{sheet}</sheetData><mergeCells><mergeCell ref="A2:A4"/></mergeCells></worksheet>',
    )


def dbf_fixture() -> bytes:
    fields = [(b"VESSEL", b"C", 10, 0), (b"METRES", b"N", 8, 2), (b"AFLOAT", b"L", 1, 0), (b"BUILT", b"D", 8, 0)]
    rows = [b" Marlin       41.00T19870517", b" Tern          7.25F        "]
    size = len(rows[0])
    head = bytes([3, 124, 1, 1]) + len(rows).to_bytes(4, "little") + (32 + 32 * len(fields) + 1).to_bytes(2, "little") + size.to_bytes(2, "little") + bytes(20)
    for n, t, w, d in fields:
        head += n.ljust(11, b"\0") + t + bytes(4) + bytes([w, d]) + bytes(14)
    return head + b"\r" + b"".join(r.ljust(size) for r in rows)


def _cells(kind: str, content: str | bytes):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.createDataFrame([(1, content)], f"id int, content {'string' if isinstance(content, str) else 'binary'}")
        return extract_cells(df, id_col="id", content_col="content", kind=kind).select("sheet", "row", "col", "name", "value")

    return run


def _values(rows: list[tuple]) -> str:
    text = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    body = ", ".join(f"({', '.join(map(text, r))})" for r in rows)
    return f"SELECT sheet, CAST(row AS BIGINT) AS row, CAST(col AS INTEGER) AS col, name, value FROM (VALUES {body}) v(sheet, row, col, name, value)"


def _grid(*tables: tuple[str, list[str], list[list[str]]]) -> str:
    return _values([(sheet, r, c, headers[c], v) for sheet, headers, rows in tables for r, row in enumerate(rows) for c, v in enumerate(row)])


FIXTURES = {
    "extract_markdown": ("markdown", MARKDOWN, _grid(("Boats", ["Boat", "Berths", "Harbour", "column"], [["Petrel", "6", "Oban", ""], ["Wren", "4", "", ""], ["Gannet", "8", "Wick", "spare key"]]), ("Tides", ["hour", "metres"], [["a|b", "1.9"]]))),
    "extract_text": ("text", REPORT, _grid(("Harbour dues", ["Berth", "Crowns"], [["North quay", "118.40"], ["Long pier", "96.05"]]), ("Wind by hour", ["hour", "knots", "gusts"], [["06", "11", "17"], ["07", "13", "21"]]))),
    "extract_html": ("html", HTML, _grid(("Top", ["A", "B"], [["1", "x & y"], ["r", "2"]]), ("Sum", ["h", "g"], [["3", "4"]]))),
    "extract_xml": ("xml", XML, _grid(("table", ["Vessel", "Berth"], [["Marlin", "41"], ["Tern", ""]]))),
    "extract_tsv": ("tsv", TSV, _grid(("table", ["Berth", "Cargo"], [["17", "rope\ttar"], ["23", ""]]))),
    "extract_docx": ("docx", docx_fixture(), _grid(("Soundings", ["Quay", "Depth"], [["East", "3.2"], ["East", "4.7"], ["closed", "closed"]]))),
    "extract_pptx": ("pptx", pptx_fixture(), _grid(("Slide_1_Table_1", ["Crew", "Crew", "Days"], [["Ada", "mate", "12"], ["Ada", "cook", "9"]]), ("Slide_2_Table_1", ["Crew", "Crew", "Days"], [["Bo", "mate", "5"], ["Bo", "cook", "6"]]))),
    "extract_xlsx": ("excel", xlsx_fixture(), _grid(("Data", ["Region", "Order Date", "Amount"], [["华北", "2023-03-15", "1.5"], ["华北", "2023-03-16", "30"], ["华北", "1900-02-28", "7"]]))),
    "extract_dbf": ("dbf", dbf_fixture(), _grid(("table", ["VESSEL", "METRES", "AFLOAT", "BUILT"], [["Marlin", "41", "TRUE", "1987-05-17"], ["Tern", "7.25", "FALSE", ""]]))),
}


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with a table of its own at its end: what is found are those cells, whatever else the page holds."""
    own = F.concat(F.lit("</script></style><table><tr><th>page<th>length<tr><td>"), F.col("page_id").cast("string"), F.lit("<td>"), F.char_length("html").cast("string"), F.lit("</table>"))
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.col("html"), own).alias("html"))
    cells = extract_cells(pages, id_col="page_id", content_col="html", kind="html")
    return cells.select("page_id", "col", "name", "value")


def _serials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1, 50_000, 7).select("id", serial_date(F.col("id")).alias("day"))


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by Spark, found as one file, and loaded by the catalog with its row numbers."""
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    write_csv(table(spark, sf_dir, "part").drop("p_retailprice").orderBy("p_partkey").coalesce(1), path)
    file = spark.read.format("binaryFile").load(f"{path}/*.csv").select("path").first().path
    (sheet,) = Catalog(spark).load(file)
    return sheet.df


def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/json-{uuid.uuid4().hex}"
    write_json(table(spark, sf_dir, "nation"), path)
    return spark.read.schema("n_nationkey string, n_name string, n_regionkey string").json(path)


def _parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    (sheet,) = Catalog(spark).load(f"{sf_dir}/region.parquet")
    return sheet.df


def _export(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = numbered(table(spark, sf_dir, "nation"), "n_nationkey"), numbered(table(spark, sf_dir, "region"), "r_regionkey")
    return results_table(search([("a.csv", "nation", a), ("b.csv", "region", b)], SearchQuery("a")))


def _temp(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    catalog = Catalog(spark)
    catalog.materialize_query("late_orders", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey;", True)
    return catalog.sql("SELECT n, count(*) AS customers FROM late_orders GROUP BY n")


def _across_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL over two-part names of files in different formats."""
    catalog = Catalog(spark)
    catalog.load(f"{sf_dir}/nation.parquet")
    catalog.load(f"{sf_dir}/region.parquet")
    return catalog.sql('SELECT r_name, count(*) AS n FROM nation.nation JOIN "region"."region" ON n_regionkey = r_regionkey GROUP BY r_name')


def _union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), table(spark, sf_dir, "region").select(F.col("r_name").alias("n_name"))
    return union_all([a, b])


def _streamed(transform):
    """The same plan on a stream of events (all that there is, then stop), into a table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path, name = f"{sf_dir}/events.parquet", f"stream_{uuid.uuid4().hex}"
        out, mode = transform(spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/event[s].parquet"))
        target = f"{shared_dir(spark)}/{name}"
        if mode == "append":
            query = out.writeStream.format("parquet").option("path", target).option("checkpointLocation", f"{target}-state").trigger(availableNow=True).start()
            query.awaitTermination()
            return spark.read.schema(out.schema).parquet(target)
        query = out.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(target)).outputMode("complete").option("checkpointLocation", f"{target}-state").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(out.schema).parquet(target)

    return run


def _plain_time(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


QUERIES = {name: _cells(kind, content) for name, (kind, content, _) in FIXTURES.items()} | {
    "html_table_scan_pages": _pages,
    "excel_serial_date": _serials,
    "read_csv_row_numbers": _csv,
    "write_json_text": _json,
    "read_parquet_row_numbers": _parquet,
    "export_results": _export,
    "temp_table_reuse": _temp,
    "sql_across_files": _across_files,
    "union_by_name": _union,
    "window_tumbling": lambda spark, sf_dir: _plain_time(windowed_counts(table(spark, sf_dir, "events"), time="ts", by=["event_type"], width="1 hour"), "window_start", "window_end"),
    "window_sliding": lambda spark, sf_dir: _plain_time(windowed_counts(table(spark, sf_dir, "events"), time="ts", by=["event_type"], width="2 hours", slide="1 hour"), "window_start", "window_end"),
    "window_session": lambda spark, sf_dir: _plain_time(sessions(table(spark, sf_dir, "events"), time="ts", by=["user_id"], gap="30 minutes"), "session_start", "session_end"),
    "stream_search": _streamed(lambda s: (search_stream(s, SearchQuery("purchase", column="event_type", mode="exact")).select("event_id", "user_id"), "append")),
    "stream_tumbling": _streamed(lambda s: (_plain_time(windowed_counts(s, time="ts", by=["event_type"], width="1 hour"), "window_start", "window_end"), "complete")),
}

_TUMBLING = "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL"

ORACLE_SQL = {name: sql for name, (_, _, sql) in FIXTURES.items()} | {
    "html_table_scan_pages": "SELECT page_id, CAST(0 AS INTEGER) AS col, 'page' AS name, CAST(page_id AS VARCHAR) AS value FROM pages UNION ALL SELECT page_id, 1, 'length', CAST(length(html) AS VARCHAR) FROM pages",
    "excel_serial_date": "SELECT i AS id, CAST(DATE '1899-12-30' + CAST(i + CASE WHEN i < 60 THEN 1 ELSE 0 END AS INTEGER) AS DATE) AS day FROM range(1, 50000, 7) t(i)",
    "read_csv_row_numbers": f"SELECT CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS BIGINT) AS {ROW}, CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size FROM part",
    "write_json_text": "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation",
    "read_parquet_row_numbers": f"SELECT CAST(r_regionkey AS BIGINT) AS {ROW}, r_regionkey, r_name FROM region",
    "export_results": """
        SELECT 'a.csv' AS file, 'nation' AS sheet, CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey, '' AS r_regionkey, '' AS r_name FROM nation WHERE contains(lower(n_name), 'a')
        UNION ALL SELECT 'b.csv', 'region', '', '', '', CAST(r_regionkey AS VARCHAR), r_name FROM region WHERE contains(lower(r_name), 'a')""",
    "temp_table_reuse": "SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY n",
    "sql_across_files": "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "union_by_name": "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT NULL, r_name FROM region",
    "window_tumbling": _TUMBLING,
    "window_sliding": "SELECT s AS window_start, s + INTERVAL '2 hours' AS window_end, event_type, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL '1 hour', ts) - k * INTERVAL '1 hour' AS s FROM events, range(2) t(k)) GROUP BY ALL",
    "window_session": """
        WITH marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        runs AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM marked)
        SELECT min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, user_id, count(*) AS n FROM runs GROUP BY user_id, run""",
    "stream_search": "SELECT event_id, user_id FROM events WHERE event_type = 'purchase'",
    "stream_tumbling": _TUMBLING,
}
