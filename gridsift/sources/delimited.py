"""Delimited text: read by Spark in parallel, with exact row numbers; or parsed from a string, for entries of archives."""

from __future__ import annotations

import csv
import io
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from . import quoted
from ..functions.encoding import candidates, encoding_of, marked, readable
from ..functions.names import column_names
from ..model import ROW, Table

HEAD_BYTES = 1 << 16
# Encodings of Spark's reader.
CHARSETS = ("iso-8859-1", "us-ascii", "utf-8")
#: Spark's reader takes no more columns.
MOST_COLUMNS = 20_000


def parse(text: str, sep: str, name: str) -> list[Table]:
    """Short rows are filled up, wide ones widen the table; a header alone is a table without rows, an empty file none."""
    csv.field_size_limit(sys.maxsize)
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if r]
    return [Table(name, rows[0], rows[1:]).widened()] if rows else []


def head(spark: SparkSession, path: str, size: int = HEAD_BYTES) -> tuple[bytes, int]:
    """The first bytes of a file in any store that Spark reads, and its length."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    length = fs.getFileStatus(target).getLen()
    stream = fs.open(target)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(size, length))), length
    finally:
        stream.close()


def file_encoding(spark: SparkSession, path: str) -> str:
    """The encoding of a byte-order mark, or the first one that reads the whole file. Files beyond HEAD_BYTES are tested by their lines, on executors: no line feed byte is part of a longer character."""
    start, length = head(spark, path)
    if mark := marked(start):
        return mark
    all_read, start = len(start) == length, start.removeprefix(b"\xef\xbb\xbf")
    if all_read:
        return encoding_of(start)
    lines = spark.read.option("lineSep", "\n").text(path)
    if not lines.filter(~F.is_valid_utf8("value")).limit(1).count():
        return "utf-8"
    names = candidates(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = list(names)
        for batch in batches:
            data = b"\n".join(x for x in batch.column(0).to_pylist() if not x.isascii())
            left = [n for n in left if readable(data, n)]
        yield pa.RecordBatch.from_pydict({"names": [left]}, pa.schema([("names", pa.list_(pa.string()))]))

    left = set(names)
    for r in lines.select(F.col("value").cast("binary")).mapInArrow(run, "names array<string>").distinct().collect():  # few: sets of candidates
        left &= set(r.names)
    return next((n for n in names if n in left), "utf-8")


def numbered(df: DataFrame) -> DataFrame:
    """df (a scan of one file, in its own order) with row numbers from 0: each block's rows are counted, then each row adds those of the blocks before. No sort of rows."""
    at = df.withColumns({"_block": F.col("_metadata.file_block_start"), "_id": F.monotonically_increasing_id()})
    blocks = at.groupBy("_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    order = W.Window.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(W.Window.unboundedPreceding, 0)
    offsets = blocks.withColumn("_before", F.sum("_n").over(order) - F.col("_n")).drop("_n")
    # One row for each block of the file: far fewer than anything that could not be broadcast.
    out = at.join(F.broadcast(offsets), "_block")
    return out.withColumn(ROW, F.col("_before") + F.col("_id") - F.col("_first")).drop("_block", "_id", "_first", "_before")


def plain_records(spark: SparkSession, path: str, sep: str, start: bytes, header: int = 0) -> tuple[int, int, int] | None:
    """(records, header included; those of more cells than the header; cells of the widest) of a file in which each line is a record for Spark's reader too; else None. One pass over blocks of the file.

    Each line has to leave quotes closed: without doubled quotes and quoted cells it holds no quote. Line ends must be of one kind, and no
    line of blanks alone, as a scan by lines leaves it out.
    """
    line = F.regexp_replace("value", "\r$", "")
    single = F.replace(line, F.lit('""'), F.lit(""))
    # Most lines hold no quote, and need no pattern.
    has_quote = F.contains(line, F.lit('"'))
    sign = re.escape(sep)
    rest = F.when(has_quote, F.regexp_replace(single, rf'(?:^|{sign})"[^"]*+"(?={sign}|$)', "")).otherwise(line)
    outside = F.when(has_quote, F.regexp_replace(single, '"[^"]*+"', "")).otherwise(line)
    strange = F.contains(rest, F.lit('"')) | F.contains(line, F.lit("\r")) | line.rlike(r"\A[\x00-\x20]+\z")
    returns = F.endswith(F.col("value"), F.lit("\r"))
    cells = F.length(outside) - F.length(F.replace(outside, F.lit(sep), F.lit(""))) + 1
    seen = (
        spark.read.option("lineSep", "\n")
        .text(path)
        .agg(F.count_if(strange).alias("strange"), F.count_if(returns).alias("returns"), F.count_if(~returns).alias("others"), F.count_if(line != "").alias("records"), F.count_if((cells > header) & (line != "")).alias("wide"), F.max(cells).alias("width"))
        .first()
    )
    # The last line may have no end.
    one_end = not seen.returns or (seen.others <= 1 and start.partition(b"\n")[0].endswith(b"\r"))
    return (seen.records, seen.wide, seen.width or 0) if not seen.strange and one_end and (seen.width or 0) <= MOST_COLUMNS else None


@dataclass(frozen=True)
class Delimited:
    """A file's rows, how many there are, and how many have more cells than the header (None where reading has not told it). in_order: a scan gives them in order of their numbers."""

    df: DataFrame
    rows: int | None
    wide: int | None
    in_order: bool = False


def read_counted(spark: SparkSession, path: str, sep: str = ",", *, encoding: str | None = None, widen: bool = False) -> Delimited | None:
    """The file as text columns and row numbers, or None if it is empty.

    Short rows are filled up, empty cells are empty strings. Cells beyond the header's width are cut, and the rows that lose some are counted; with
    widen they are columns of their own. Where every line is a record Spark's own reader takes the file, else its blocks are parsed by
    quoted.records(); rows are the same in both. Only UTF-16 and UTF-32, whose characters hold bytes that look like quotes and line ends, are read by
    one task, and not counted.
    """
    start, length = head(spark, path)
    encoding = encoding or file_encoding(spark, path)
    units = encoding.lower().startswith(("utf-16", "utf-32"))
    while True:
        text = start.removeprefix(b"\xef\xbb\xbf").decode(encoding, "replace").removeprefix("\ufeff")
        csv.field_size_limit(sys.maxsize)
        records = csv.reader(io.StringIO(text, newline=""), delimiter=sep)
        first, second = next((r for r in records if r), None), next(records, None)
        # The header is whole once another record follows it, however long it is.
        if second is not None or len(start) >= length:
            break
        start, _ = head(spark, path, 4 * len(start))
    if not first:
        return None
    plain = plain_records(spark, path, sep, start, len(first)) if not units and encoding.lower() in CHARSETS else None
    if plain is None and not units:
        made = quoted.layout(spark, path, sep, len(first))
        names = column_names(first + [""] * (made.width - len(first) if widen else 0))
        rows = quoted.records(spark, path, sep, encoding, made)
        return Delimited(rows.select(ROW, *[F.coalesce(F.get("cells", F.lit(k)), F.lit("")).alias(n) for k, n in enumerate(names)]), made.records - 1, made.wide)
    names = column_names(first + [""] * (plain[2] - len(first) if plain and widen else 0))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    reader = spark.read.schema(schema).option("header", True).option("sep", sep).option("encoding", encoding).option("multiLine", units).option("enforceSchema", True).option("escape", '"').option("maxColumns", MOST_COLUMNS + 480)
    scan = numbered(reader.csv(path))
    return Delimited(scan.select(ROW, *[F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names]), plain and plain[0] - 1, plain and plain[1], True)


def read_delimited(spark: SparkSession, path: str, sep: str = ",", *, encoding: str | None = None, widen: bool = False) -> DataFrame | None:
    """The rows of read_counted()."""
    got = read_counted(spark, path, sep, encoding=encoding, widen=widen)
    return got and got.df
