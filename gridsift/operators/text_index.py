"""A substring index over the files of a Parquet table: searches read only files that can hold what is searched for.

For each file there is a bitmap of the trigrams (of UTF-8 bytes) in the lower-cased text of its cells. A text that a search looks for, or every
text that its pattern needs, has trigrams of its own; a file that lacks one of them has no match. Files that may match are read and searched
as without an index, so rows are the same. An index of other files than those that are there does no harm: what it doesn't know, by
path, size and time, is read.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as parser
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import text_of
from ..model import SearchQuery
from .search import search_table

#: Bits of a file's bitmap, a power of two.
BITS = 1 << 20
_FILE = "path string, length long, changed timestamp"


def places(data: np.ndarray) -> np.ndarray:
    """Where the trigrams of some bytes stand in a bitmap."""
    if len(data) < 3:
        return np.zeros(0, np.uint32)
    x = data.astype(np.uint32)
    with np.errstate(over="ignore"):
        return ((x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * np.uint32(2654435769)) >> np.uint32(32 - (BITS.bit_length() - 1))


def build_text_index(spark: SparkSession, path: str, out: str) -> int:
    """Writes the index of a Parquet table to a place of its own. Returns the number of files. One pass over the table; what is shuffled is one bitmap for each task and file."""
    table = spark.read.parquet(path)
    # Cells are apart by a byte that the trigrams of a search do not have.
    text = F.lower(F.concat_ws("\x00", *[text_of(F.col(f"`{c}`")) for c in table.columns]))
    rows = table.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"), F.col("_metadata.file_modification_time").alias("changed"), text.alias("text"))

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, files, has = None, None, np.zeros(BITS, bool)

        def made() -> pa.RecordBatch:
            words = np.packbits(has, bitorder="little").view("<i8")
            return pa.RecordBatch.from_arrays([*files, pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(words))], names=["path", "length", "changed", "words"])

        for batch in batches:
            paths = batch.column(0).to_pylist()
            edges = [i for i in range(len(paths)) if i == 0 or paths[i] != paths[i - 1]]
            for a, b in zip(edges, [*edges[1:], len(paths)]):
                if paths[a] != now:
                    if now is not None:
                        yield made()
                    now, files = paths[a], [batch.column(c).slice(a, 1) for c in range(3)]
                    has = np.zeros(BITS, bool)
                for x in batch.column(3).slice(a, b - a):
                    has[places(np.frombuffer(x.as_buffer(), np.uint8))] = True
        if now is not None:
            yield made()

    def together(table: pa.Table) -> pa.Table:
        words = np.bitwise_or.reduce([np.asarray(x.values) for x in table.column("words")])
        row = table.slice(0, 1)
        return row.set_column(3, "words", pa.chunked_array([pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(words))]))

    parts = rows.mapInArrow(bitmaps, f"{_FILE}, words array<long>")
    parts.groupBy("path", "length", "changed").applyInArrow(together, f"{_FILE}, words array<long>").write.mode("overwrite").parquet(out)
    return spark.read.parquet(out).count()


def _literals(pattern: str) -> list[str]:
    """Texts that everything which a regular expression matches holds; none where that is not plain. Only what both engines read alike is looked at."""
    if re.search(r"\\[0-9QE]|\(\?[^:]|\{,", pattern):
        return []
    try:
        tree = parser.parse(pattern)
    except Exception:  # noqa: BLE001 - a pattern of the other engine's own
        return []
    found, now = [], []

    def end() -> None:
        if now:
            found.append("".join(now))
            now.clear()

    def walk(items) -> None:
        for op, arg in items:
            if op is sre.LITERAL:
                now.append(chr(arg))
            elif op is sre.SUBPATTERN and not arg[1] and not arg[2]:
                walk(arg[3])
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
                end()
                walk(arg[2])
                end()
            else:
                end()

    walk(tree)
    end()
    return found


def needed(spark: SparkSession, query: SearchQuery) -> list[str]:
    """Texts, lower-cased as the index is, that a cell must hold to match."""
    if query.invert:
        return []
    if query.mode in ("fulltext", "exact"):
        return [spark.range(1).select(F.lower(F.lit(query.text))).first()[0]]
    if query.mode == "wildcard":
        texts, plain = re.split("[%_]", query.text), set(map(chr, range(1, 128)))
    else:
        # Without case, and beyond ASCII, other letters stand for i, k and s as well.
        texts, plain = _literals(query.text), set(map(chr, range(1, 128))) - set("iksIKS")
    return [run for t in texts for run in re.split(f"[^{re.escape(''.join(sorted(plain)))}]", t.lower()) if len(run) >= 3]


def _may_hold(texts: list[str]) -> Column:
    """Whether a file's bitmap has all trigrams of all texts."""
    at = sorted({int(p) for t in texts for p in places(np.frombuffer(t.encode(), np.uint8))})
    masks: dict[int, int] = {}
    for p in at:
        masks[p >> 6] = masks.get(p >> 6, 0) | 1 << (p & 63)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return reduce(Column.__and__, [F.element_at("words", w + 1).bitwiseAND(F.lit(signed(m))) == F.lit(signed(m)) for w, m in masks.items()], F.lit(True))


@dataclass(frozen=True)
class Found:
    """The rows of a search, and how many of the table's files they are taken from."""

    df: DataFrame
    files: int
    files_read: int


def indexed_search(spark: SparkSession, path: str, index: str, query: SearchQuery) -> Found:
    """search_table() of a Parquet table, over those of its files that can hold a match. Conditions and columns of the query hold as ever."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select("path", "length", F.col("modificationTime").alias("changed"))
    known = spark.read.parquet(index)
    texts = needed(spark, query)
    # The paths of both are the same text but for how they spell signs of their own.
    plain = F.regexp_replace(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")
    judged = files.withColumn("p", plain).join(known.select(plain.alias("p"), "length", F.date_trunc("second", "changed").alias("second"), _may_hold(texts).alias("may")), ["p", "length"], "left")
    fresh = F.col("second").isNull() | (F.date_trunc("second", "changed") != F.col("second"))
    rows = judged.select("path", (fresh | F.col("may")).alias("reads")).collect()  # names of files, as any scan has them on the driver
    table = spark.read.parquet(path)
    if not rows:
        return Found(search_table(table, query), 0, 0)
    read = [unquote(r.path) for r in rows if r.reads]
    if not read:
        return Found(search_table(table.limit(0), query), len(rows), 0)
    part = spark.read.schema(table.schema).option("basePath", path).parquet(*read) if len(read) < len(rows) else table
    return Found(search_table(part, query), len(rows), len(read))
