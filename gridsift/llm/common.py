"""Helpers that several operators share: stored intermediate tables, hidden column names, text to bytes."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters [\x20\x09-\x0D] that separate words and are stripped from lines.
BLANKS = " \t\n\x0b\x0c\r"

#: A table of at most this many rows may be broadcast; callers count it first and have a shuffle join beyond it.
BROADCAST_ROWS = 50_000

#: About so many bytes of text are worked on, and given back, at a time by functions over Arrow batches.
CHUNK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, or one of our own where it is unset and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file:///tmp/checkpoints/gridsift"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Where stored() and others have written in this process, in order.
_WRITTEN: list[str] = []


def written() -> int:
    """How many tables have been written in this process: where release() may begin."""
    return len(_WRITTEN)


def release(spark: SparkSession, since: int = 0, keep_last: bool = False, only: str | None = None) -> int:
    """Deletes what stored() and others have written in this process since then (but the last of it, if keep_last), once results that rest on it are no longer needed; or that place only. Returns how many tables that were."""
    gone = _WRITTEN[since : len(_WRITTEN) - keep_last] if only is None else [only]
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
        _WRITTEN.remove(name)
    return len(gone)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, which release() deletes."""
    _WRITTEN.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


#: Spark's setting by which a query's shuffle files go once it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, keep_shuffle: bool = True) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage, survives lost executors, keeps column pruning.

    keep_shuffle=False: the shuffle files of the write are deleted at its end, and not only when the driver collects its garbage.
    """
    spark = df.sparkSession
    path, before = shared_path(spark, name), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, before if keep_shuffle else "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes what stored() has written for df, of which nothing will be read again."""
    release(df.sparkSession, only=df.stored_at)


#: Rows of a batch that goes to Python, where the session has Spark's own number: a batch is held several times over, by both sides.
BATCH_ROWS = 500
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_batches(df: DataFrame) -> DataFrame:
    """df, whose rows hold whole texts: batches of them have BATCH_ROWS rows from here on in the session, unless it has a number of its own."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH) == "10000":
        conf.set(_BATCH, str(BATCH_ROWS))
    return df


def hidden(df: DataFrame) -> DataFrame:
    """df with its columns renamed c0, c1, ...: an operator's own columns then clash with none, and duplicates do no harm."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def position(df: DataFrame, name: str) -> str:
    """The name that hidden() gives to the first column called name (case does not matter)."""
    return f"c{[c.lower() for c in df.columns].index(name.lower())}"


def restored(df: DataFrame, like: DataFrame, changed: dict[str, str] | None = None) -> DataFrame:
    """The columns that hidden() renamed, under their first names and in their order. changed: other columns to take for some of them, by hidden name."""
    took = [(changed or {}).get(f"c{i}", f"c{i}") for i in range(len(like.columns))]
    return df.select(*took).toDF(*like.columns)


def ascii_lower(col):
    """A-Z lower-cased and nothing else. Text of ASCII alone takes the fast general function."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, upper, upper.lower()))


def utf8(text: str | None) -> bytes:
    """UTF-8 bytes; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def chunks(batch: pa.RecordBatch, columns: list[int]) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about CHUNK_BYTES in the given text columns, one row at least: what a worker holds does not depend on the batch's rows."""
    if not batch.num_rows:
        return
    size = sum(np.asarray(pc.fill_null(pc.binary_length(batch.column(c)), 0), np.int64) for c in columns)
    part = np.cumsum(size) // CHUNK_BYTES
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)
