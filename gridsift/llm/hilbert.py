"""Sharding by a Hilbert curve over document metadata.

Each dimension is quantised to 2**bits bins at its own quantiles, which are exact: distinct values are counted, put in order over all tasks,
and the values at which the running count passes a bin's share are the cuts (whole strings and numbers, in their own order). The bins of
all dimensions give a cell, and the cell's place on the Hilbert curve gives the order. Cells are few (2**(bits * dimensions)
at most), so their counts and offsets are a bounded table: every row gets its exact global rank from the offset of its bucket
plus its number inside the bucket, without a global sort. A cell that holds many rows is dealt over as many buckets
as its count asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .common import hidden, position, stored

#: Buckets besides one for each cell: one for so many rows, within these bounds. Their table is broadcast.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 1 << 20, 2048, 1 << 18


def hilbert_index(point: tuple[int, ...], bits: int) -> int:
    """Place of a point on the Hilbert curve through the grid of 2**bits steps a side: transpose by Gray code, then interleave bits."""
    x, n = list(point), len(point)
    for level in range(bits - 1, 0, -1):
        top, low = 1 << level, (1 << level) - 1
        for i in range(n):
            if x[i] & top:
                x[0] ^= low
            else:
                swap = (x[0] ^ x[i]) & low
                x[0] ^= swap
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = 0
    for level in range(bits - 1, 0, -1):
        if x[n - 1] >> level & 1:
            flip ^= (1 << level) - 1
    x = [v ^ flip for v in x]
    out = 0
    for level in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | (v >> level & 1)
    return out


def curve(bits: int, dims: int) -> list[int]:
    """hilbert_index of every cell, by cell number (the first dimension's bin is the highest digit)."""
    side = 1 << bits
    return [hilbert_index(tuple(cell // side ** (dims - 1 - d) % side for d in range(dims)), bits) for cell in range(side**dims)]


def cuts(df: DataFrame, name: str, side: int) -> list:
    """Values that part a column into side bins of about equal counts: value number k is the smallest up to which there are k / side of the rows. Nulls come first and are no cut."""
    counts = df.groupBy(F.col(name).alias("v")).agg(F.count("*").alias("n"))
    # In order of value over all tasks; stored, so that the tasks' parts stay what they are.
    parts = stored(counts.orderBy(F.asc_nulls_first("v")).withColumn("part", F.spark_partition_id()), "values")
    first = W.Window.orderBy("part").rowsBetween(W.Window.unboundedPreceding, 0)
    # As many rows as a shuffle has partitions.
    sums = parts.groupBy("part").agg(F.sum("n").alias("own"))
    before = sums.select("part", (F.sum("own").over(first) - F.col("own")).alias("before"), F.sum("own").over(W.Window.partitionBy()).alias("total"))
    run = W.Window.partitionBy("part").orderBy(F.asc_nulls_first("v")).rowsBetween(W.Window.unboundedPreceding, 0)
    upto = parts.join(F.broadcast(before), "part").withColumn("upto", F.col("before") + F.sum("n").over(run))
    # floor(side * x / total), in whole numbers; the last value ends the last bin and is no cut.
    bins = lambda x: F.floor((x * side) / F.col("total"))
    passed = upto.filter((bins(F.col("upto")) > bins(F.col("upto") - F.col("n"))) & (F.col("upto") < F.col("total")) & F.col("v").isNotNull())
    return [r.v for r in passed.select("v").orderBy("v").collect()]  # side - 1 rows at most


def _ordered(df: DataFrame, name: str) -> Column:
    """The column as a value that can be compared: strings and numbers as they are, all else as text."""
    kind = df.schema[name].dataType
    return F.col(name) if isinstance(kind, (T.StringType, T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)) else F.col(name).cast("string")


def _placed(src: DataFrame, doc_id: str, text: str, dims: list[str], n_shards: int, bits: int) -> DataFrame:
    """src (columns of other names than these) with size, text_crc32, curve, shard, slot."""
    if bits * len(dims) > 16:
        raise ValueError("bits * dimensions may be 16 at most: the table of cells is broadcast")
    side = 1 << bits
    cell = F.lit(0)
    for d in dims:
        within = F.lit(0)
        for cut in cuts(src.select(_ordered(src, d).alias(d)), d, side):
            within = within + F.coalesce(_ordered(src, d) > F.lit(cut), F.lit(False)).cast("int")
        cell = cell * side + within
    place = F.get(F.lit(curve(bits, len(dims))), cell)
    # First pass: rows of each cell, of the metadata alone. It says over how many buckets the cell's rows are dealt.
    total = F.sum("n").over(W.Window.partitionBy(F.lit(0)))
    wanted = F.greatest(F.lit(LEAST_BUCKETS), F.least(F.lit(MOST_BUCKETS), total / BUCKET_ROWS))
    cells = src.select(place.alias("curve")).groupBy("curve").agg(F.count("*").alias("n")).withColumn("subs", F.ceil(F.col("n") * wanted / total))
    placed = src.withColumns(
        {
            "size": (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long"),
            "text_crc32": F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")),
            "curve": place,
        }
    ).withColumn("h", F.xxhash64(doc_id, "text_crc32", "size"))
    dealt = placed.join(F.broadcast(cells.select("curve", "subs")), "curve").withColumn("sub", F.pmod("h", F.col("subs")))
    # Second pass: rows of each bucket, and the rows before it. 2**16 cells and MOST_BUCKETS more rows at most.
    order = W.Window.partitionBy(F.lit(0)).orderBy("curve", "sub")
    buckets = (
        dealt.groupBy("curve", "sub")
        .agg(F.count("*").alias("n"))
        .withColumns({"before": F.sum("n").over(order.rowsBetween(W.Window.unboundedPreceding, 0)) - F.col("n"), "total": total})
        .drop("n")
    )
    inside = W.Window.partitionBy("curve", "sub").orderBy("h", doc_id, "text_crc32", "size")
    rank = F.col("before") + F.row_number().over(inside) - 1
    ranked = dealt.join(F.broadcast(buckets), ["curve", "sub"]).withColumn("rank", rank)
    # The first (total mod n) shards hold one row more than the others.
    base, more = F.floor(F.col("total") / n_shards), F.col("total") % n_shards
    head = more * (base + 1)
    shard = F.when(F.col("rank") < head, F.floor(F.col("rank") / (base + 1))).otherwise(more + F.floor((F.col("rank") - head) / F.greatest(base, F.lit(1))))
    slot = F.when(F.col("rank") < head, F.col("rank") % (base + 1)).otherwise((F.col("rank") - head) % F.greatest(base, F.lit(1)))
    return ranked.select(*src.columns, "size", "text_crc32", "curve", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def hilbert_shards(docs: DataFrame, *, dims: list[str], n_shards: int, id_col: str = "doc_id", text_col: str = "text", bits: int = 4) -> DataFrame:
    """id, size (UTF-8 bytes plus 1), text_crc32, curve (place on the Hilbert curve), shard, slot.

    Rows sort by curve place; runs of that order are cut so that shards differ by one row at most; slot numbers a shard's
    rows from 0 in that order. Rows of the same cell follow a hash of id and text, so the result does not depend on the
    input's order. Null metadata sorts first; null text has size 1 and CRC 0; repeated rows each get a place of their own;
    an empty table gives an empty result; other columns are not read.
    """
    src = docs.select(id_col, text_col, *[F.col(c) for c in dims]).toDF("c0", "c1", *[f"d{i}" for i in range(len(dims))])
    out = _placed(src, "c0", "c1", [f"d{i}" for i in range(len(dims))], n_shards, bits)
    return out.select(F.col("c0").alias(id_col), "size", "text_crc32", "curve", "shard", "slot")


def write_shards(docs: DataFrame, path: str, *, dims: list[str], n_shards: int, id_col: str = "doc_id", text_col: str = "text", bits: int = 4) -> DataFrame:
    """Writes whole rows of docs as one Parquet folder per shard (_shard=0, ...), in slot order (_slot, _size), and returns the manifest: shard, rows, bytes,
    and the smallest and largest value of each dimension, by which a reader leaves out shards.

    Every row is written once, whatever its id: null and repeated ids and repeated rows too. Columns keep their names, also such as size, shard or slot; an
    empty table gives an empty manifest.
    """
    src = hidden(docs)
    at = {c: position(docs, c) for c in dims}
    out = _placed(src, position(docs, id_col), position(docs, text_col), list(at.values()), n_shards, bits).drop("text_crc32", "curve")
    named = out.select(*src.columns, "size", "slot", "shard").toDF(*docs.columns, "_size", "_slot", "_shard")
    # Slots of a shard are written by several tasks where a shard is large: ranges of (shard, slot), in order.
    named.repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path)
    written = docs.sparkSession.read.schema(named.schema).parquet(path)
    bounds = [f(F.col(c)).alias(f"{f.__name__}_{c}") for c in dims for f in (F.min, F.max)]
    return written.groupBy(F.col("_shard").alias("shard")).agg(F.count("*").alias("rows"), F.sum("_size").alias("bytes"), *bounds)
