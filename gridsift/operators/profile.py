"""Slices, samples and column statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.cells import text_of
from ..model import ROW


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns in the order asked for; unknown names are left out."""
    return df.select(*[F.col(f"`{c}`") for c in columns if c in df.columns])


def slice_rows(df: DataFrame, start: int, end: int, columns: list[str] | None = None) -> DataFrame:
    """Rows start to end (exclusive), in order. A range that is empty or outside gives no rows."""
    out = df.filter((F.col(ROW) >= max(start, 0)) & (F.col(ROW) < end)).orderBy(ROW)
    return out if columns is None else project(out, [ROW, *columns])


def sample_evenly(df: DataFrame, n: int) -> DataFrame:
    """n rows at even distances, the first among them: number i * rows // n."""
    total = df.count()
    if n >= total:
        return df.orderBy(ROW)
    # Row r is picked if some i has i * total // n == r; as n < total, that is one test on r and needs no list.
    i = F.ceil(F.col(ROW) * F.lit(n) / F.lit(float(total))).cast("long")
    hit = lambda k: (k >= 0) & (k < n) & (F.expr(f"({total}L * 1)") * k - F.col(ROW) * n).between(0, n - 1)
    return df.filter(hit(i) | hit(i - 1) | hit(i + 1)).orderBy(ROW)


def sample_random(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    return df.orderBy(F.rand(seed)).limit(n)


#: Characters of a value that are counted with it, to order values that are equally frequent.
PREFIX = 32
BROADCAST_ROWS = 50_000


def _cells(df: DataFrame) -> DataFrame:
    """column_name, value and its hash of 128 bits (h1, h2) for every cell."""
    names = [c for c in df.columns if c != ROW]
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), text_of(F.col(f"`{c}`")).alias("value")) for c in names])
    return df.select(F.explode(cells).alias("x")).select("x.*").withColumns({"h1": F.xxhash64("value"), "h2": F.xxhash64(F.lit(7), "value")})


def _counted(df: DataFrame) -> DataFrame:
    """column_name, h1, h2, prefix, n: every distinct text of every column by its hash, counted in parts before anything is shuffled. Of a long text no more than its first characters are."""
    return _cells(df).groupBy("column_name", "h1", "h2").agg(F.min(F.left("value", F.lit(PREFIX))).alias("prefix"), F.count("*").alias("n"))


def column_statistics(df: DataFrame) -> DataFrame:
    """column_name, total, non_null, nulls, distinct_count: an empty cell is a null. One pass over the table, whatever the number of columns."""
    names = [c for c in df.columns if c != ROW]
    all_columns = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in names])).alias("column_name"))
    full = F.col("prefix") != ""
    sums = _counted(df).groupBy("column_name").agg(F.sum("n").alias("total"), F.sum(F.when(full, F.col("n")).otherwise(0)).alias("non_null"), F.count_if(full).alias("distinct_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = all_columns.join(sums, "column_name", "left").select("column_name", *map(zero, ("total", "non_null", "distinct_count")))
    return out.select("column_name", "total", "non_null", (F.col("total") - F.col("non_null")).alias("nulls"), "distinct_count")


def top_values(df: DataFrame, k: int) -> DataFrame:
    """column_name, value, n, rank: each column's most frequent non-empty values, ties by value. Counts are taken before anything is ranked."""
    by_prefix = W.Window.partitionBy("column_name").orderBy(F.desc("n"), "prefix")
    # Those that are among the first by their first characters, ties all; then their whole texts, and their order by these.
    first = _counted(df).filter("prefix <> ''").withColumn("r", F.rank().over(by_prefix)).filter(F.col("r") <= k).select("column_name", "h1", "h2", "n")
    first = F.broadcast(first) if first.count() <= BROADCAST_ROWS else first
    counts = _cells(df).join(first, ["column_name", "h1", "h2"]).groupBy("column_name", "h1", "h2", "n").agg(F.first("value").alias("value")).select("column_name", "value", "n")
    order = W.Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def summarize(df: DataFrame) -> DataFrame:
    """column_name, column_type, min, max, n, nulls, distinct_count (approximate), avg: the profile that SUMMARIZE gives."""
    names = [c for c in df.columns if c != ROW]
    kinds = dict(df.dtypes)
    numeric = {c for c in names if kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[c].startswith("decimal")}
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(names):
        x = F.col(f"`{c}`")
        aggs += [F.min(x).cast("string").alias(f"lo{i}"), F.max(x).cast("string").alias(f"hi{i}"), F.count_if(x.isNull()).alias(f"z{i}"), F.approx_count_distinct(x).alias(f"d{i}"), (F.avg(x) if c in numeric else F.lit(None).cast("double")).alias(f"a{i}")]
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("column_type"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"), F.col("n"), F.col(f"z{i}").alias("nulls"), F.col(f"d{i}").alias("distinct_count"), F.col(f"a{i}").alias("avg")) for i, c in enumerate(names)]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Tables one after the other, columns by name, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
