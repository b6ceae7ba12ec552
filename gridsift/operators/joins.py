"""Joins that Spark SQL has no words for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..model import ROW


#: Keys of more rows than this are cut by time in as-of joins, at so many quantiles.
HOT_ROWS, PARTS = 1_000_000, 64


def asof_join(left: DataFrame, right: DataFrame, *, by: list[str], left_on: str, right_on: str, take: list[str], op: str = ">=") -> DataFrame:
    """Each row of left with columns `take` of the latest row of right (same `by`, right_on <= left_on); null where there is none.

    op: how left_on stands to right_on. With > the latest row before, with <= and < the earliest row at or after, or after.

    Both sides go into one sorted run per key and the last right row is carried forward: one shuffle, no pairs. The run of a key of more than HOT_ROWS
    rows is cut into parts at quantiles of time, and each part begins with the last right row of those before it, so no task holds a hot key. A time that
    is several quantiles, as very many rows have it, is a part of its own: its right rows become one, and its left rows go to as many tasks. Of right rows
    with equal right_on, the one with the largest `take` counts. Rows with a null key or time match nothing, and stay out of the runs.
    """
    if op not in (">=", ">", "<=", "<"):
        raise ValueError(f"{op} is no comparison by order")
    ahead, strict = op in ("<=", "<"), op in (">", "<")
    value = F.struct(F.col(right_on).alias("_at"), *[F.col(c).alias(f"_take_{c}") for c in take])
    names, keys = left.columns, [f"_by_{c}" for c in by]
    known = F.col(left_on).isNotNull()
    for c in by:
        known = known & F.col(c).isNotNull()
    a = left.filter(known).select(F.struct(*names).alias("_left"), *[F.col(c).alias(f"_by_{c}") for c in by], F.col(left_on).alias("_at"), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("_right"), F.lit(1).alias("_side"))
    b = right.filter(F.col(right_on).isNotNull()).select(F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), *[F.col(c).alias(f"_by_{c}") for c in by], F.col(right_on).alias("_at"), value.alias("_right"), F.lit(0).alias("_side"))
    for c in keys:
        b = b.filter(F.col(c).isNotNull())
    rows = a.unionByName(b)
    number = F.col("_at").cast("timestamp").cast("double") if rows.schema["_at"].dataType.typeName() in ("timestamp", "timestamp_ntz", "date") else F.col("_at").cast("double")
    number = -number if ahead else number
    # One row for each HOT_ROWS rows of the tables at most, as are the quantiles made of it.
    hot = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > HOT_ROWS).drop("_n")
    carry = F.lit(None).cast(rows.schema["_right"].dataType)
    if hot.isEmpty():
        rows = rows.withColumns({"_part": F.lit(0), "_copy": F.lit(0), "_carry": carry})
    else:
        numbered_rows = rows.withColumn("_x", number)
        cuts = numbered_rows.join(F.broadcast(hot), keys, "left_semi").groupBy(*keys).agg(F.percentile_approx("_x", [k / PARTS for k in range(1, PARTS)], 10_000).alias("_cuts"))
        rows = numbered_rows.join(F.broadcast(cuts), keys, "left")
        below = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_x"))), F.lit(0))
        equal = F.coalesce(F.size(F.filter("_cuts", lambda c: c == F.col("_x"))), F.lit(0))
        # A part for what lies between two quantiles, and one for each time that is two or more.
        rows = rows.withColumns({"_part": F.when(F.col("_cuts").isNull(), 0).otherwise(2 * below + F.when(equal > 1, 1).otherwise(0)), "_copies": F.when(equal > 1, equal).otherwise(1)}).withColumn("_place", F.col("_x")).drop("_cuts", "_x")
        crowd = rows.filter("_copies > 1 AND _side = 0").groupBy(*keys, "_at", "_part", "_copies", "_side", "_place").agg(F.max("_right").alias("_right"))
        crowd = crowd.withColumns({"_left": F.lit(None).cast(rows.schema["_left"].dataType), "_copy": F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))})
        others = rows.filter("_copies = 1 OR _side = 1").withColumn("_copy", F.pmod(F.xxhash64("_left"), F.col("_copies")).cast("int"))
        before = W.Window.partitionBy(*keys).orderBy("_part").rowsBetween(W.Window.unboundedPreceding, -1)
        hot_rows = rows.join(F.broadcast(hot), keys, "left_semi")
        reached = F.when(F.col("_right").isNotNull(), F.struct("_place", "_right"))
        lasts = hot_rows.groupBy(*keys, "_part").agg(F.max_by("_right", reached).alias("_last"))
        starts = lasts.select(*keys, "_part", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
        rows = others.unionByName(crowd).drop("_copies", "_place").join(F.broadcast(starts), [*keys, "_part"], "left")
    order = W.Window.partitionBy(*keys, "_part", "_copy").orderBy(F.desc("_at") if ahead else F.asc("_at"), F.desc("_side") if strict else F.asc("_side"), "_right").rowsBetween(W.Window.unboundedPreceding, 0)
    seen = rows.withColumn("_right", F.coalesce(F.last("_right", ignorenulls=True).over(order), "_carry")).filter("_side = 1")
    found = seen.select(*[F.col(f"_left.`{c}`").alias(c) for c in names], *[F.col(f"_right.`_take_{c}`").alias(c) for c in take])
    kinds = dict(zip(found.columns[len(names) :], found.schema.fields[len(names) :]))
    none = left.filter(~known).select(*[F.col(f"`{c}`") for c in names], *[F.lit(None).cast(kinds[c].dataType).alias(c) for c in take])
    return found.unionByName(none)


def positional_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows side by side by row number; the shorter table is filled up with nulls."""
    return left.join(right, ROW, "full")


def range_join(points: DataFrame, ranges: DataFrame, *, point: str, start: str, end: str, width: float) -> DataFrame:
    """Pairs with start <= point < end. Ranges are cut into bins of the given width, or of 2, 4, 8 ... times that where they are longer: three bins at most
    each, so a long range makes no more rows than a short one. It is an equi-join with a filter, not all pairs; null bounds match nothing.
    """
    bin_of = lambda c, level: F.floor(F.col(c) / (F.lit(float(width)) * F.pow(F.lit(2.0), level)))
    level = F.greatest(F.lit(0.0), F.ceil(F.log2((F.col(end) - F.col(start)) / F.lit(float(width)))).cast("double"))
    cut = ranges.filter(F.col(start) < F.col(end)).withColumn("_level", level)
    cut = cut.withColumn("_bin", F.explode(F.sequence(bin_of(start, F.col("_level")), bin_of(end, F.col("_level")))))
    levels = sorted(r._level for r in cut.select("_level").distinct().collect())  # as many as numbers have doublings, at most
    if not levels:
        levels = [0.0]
    near: Column = (F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))
    probes = points.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]))).withColumn("_bin", bin_of(point, F.col("_level")))
    return probes.join(cut, ["_level", "_bin"]).filter(near).drop("_level", "_bin")
