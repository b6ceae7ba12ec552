"""Exact quantiles and medians of groups of any size.

Values are counted first, so equal ones are one row. They are dealt to tiles, equal ranges by count over the whole table; how many rows of a
group each tile holds tells in which tile each quantile lies, and only there values are put in order. No task holds more of a group than a tile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import inequality
from .inequality import cuts_of, number, tile_of


def exact_quantiles(df: DataFrame, by: list[str], column: str, quantiles: dict[str, float]) -> DataFrame:
    """`by` and a column for each quantile (name: share from 0 to 1), interpolated between the two rows that it lies between. Nulls don't count; a group of nulls alone has nulls."""
    if not all(0 <= q <= 1 for q in quantiles.values()):
        raise ValueError("quantiles are shares from 0 to 1")
    keys = [f"_by{i}" for i in range(len(by))]
    named = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)], number(df, column).alias("x"))
    counts = named.filter("x IS NOT NULL").groupBy(*keys, "x").agg(F.count("*").alias("n"))
    tiles = min(inequality.MOST_TILES, 1 << max(0, (counts.count() // inequality.TILE_ROWS).bit_length()))
    counts = counts.withColumn("tile", tile_of(F.col("x"), cuts_of(counts.select("x"), tiles)))
    in_tile = counts.groupBy(*keys, "tile").agg(F.sum("n").alias("rows"))
    along = W.Window.partitionBy(*keys).orderBy("tile")
    in_tile = in_tile.withColumns({"before": F.sum("rows").over(along) - F.col("rows"), "total": F.sum("rows").over(W.Window.partitionBy(*keys))})
    # The rows, from 0, between which a quantile lies.
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(q)).alias("q")) for name, q in quantiles.items()]))
    asked = in_tile.withColumn("a", asked).withColumn("at", F.col("a.q") * (F.col("total") - 1))
    ends = asked.withColumn("end", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))))
    wanted = ends.filter((F.col("end") >= F.col("before")) & (F.col("end") < F.col("before") + F.col("rows"))).select(*keys, "tile", "before", F.col("a.name").alias("name"), "at", "end")
    apart = lambda other, prefix: other.toDF(*[f"{prefix}{c}" for c in other.columns])
    same = lambda prefix: [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in [*keys, "tile"]]
    places = apart(wanted.select(*keys, "tile", "before").distinct(), "p")
    near = counts.join(places, same("p")).select(*keys, "tile", "x", "n", F.col("pbefore").alias("before"))
    in_order = W.Window.partitionBy(*keys, "tile").orderBy("x").rowsBetween(W.Window.unboundedPreceding, 0)
    near = near.withColumn("to", F.col("before") + F.sum("n").over(in_order)).withColumn("from", F.col("to") - F.col("n"))
    met = near.join(apart(wanted, "w"), [*same("w"), F.col("wend") >= F.col("from"), F.col("wend") < F.col("to")]).select(*keys, F.col("wname").alias("name"), F.col("wat").alias("at"), "x")
    values = met.groupBy(*keys, "name").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.first(F.col("at") - F.floor("at")).alias("share"))
    values = values.withColumn("value", F.col("low") + (F.col("high") - F.col("low")) * F.col("share"))
    out = values.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in quantiles])
    groups = named.select(*keys).distinct() if keys else df.sparkSession.range(1).select(F.lit(1).alias("_one"))
    out = out.toDF(*[f"o{k}" for k in keys], *quantiles)
    joined = groups.join(out, [F.col(k).eqNullSafe(F.col(f"o{k}")) for k in keys] if keys else F.lit(True), "left")
    return joined.select(*[F.col(k).alias(c) for k, c in zip(keys, by)], *quantiles)
