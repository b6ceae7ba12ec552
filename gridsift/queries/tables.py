"""The driver's tables, and row numbers for them by their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ROW

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str) -> None:
    """The tables as temporary views."""
    for name in NAMES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def numbered(df: DataFrame, key: str, first: int = 0) -> DataFrame:
    """df with row numbers taken from a gapless key that starts at first: no sort, no window."""
    return df.withColumn(ROW, F.col(key).cast("long") - first)
