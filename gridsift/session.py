"""The Spark session that the library expects."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

#: Settings of the session's SQL: quoted identifiers as analysts write them, one time zone, adaptive plans.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
}


def configured(spark: SparkSession) -> SparkSession:
    """The session with SETTINGS that can be changed at run time."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def session(app: str = "gridsift", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate files that all of a cluster's machines see: spark.checkpoint.dir, or one of our own where that is unset and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file:///tmp/checkpoints/gridsift"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")
