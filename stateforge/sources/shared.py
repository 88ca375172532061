"""Tables in the folder that driver and executors share: what cuts a plan, and survives lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in a local session that has none, one of its own until the process ends."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="tables-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        place = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def table(df: DataFrame) -> DataFrame:
    """`df`, computed once, as a table of the shared folder."""
    path = f"{folder(df.sparkSession)}/table-{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
