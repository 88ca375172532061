"""The rollout quality gate over shards as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stateforge.operators import schemas


def counted(rollouts: DataFrame, max_new_tokens: int) -> DataFrame:
    """One running row: successful_records, truncated_records.  The state is two numbers, so no watermark is needed."""
    fine = F.col("status") == "success"
    return rollouts.groupBy().agg(F.count_if(fine).alias("successful_records"), F.count_if(fine & (F.col("response_tokens") >= max_new_tokens)).alias("truncated_records"))


def judged(counts: DataFrame, min_samples: int, max_rate: float) -> DataFrame:
    """`counts` with truncation_rate and status."""
    out = counts.withColumn("truncation_rate", F.when(F.col("successful_records") > 0, F.try_divide("truncated_records", "successful_records")).otherwise(0.0))
    enough = F.col("successful_records") >= min_samples
    return out.withColumn("status", F.when(enough & (F.col("truncation_rate") > max_rate), "failed").when(enough, "passed").otherwise("collecting"))


def watch(spark: SparkSession, folder: str, checkpoint: str, on_status: Callable[[dict], None], *, max_new_tokens: int, min_samples: int, max_rate: float, once: bool = False):
    """A streaming query that reports the gate's status after each batch of new shard files."""
    rows = spark.readStream.schema(schemas.ROLLOUT).parquet(folder)

    def report(batch: DataFrame, _: int) -> None:
        for row in batch.collect():
            on_status(row.asDict())

    writer = judged(counted(rows, max_new_tokens), min_samples, max_rate).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(report)
    return (writer.trigger(availableNow=True) if once else writer).start()
