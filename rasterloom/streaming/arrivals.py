"""A folder of images as a stream: each micro-batch runs the batch plan, so that results are those of a batch run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "image_id long, y int, x int, r double, g double, b double"


def trace_arrivals(spark: SparkSession, source: str, sink: str, checkpoint: str, plan: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Pixel tables (Parquet) that arrive under source go through plan and are written under sink, a folder a batch.

    The checkpoint makes each file count once; a batch that runs again overwrites its own folder.
    """
    arriving = spark.readStream.schema(SCHEMA).parquet(source)

    def run(batch: DataFrame, number: int) -> None:
        plan(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return arriving.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
