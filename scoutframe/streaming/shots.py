"""An addition beyond the batch operators: the shot profile over a stream of event files, by event-time window."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutframe.operators.aggregate import shot_profile
from scoutframe.sources.sinks import shared_folder


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def windowed_profile(shots: DataFrame, time: str = "ts", length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of ``shot_profile`` per window; rows later than ``late`` are left out, as their window is closed.

    Counts are sums, so results can be updated as rows come.
    """
    rows = shots.withWatermark(time, late).withColumn("window", F.window(time, length))
    return shot_profile(rows, ["window"])


def caught_up(windows: DataFrame) -> DataFrame:
    """Runs a stream over all that has arrived, and gives its windows as they then stand, from the shared folder."""
    spark, folder = windows.sparkSession, f"{shared_folder(windows.sparkSession)}/stream-{uuid.uuid4().hex}"

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/windows")

    writer = windows.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").foreachBatch(put)
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(windows.schema).parquet(f"{folder}/windows")
