"""The statistics that have a natural streaming form: defect rates and centroids by project.

Rows arrive as files; the additive sums are kept by the state store, so each update costs the
new rows only.  ``foreach_batch`` writes whole results, which makes replays harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "csv", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema).option("header", True)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def running_profile(stream: DataFrame, features: list[str], by: str = "project") -> DataFrame:
    """by, n, defect_rate and the mean of every feature so far."""
    return stream.groupBy(by).agg(F.count("*").alias("n"), F.avg("y").alias("defect_rate"), *[F.avg(c).alias(c) for c in features])


def windowed_rate(stream: DataFrame, time: str, window: str = "1 hour", late: str = "10 minutes", by: str = "project") -> DataFrame:
    """by, window start, n, defect_rate; rows later than ``late`` are left out and their state is freed."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, window), by)
    return w.agg(F.count("*").alias("n"), F.avg("y").alias("defect_rate")).select(by, F.col("window.start").alias("start"), "n", "defect_rate")


def start(result: DataFrame, checkpoint: str, write, mode: str = "complete"):
    """Runs over all files there are; ``write(df, batch_id)`` gets each whole result."""
    return result.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
