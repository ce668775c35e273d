"""Streams over landing folders: windowed counts with a watermark, and first sightings of keys."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.session import shared_dir


def landing(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of Parquet files as they land at ``path``, a folder or a pattern."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def window_counts(events: DataFrame, time: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Events per window and key; a window comes out once, when no event ``late`` behind can still fall into it."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("events")).select(F.col("w.start").alias("window_start"), *keys, "events")


def first_sightings(events: DataFrame, keys: list[str], time: str | None = None, within: str | None = None) -> DataFrame:
    """Each combination of keys once, when it is first seen.

    Its state grows with the number of combinations, unless ``time`` and ``within`` are given: then a combination is
    forgotten when no event that old can still come, and comes out again if it is seen later.
    """
    if time and within:
        return events.select(*keys, time).withWatermark(time, within).dropDuplicatesWithinWatermark(keys)
    return events.select(*keys).dropDuplicates(keys)


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there now, into a folder in shared storage, and read that."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/strandloom/{name}-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
