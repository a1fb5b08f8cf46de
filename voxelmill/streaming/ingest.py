"""Incremental intake of manifest rows: an addition for cohorts that grow while they are used; batch results don't depend on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def manifest_stream(spark: SparkSession, folder: str, schema, most_files: int = 100) -> DataFrame:
    """New Parquet files of ``folder`` as a stream, ``most_files`` in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(folder)


def first_deliveries(rows: DataFrame, key: str = "patch_id", moment: str = "loaded_at", late: str = "7 days") -> DataFrame:
    """Each patch once, by its first delivery within ``late``; state older than the watermark is dropped. Null keys are left out."""
    return rows.where(F.col(key).isNotNull()).withWatermark(moment, late).dropDuplicatesWithinWatermark([key])


def arrivals(rows: DataFrame, by: str = "sample_id", moment: str = "loaded_at", window: str = "1 hour", late: str = "7 days") -> DataFrame:
    """Patches that arrived for each value of ``by`` in tumbling windows."""
    counts = rows.withWatermark(moment, late).groupBy(F.window(moment, window).alias("span"), by).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("span.start").alias("from"), F.col("span.end").alias("to"), by, "n")


def append(rows: DataFrame, folder: str, state: str) -> StreamingQuery:
    """Write what has arrived to ``folder`` exactly once and stop; ``state`` remembers how far it came."""
    return rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
