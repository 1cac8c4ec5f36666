"""Structured Streaming forms of capture ingestion: dedup, inventory and version upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lares.operators.versions import PRICE, one_per_instant, versions
from lares.session import cut


def deduplicated(stream: DataFrame, delay: str = "30 days") -> DataFrame:
    """Drops repeats of a listing's capture seen again within the watermark."""
    return stream.withWatermark("captured", delay).dropDuplicatesWithinWatermark(["unit_key", "captured"])


def daily_inventory(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Captures per surface and day; a day closes once the watermark has passed it."""
    return (
        stream.withWatermark("captured", delay)
        .groupBy(F.window("captured", "1 day"), "surface").agg(F.count("*").alias("captures"))
        .select(F.to_date("window.start").alias("day"), "surface", "captures"))


def keep_versions(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Maintains the versions at ``path`` from a stream of captures, which may come in any order.

    ``path`` holds two append logs with a folder per batch: the captures, and the versions of the
    units each batch touched, recomputed from all their captures. Nothing older is rewritten; a
    replayed batch writes its folders again. ``current_versions`` reads the table, ``compact``
    folds the logs when many batches have gathered.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = cut(one_per_instant(batch).select("unit_key", "captured", *PRICE, "event_id"))
        new.write.mode("overwrite").parquet(f"{path}/captures/batch={batch_id}")
        touched = new.select("unit_key").distinct()
        known = spark.read.parquet(f"{path}/captures").drop("batch").join(touched, "unit_key", "left_semi")
        versions(one_per_instant(known)).write.mode("overwrite").parquet(f"{path}/versions/batch={batch_id}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_versions(spark: SparkSession, path: str) -> DataFrame:
    """The versions of every unit, from the last batch that touched it."""
    log = spark.read.parquet(f"{path}/versions")
    last = log.groupBy("unit_key").agg(F.max("batch").alias("batch"))
    return log.join(last, ["unit_key", "batch"]).drop("batch")


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Write both logs as one batch each under ``target``, to continue from there."""
    spark.read.parquet(f"{path}/captures").drop("batch").write.parquet(f"{target}/captures/batch=-1")
    current_versions(spark, path).write.parquet(f"{target}/versions/batch=-1")
