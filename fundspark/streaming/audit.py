"""Event streams: windowed counts with late data, and idempotent ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundspark.sources.readers import upsert


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and totals by event type and window of event time; works on a stream (with a watermark) and on a table."""
    x = events.withColumn("ts", F.col("ts").cast("timestamp"))
    x = x.withWatermark("ts", late) if events.isStreaming else x
    g = x.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def upsert_batches(stream: DataFrame, target: str, key: str, checkpoint: str):
    """Merges each micro-batch into the table under ``target``: a key that comes again replaces its row, in whichever batch.

    The table is a row of version folders, one a batch, written whole under the batch's number, so that a repeated batch
    overwrites its own and reads the version before it; ``current`` gives the last one. Of rows of one key in a batch any one stays.
    """
    def write(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates([key])
        before = versions(batch.sparkSession, target, number)
        merged = upsert(batch.sparkSession.read.parquet(f"{target}/version={before[-1]}"), new, key) if before else new
        merged.write.mode("overwrite").parquet(f"{target}/version={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versions(spark: SparkSession, target: str, below: int | None = None) -> list[int]:
    """Numbers of the complete versions under ``target``, rising, on whatever file system it lies; those below a number."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [(s.getPath().getName(), s.getPath()) for s in fs.listStatus(path)]
    found = sorted(int(n.split("=")[1]) for n, p in names if n.startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))
    return [v for v in found if below is None or v < below]


def current(spark: SparkSession, target: str) -> DataFrame:
    """The table as the last batch left it."""
    return spark.read.parquet(f"{target}/version={versions(spark, target)[-1]}")
