"""Totals over trailing periods, days without activity included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundspark.operators.readings import latest_delivery, readable

WINDOWS = (7, 30)


def daily_totals(rows: DataFrame) -> DataFrame:
    """Number and total of the readings of each (nav_file, day); repeated deliveries of a moment count once, the last one.

    The one shuffle of rows is by (nav_file, day), which cuts a file with any share of them by day.
    """
    x = readable(rows).where(F.col("nav_file").isNotNull()).select("nav_id", "nav_file", "day", "at_s", "value", "received_at")
    return latest_delivery(x).groupBy("nav_file", "day").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def trailing_totals(daily: DataFrame, windows: tuple[int, ...] = WINDOWS, with_totals: bool = True) -> DataFrame:
    """For each file and calendar day from its first to its last reading: ``readings_w``, ``total_w`` and ``average_w`` of the w days ending on it.

    A range-join of the calendar to the daily totals. Coarse date buckets, as
    wide as the longest window, restrict the candidates: a calendar day looks
    only into its own bucket, into which each daily total is copied from the
    bucket before if its window reaches over. Days without readings give 0, null and null.
    Without ``with_totals`` only the numbers of readings come out.

    Daily totals, one row a file and day, are shuffled by file once; both sides of the join read that
    exchange, so they (and the parsing behind them) are computed once.
    """
    widest = max(windows)
    bucket = lambda day: F.floor(F.unix_date(day) / widest)
    daily = daily.where(F.col("nav_file").isNotNull() & F.col("day").isNotNull()).select("nav_file", "day", "n", *["total"] * with_totals).repartition("nav_file")
    # n and total are read on this side too, so that both sides want the same columns and the exchange is one
    read = F.sum("n") + F.count("total") if with_totals else F.sum("n")
    ends = daily.groupBy("nav_file").agg(F.min("day").alias("a"), F.max("day").alias("z"), read.alias("_all")).where("_all > 0")
    calendar = ends.select("nav_file", F.explode(F.sequence("a", "z", F.expr("interval 1 day"))).alias("day")).withColumn("bucket", bucket("day"))
    reach = F.array_distinct(F.array(bucket("day"), bucket(F.date_add("day", widest - 1))))
    totals = daily.withColumn("bucket", F.explode(reach))
    low = F.date_sub("day", widest)
    near = totals.select(F.col("nav_file").alias("_f"), F.col("bucket").alias("_b"), F.col("day").alias("d"), "n", *["total"] * with_totals)
    joined = calendar.join(
        near, (F.col("nav_file") == F.col("_f")) & (F.col("bucket") == F.col("_b")) & (F.col("d") <= F.col("day")) & (F.col("d") > low), "left"
    )
    aggs = []
    for w in windows:
        within = (F.col("d") <= F.col("day")) & (F.col("d") > F.date_sub("day", w))
        aggs.append(F.coalesce(F.sum(F.when(within, F.col("n"))), F.lit(0)).alias(f"readings_{w}"))
        aggs += [F.sum(F.when(within, F.col("total"))).alias(f"total_{w}")] * with_totals
    out = joined.groupBy("nav_file", "bucket", "day").agg(*aggs)
    cols = []
    for w in windows:
        cols.append(f"readings_{w}")
        if with_totals:
            cols += [F.round(f"total_{w}", 4).alias(f"total_{w}"), F.round(F.try_divide(F.col(f"total_{w}"), F.col(f"readings_{w}")), 6).alias(f"average_{w}")]
    return out.select("nav_file", "day", *cols)
