"""NAV rows to readings: day, moment and value of each row, and the series they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fundspark.functions.timestamps import parse_cells, resolve
from fundspark.functions.zones import named_zones, zone_intervals, zones_in
from fundspark.session import bounded_broadcast, spread

_GROUPING = " '\u2019\u00a0\u2002\u2005\u2007\u2009\u202f\u3000\t"


def nav_number(cell: Column) -> Column:
    """A NAV cell as a double: point or comma as decimal mark, blanks and apostrophes group digits.

    Where both marks occur the last one is the decimal mark; null, blank,
    words, NaN and infinities give null.
    """
    t = F.translate(cell, "," + _GROUPING, ".")
    plain = F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,2})?$"), t)
    both = F.when(
        t.rlike(r"^[+-]?\d+(\.\d+){2,}$"),
        F.concat(F.regexp_replace(F.regexp_replace(t, r"\.\d*$", ""), r"\.", ""), F.regexp_extract(t, r"(\.\d*)$", 1)),
    )
    return F.coalesce(plain, both).try_cast("double")


def nav_rows(spark: SparkSession, nav: DataFrame, feeds: DataFrame, sheets: DataFrame, keep: tuple[str, ...] = ("nav_id",)) -> DataFrame:
    """Each row of ``nav`` (isin, nav_file, date, nav, feed_code and ``keep``) with

    * ``date_status``, ``utc_s``, ``day_written`` of :func:`fundspark.functions.timestamps.resolve`,
    * ``value`` (null where the cell holds no finite number),
    * ``rhythm`` and ``tz_name`` of the fund (null for an isin without sheet),
    * ``day``: the day in the fund's zone, or the day written where there is no clock time or it can't be resolved,
    * ``at_s``: the position on the fund's wall clock, in seconds.

    No shuffle of a large table: the feeds and sheets are broadcast behind a check of their
    number of rows; a sheet table beyond the bound is joined by a shuffle.
    Columns of other names are dropped; repeated feed or sheet keys count once.
    """
    named = feeds.where(F.col("tz_name").isin(*named_zones())).select("tz_name").distinct().collect()
    zones = zone_intervals(spark, tuple(r[0] for r in named) + zones_in(nav, "date"))
    feed_rows, sheet_rows = feeds, sheets
    feeds = feeds.groupBy("feed_code").agg(F.first("tz_name").alias("feed_tz"), F.first("day_first").alias("day_first"))
    sheets = sheets.groupBy(F.col("isin").alias("_isin")).agg(F.first("rhythm").alias("rhythm"), F.first("tz_name").alias("tz_name"))
    rows = spread(nav.select(*dict.fromkeys(("isin", "nav_file", "date", "nav", "feed_code", *keep))))
    rows = rows.join(bounded_broadcast(feeds, feed_rows), "feed_code", "left")
    rows = rows.join(bounded_broadcast(sheets, sheet_rows), F.col("isin") == F.col("_isin"), "left").drop("_isin")
    rows = resolve(parse_cells(rows, "date", F.col("day_first"), F.col("feed_tz")), zones)
    moment = F.timestamp_seconds("utc_s")
    shown = F.when(F.col("tz_name").isNull(), moment).otherwise(F.from_utc_timestamp(moment, F.col("tz_name")))
    at = F.when(F.col("date_status") == "moment", F.unix_seconds(shown)).otherwise(
        F.coalesce(F.col("local_s"), F.unix_date("day_written").cast("bigint") * 86_400)
    )
    rows = rows.withColumn("at_s", at).withColumn("value", nav_number(F.col("nav")))
    rows = rows.withColumn("day", F.date_from_unix_date(F.floor(F.col("at_s") / 86_400).cast("int")))
    return rows.drop("day_first", "feed_tz", "local_s", "fixed_s", "zone_key", "epoch_s", "zone_matches", "zone_offset_s", "has_clock")


def readable(rows: DataFrame) -> DataFrame:
    """Rows whose cell gives a day and whose value is a finite number."""
    return rows.where(F.col("day").isNotNull() & F.col("value").isNotNull())


def latest_delivery(rows: DataFrame) -> DataFrame:
    """One reading per (nav_file, day, at_s): the delivery received last, ties by the higher nav_id.

    One shuffle, on (nav_file, day): a file with any share of the rows is cut
    by day, and the result keeps that partitioning and the order by ``at_s``.
    """
    w = Window.partitionBy("nav_file", "day").orderBy("at_s", F.desc_nulls_last("received_at"), F.desc("nav_id"))
    before = F.lag("at_s").over(w)
    return rows.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col("at_s"))).drop("_before")
