"""Irregular readings onto a regular grid, by the interval representation.

Each reading holds from its moment to the next one (a step function). Those
intervals are intersected with the cells of the grid, which gives the
time-weighted average and the covered fraction of each cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundspark.operators.readings import latest_delivery, readable

DAY_S = 86_400
#: How long a reading stays valid without another one, in days, by rhythm.
VALID_DAYS = {"weekday": 5, "day": 3, "week": 14, "month": 62}


def is_weekend(day: Column, rhythm: Column) -> Column:
    """Whether no cell holds the day: a Saturday or Sunday under ``weekday``."""
    return (rhythm == "weekday") & (F.weekday(day) > 4)


def period_start(day: Column, rhythm: Column) -> Column:
    """First day of the period: the day itself, Monday, or the 1st; for a day without cell that of the next one."""
    weekday = F.weekday(day)
    return (
        F.when(rhythm == "week", F.date_sub(day, weekday))
        .when(rhythm == "month", F.trunc(day, "month"))
        .when(is_weekend(day, rhythm), F.date_add(day, 7 - weekday))
        .otherwise(day)
    ).cast("date")


def period_end(start: Column, rhythm: Column) -> Column:
    """The day after the period's last one; a Friday ends with its midnight."""
    return F.when(rhythm == "week", F.date_add(start, 7)).when(rhythm == "month", F.add_months(start, 1)).otherwise(F.date_add(start, 1))


def regular_series(rows: DataFrame) -> DataFrame:
    """One row per (nav_file, period) from the first to the last readable reading:

    ``period_start``, ``readings`` (deliveries of the period's own readings
    count once), ``average`` (time-weighted over the covered time, the value
    last known being carried forward; the last value of a period whose readings cover no time),
    ``coverage`` (fraction of the period in which a reading was valid), ``last_value`` (last one valid in the period) and ``status``:
    ``observed``, ``filled`` (no own reading, some validity) or ``missing`` (nothing valid: average and last value are null).

    Under ``weekday`` Saturdays and Sundays have no cell: their readings count
    in none, and only what is still valid on Monday reaches one. A file whose readings all lie there gives no row.
    Null files, and rows that aren't readable, give nothing; an empty table
    an empty result; a fund without rhythm counts by the day. Periods run on the fund's calendar.

    The rows are shuffled once, by (nav_file, day), so a file with any share
    of the rows is cut by day; what remains per file is one row a day.
    """
    x = readable(rows).where(F.col("nav_file").isNotNull())
    x = latest_delivery(x.select("nav_id", "nav_file", "day", "at_s", "value", "received_at", F.coalesce("rhythm", F.lit("day")).alias("rhythm")))
    inside = Window.partitionBy("nav_file", "day").orderBy("at_s")
    until = F.lead("at_s").over(inside)
    x = x.withColumn("_until", until)
    span = F.col("_until") - F.col("at_s")
    days = x.groupBy("nav_file", "day").agg(
        F.first("rhythm").alias("rhythm"),
        F.count(F.lit(1)).alias("readings"),
        F.sum(F.col("value") * span).alias("area"),
        F.sum(span).alias("covered"),
        F.min("at_s").alias("first_s"),
        F.max("at_s").alias("last_s"),
        F.max(F.when(F.col("_until").isNull(), F.col("value"))).alias("last_value"),
    )
    # the last reading of a day holds until the first one of the next day with readings, at most VALID_DAYS
    by_file = Window.partitionBy("nav_file").orderBy("day")
    rhythm = F.col("rhythm")
    valid = F.lit(None).cast("bigint")
    for name, n in VALID_DAYS.items():
        valid = F.coalesce(F.when(rhythm == name, n * DAY_S), valid)
    days = days.withColumn("_next_s", F.lead("first_s").over(by_file)).withColumn("_next", F.lead("day").over(by_file))
    days = days.withColumn("_off", is_weekend(F.col("day"), rhythm)).withColumn("cell", period_start(F.col("day"), rhythm))
    days = days.withColumn("_end_s", F.least(F.coalesce("_next_s", F.col("last_s")), F.col("last_s") + valid))
    # cells that begin after this day's own and up to the next reading's, that one included: its first part is met by this interval
    next_cell = F.when(is_weekend(F.col("_next"), rhythm), F.date_sub("_next", F.weekday("_next") - 4)).otherwise(period_start(F.col("_next"), rhythm))
    begin = F.when(rhythm == "month", F.add_months("cell", 1)).when(rhythm == "week", F.date_add("cell", 7)).when(F.col("_off"), F.col("cell")).otherwise(F.date_add("cell", 1))
    later = (
        F.when(next_cell.isNull() | (next_cell < begin), F.expr("cast(array() as array<date>)"))
        .when(rhythm == "month", F.sequence(begin, F.greatest(next_cell, begin), F.expr("interval 1 month")))
        .when(rhythm == "week", F.sequence(begin, F.greatest(next_cell, begin), F.expr("interval 7 day")))
        .otherwise(F.sequence(begin, F.greatest(next_cell, begin), F.expr("interval 1 day")))
    )
    later = F.when(rhythm == "weekday", F.filter(later, lambda c: F.weekday(c) < 5)).otherwise(later)
    cells = F.when(F.col("_off"), later).otherwise(F.concat(F.array("cell"), later))
    pieces = days.withColumn("period_start", F.explode(cells))
    lo = F.unix_date("period_start").cast("bigint") * DAY_S
    hi = F.unix_date(period_end(F.col("period_start"), rhythm)).cast("bigint") * DAY_S
    tail = F.greatest(F.least(hi, F.col("_end_s")) - F.greatest(lo, F.col("last_s")), F.lit(0))
    home = (F.col("period_start") == F.col("cell")) & ~F.col("_off")
    met = home | (tail > 0)
    grid = pieces.groupBy("nav_file", "period_start").agg(
        F.first("rhythm").alias("rhythm"),
        F.sum(F.when(home, F.col("readings")).otherwise(0)).alias("readings"),
        F.sum(F.when(home, F.coalesce("area", F.lit(0.0))).otherwise(0.0) + F.col("last_value") * tail).alias("area"),
        F.sum(F.when(home, F.coalesce("covered", F.lit(0))).otherwise(0) + tail).alias("covered"),
        F.max(hi - lo).alias("length"),
        F.max_by(F.when(met, F.col("last_value")), F.when(met, F.col("last_s"))).alias("last_value"),
    )
    average = F.coalesce(F.try_divide(F.col("area"), F.col("covered").cast("double")), F.when(F.col("readings") > 0, F.col("last_value")))
    return grid.select(
        "nav_file",
        "period_start",
        "rhythm",
        "readings",
        F.round(average, 6).alias("average"),
        F.round(F.col("covered") / F.col("length"), 6).alias("coverage"),
        "last_value",
        F.when(F.col("readings") > 0, "observed").when(F.col("covered") > 0, "filled").otherwise("missing").alias("status"),
    )
