"""Calendar, rolling, as-of and underwater views of a NAV panel (fund_id, dt, nav)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundspark.operators.series import PPY, by_date, ratio, returns

PERIOD_DAYS = {"1y": 365, "3y": 1095, "5y": 1825}


def rolling_sharpe_points(nav: DataFrame, window: int = 252, rf: float = 0.0) -> DataFrame:
    """Sharpe ratio of each window of ``max(20, window)`` returns; null where a window has no variation."""
    w = max(20, int(window))
    frame = by_date().rowsBetween(-(w - 1), 0)
    x = returns(nav).withColumn("k", F.row_number().over(by_date()))
    vol = F.stddev_pop("r").over(frame) * F.sqrt(F.lit(float(PPY)))
    mean = F.avg("r").over(frame) * PPY
    x = x.withColumn("mean", mean).withColumn("vol", vol).where(F.col("k") >= w)
    return x.select("fund_id", "dt", ratio(F.col("mean") - rf, F.col("vol")).alias("rolling_sharpe"))


def rolling_sharpe(nav: DataFrame, window: int = 252, rf: float = 0.0) -> DataFrame:
    """Summary of the windows, a row for every fund; status ``insufficient`` with fewer than two windows (none at all included), ``zero_vol`` where one has no variation (as it fails the whole call)."""
    points = rolling_sharpe_points(nav, window, rf)
    s = F.col("rolling_sharpe")
    x = points.groupBy("fund_id").agg(
        F.count(F.lit(1)).alias("windows"), F.min(s).alias("lo"), F.max(s).alias("hi"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("sd"),
        F.max_by(s, "dt").alias("last"), F.max(s.isNull()).alias("flat"),
    )
    x = nav.select("fund_id").distinct().join(x, "fund_id", "left").withColumn("windows", F.coalesce("windows", F.lit(0)))
    status = F.when(F.col("windows") < 2, "insufficient").when(F.col("flat"), "zero_vol").otherwise("ok")
    ok = status == "ok"
    return x.select("fund_id", "windows", *[F.when(ok, F.col(c)).alias(c) for c in ("lo", "hi", "mean", "sd", "last")], status.alias("status"))


def _bucket_returns(nav: DataFrame, bucket: Column) -> DataFrame:
    """Last NAV of each bucket over the last one of the previous present bucket; the first bucket's base is the first NAV."""
    ends = nav.groupBy("fund_id", bucket.alias("period")).agg(F.max_by("nav", "dt").alias("last"), F.min_by("nav", "dt").alias("first"))
    w = Window.partitionBy("fund_id").orderBy("period")
    base = F.coalesce(F.lag("last").over(w), F.first("first").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return ends.withColumn("ret", F.try_divide(F.col("last"), base) - 1).where(F.col("ret").isNotNull()).select("fund_id", "period", "ret")


def calendar_returns(nav: DataFrame) -> DataFrame:
    return _bucket_returns(nav, F.year("dt"))


def monthly_returns(nav: DataFrame) -> DataFrame:
    return _bucket_returns(nav, F.date_format("dt", "yyyy-MM"))


def monthly_stats(nav: DataFrame) -> DataFrame:
    """Best, worst, share of positive months and mean; among equal months the earliest."""
    x = monthly_returns(nav)
    best = F.min_by(F.struct("period", "ret"), F.struct(-F.col("ret"), "period"))
    worst = F.min_by(F.struct("period", "ret"), F.struct("ret", "period"))
    x = x.groupBy("fund_id").agg(
        F.count(F.lit(1)).alias("months"), best.alias("b"), worst.alias("w"), F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("positive"), F.avg("ret").alias("mean")
    )
    return x.select(
        "fund_id", "months", F.col("b.period").alias("best_month"), F.col("b.ret").alias("best"), F.col("w.period").alias("worst_month"), F.col("w.ret").alias("worst"), "positive", "mean"
    )


def period_performance(nav: DataFrame, periods: tuple[str, ...] = ("ytd", "1y", "3y", "5y", "all")) -> DataFrame:
    """Cumulative and annualised return from the first NAV on or after the cutoff; a period of unknown name means all."""
    ends = nav.groupBy("fund_id").agg(F.max("dt").alias("z"), F.min("dt").alias("a"))
    p = F.col("period")
    cut = F.when(p == "ytd", F.trunc("z", "year"))
    for name, days in PERIOD_DAYS.items():
        cut = cut.when(p == name, F.date_sub("z", days))
    bounds = ends.withColumn("period", F.explode(F.array(*[F.lit(x) for x in periods]))).withColumn("cut", F.coalesce(cut, F.col("a")))
    # bounds hold a few rows a fund, so they go to the NAVs' partitioning rather than the other way round
    x = nav.join(bounds, "fund_id").where(F.col("dt") >= F.col("cut"))
    x = x.groupBy("fund_id", "period").agg(
        F.min("dt").alias("d0"), F.max("dt").alias("d1"), F.min_by("nav", "dt").alias("n0"), F.max_by("nav", "dt").alias("n1"), F.count(F.lit(1)).alias("points")
    )
    cum = F.try_divide(F.col("n1"), F.col("n0")) - 1
    years = F.greatest(F.datediff("d1", "d0") / F.lit(365.25), F.lit(1e-9))
    ok = F.col("points") >= 2
    return x.select("fund_id", "period", "d0", "d1", F.when(ok, cum).alias("cumulative"), F.when(ok & (cum > -1), F.pow(1 + cum, 1 / years) - 1).alias("annualised"))


def period_return(nav: DataFrame, bounds: list[tuple[str, str]]) -> DataFrame:
    """Return between the last NAVs on or before each pair of dates; status ``unavailable`` before the first NAV. One pass for all bounds."""
    b = F.explode(F.array(*[F.struct(F.lit(x).cast("date").alias("a"), F.lit(y).cast("date").alias("z")) for x, y in bounds]))
    x = nav.withColumn("b", b).select("fund_id", "dt", "nav", "b.a", "b.z")
    at = lambda c: F.max_by(F.when(F.col("dt") <= F.col(c), F.col("nav")), F.when(F.col("dt") <= F.col(c), F.col("dt")))
    x = x.groupBy("fund_id", "a", "z").agg(at("a").alias("n0"), at("z").alias("n1"))
    ret = F.try_divide(F.col("n1"), F.col("n0")) - 1
    return x.select("fund_id", "a", "z", ret.alias("ret"), F.when(ret.isNull(), "unavailable").otherwise("ok").alias("status"))


def underwater_spells(nav: DataFrame) -> DataFrame:
    """Spells below a peak, from the peak's date to the recovery (equality counts) or, if open, to the last date."""
    w = by_date()
    x = nav.withColumn("peak_before", F.max("nav").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("is_peak", F.col("peak_before").isNull() | (F.col("nav") >= F.col("peak_before")))
    x = x.withColumn("peak_dt", F.last(F.when(F.col("is_peak"), F.col("dt")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("peak", F.max("nav").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("next_dt", F.lead("dt").over(w)).withColumn("next_peak", F.lead("is_peak").over(w))
    low = x.where(~F.col("is_peak"))
    depth = F.col("nav") / F.col("peak") - 1
    g = low.groupBy("fund_id", "peak_dt").agg(
        F.min_by(F.struct(F.col("dt").alias("trough_dt"), depth.alias("depth")), F.struct(depth, "dt")).alias("t"),
        F.max("dt").alias("last_low"), F.max_by("next_dt", "dt").alias("end_dt"),
    )
    return g.select(
        "fund_id", "peak_dt", F.col("t.trough_dt").alias("trough_dt"), F.col("t.depth").alias("depth"), F.coalesce("end_dt", "last_low").alias("end_dt"),
        F.datediff(F.coalesce("end_dt", "last_low"), "peak_dt").alias("days"), F.col("end_dt").isNotNull().alias("recovered"),
    )


def underwater(nav: DataFrame) -> DataFrame:
    """Deepest trough (the first of equal ones, the first NAV counts as a peak) and the longest spell of each fund."""
    s = underwater_spells(nav)
    deepest = F.min_by(F.struct("peak_dt", "trough_dt", "depth"), F.struct("depth", "trough_dt"))
    x = s.groupBy("fund_id").agg(deepest.alias("d"), F.max("days").alias("longest_days"), F.count(F.lit(1)).alias("spells"))
    return x.select("fund_id", (-F.col("d.depth")).alias("max_dd"), F.col("d.peak_dt").alias("peak_dt"), F.col("d.trough_dt").alias("trough_dt"), "longest_days", "spells")


def nav_audit(nav: DataFrame) -> DataFrame:
    return nav.groupBy("fund_id").agg(F.count(F.lit(1)).alias("n"), F.min("dt").alias("d0"), F.max("dt").alias("d1"), F.min("nav").alias("lo"), F.max("nav").alias("hi"))


def head_tail(nav: DataFrame, k: int = 5) -> DataFrame:
    """First and last ``k`` rows of each fund; with fewer than 2k rows the ends overlap."""
    x = nav.withColumn("i", F.row_number().over(by_date())).withColumn("j", F.row_number().over(Window.partitionBy("fund_id").orderBy(F.desc("dt"))))
    ends = F.array(F.when(F.col("i") <= k, "head"), F.when(F.col("j") <= k, "tail"))
    return x.withColumn("part", F.explode(F.filter(ends, lambda e: e.isNotNull()))).select("fund_id", "part", "dt", "nav")


def correlations(nav: DataFrame, min_common: int = 30) -> DataFrame:
    """Correlation of each pair of the funds in ``nav``, over returns recomputed on their common dates: for a list of funds that is asked for, not for all there are.

    A self-join on the date; a fund has one row a date, so a date's group is
    bounded by the length of that list. A date is dropped when either previous NAV is 0; a constant series gives null.
    """
    a = nav.select("dt", F.col("fund_id").alias("fund_a"), F.col("nav").alias("x"))
    b = nav.select("dt", F.col("fund_id").alias("fund_b"), F.col("nav").alias("y"))
    w = Window.partitionBy("fund_a", "fund_b").orderBy("dt")
    p = a.join(b, "dt").where(F.col("fund_a") < F.col("fund_b"))
    p = p.withColumn("px", F.lag("x").over(w)).withColumn("py", F.lag("y").over(w))
    p = p.withColumn("rx", F.try_divide(F.col("x"), F.col("px")) - 1).withColumn("ry", F.try_divide(F.col("y"), F.col("py")) - 1)
    g = p.groupBy("fund_a", "fund_b").agg(
        F.count(F.lit(1)).alias("common"), F.covar_pop("rx", "ry").alias("c"), F.stddev_pop(F.when(F.col("ry").isNotNull(), F.col("rx"))).alias("sx"), F.stddev_pop(F.when(F.col("rx").isNotNull(), F.col("ry"))).alias("sy")
    )
    rho = F.when((F.col("common") >= min_common) & (F.col("sx") > 0) & (F.col("sy") > 0), F.try_divide(F.col("c"), F.col("sx") * F.col("sy")))
    return g.select("fund_a", "fund_b", "common", rho.alias("correlation"), F.when(F.col("common") < min_common, "insufficient").otherwise("ok").alias("status"))
