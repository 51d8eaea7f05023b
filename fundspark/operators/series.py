"""Returns, equity and drawdown of a NAV panel (fund_id, dt, nav), and statistics of returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PPY = 252
ANOMALY, MIN_HISTORY = 0.5, 250


def by_date() -> Window:
    return Window.partitionBy("fund_id").orderBy("dt")


def daily_panel(orders: DataFrame, customers: DataFrame, key: str, width: int = 60) -> DataFrame:
    """A NAV-like panel from order totals: the mean order value over the last ``width`` days with orders, per ``key``.

    Totals are summed in whole cents before anything else, so the values are exact. The
    join is left to Catalyst; the aggregate has a map-side part, and the window runs over one row a day and fund.
    """
    x = orders.join(customers, orders.o_custkey == customers.c_custkey)
    daily = x.groupBy(F.col(key).cast("string").alias("fund_id"), F.to_date("o_orderdate").alias("dt")).agg(
        F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"), F.count(F.lit(1)).alias("n")
    )
    w = by_date().rowsBetween(-(width - 1), 0)
    nav = F.sum("cents").over(w).cast("double") / F.sum("n").over(w).cast("double") / 100.0
    return daily.select("fund_id", "dt", nav.alias("nav"), F.row_number().over(by_date()).alias("rn")).where(F.col("rn") >= width).drop("rn")


def returns(nav: DataFrame) -> DataFrame:
    """Simple returns; a pair whose previous NAV is 0 is skipped (status of PRJ-01), the first NAV gives none."""
    prev = F.lag("nav").over(by_date())
    return nav.withColumn("prev", prev).withColumn("r", F.try_divide(F.col("nav"), F.col("prev")) - 1).where(F.col("r").isNotNull()).drop("prev")


def equity(nav: DataFrame) -> DataFrame:
    """Level of 1 invested at the first NAV; the first level emitted is that after the first return."""
    first = F.first("nav").over(by_date().rowsBetween(Window.unboundedPreceding, 0))
    level = F.try_divide(F.col("nav"), first)
    x = nav.withColumn("level", level).withColumn("rn", F.row_number().over(by_date()))
    return x.where(F.col("rn") > 1).drop("rn")


def drawdowns(nav: DataFrame) -> DataFrame:
    """Level over its running maximum, less 1; the initial level isn't in the maximum."""
    peak = F.max("level").over(by_date().rowsBetween(Window.unboundedPreceding, 0))
    return equity(nav).withColumn("dd", F.try_divide(F.col("level"), peak) - 1)


# Statistics as Columns over grouped returns (r) and, where named so, drawdowns (dd) -----------------------------------------------


def ann_return(r: Column, ppy: int = PPY) -> Column:
    return F.avg(r) * ppy


def ann_vol(r: Column, ppy: int = PPY) -> Column:
    """Population deviation; null for fewer than two returns."""
    return F.when(F.count(r) >= 2, F.stddev_pop(r) * F.sqrt(F.lit(float(ppy))))


def downside_dev(r: Column, mar: float = 0.0, ppy: int = PPY) -> Column:
    """Over all returns, not only those below the target."""
    return F.sqrt(F.avg(F.pow(F.least(F.lit(0.0), r - mar / ppy), 2.0))) * F.sqrt(F.lit(float(ppy)))


def cvar(r: Column, rank: Column, n: Column, alpha: float = 0.05) -> Column:
    """Mean loss of the worst max(1, floor(n*alpha)) returns; ``rank`` is theirs in rising order."""
    return -F.avg(F.when(rank <= F.greatest(F.lit(1), F.floor(n * F.lit(alpha))), r))


def value_at_risk(r: Column, rank: Column, n: Column, alpha: float) -> Column:
    return -F.max(F.when(rank == F.greatest(F.lit(1), F.ceil(n * F.lit(alpha))), r))


def ulcer(dd: Column) -> Column:
    return F.sqrt(F.avg(dd * dd))


def ratio(excess: Column, risk: Column) -> Column:
    """Null where there is no risk."""
    return F.when(risk > 0, F.try_divide(excess, risk))


def stats(nav: DataFrame, rf: float = 0.02, ppy: int = PPY) -> DataFrame:
    """All statistics of each fund, in one aggregate over windows that share the partitioning by fund.

    Ratios are null where the risk is 0; skewness needs three and kurtosis four returns, and neither exists for constant returns.
    """
    r = F.col("r")
    by_size = Window.partitionBy("fund_id").orderBy("r", "dt")
    x = drawdowns(nav).withColumn("prev_level", F.coalesce(F.lag("level").over(by_date()), F.lit(1.0)))
    x = x.withColumn("r", F.try_divide(F.col("level"), F.col("prev_level")) - 1)
    x = x.withColumn("k", F.row_number().over(by_size)).withColumn("n", F.count("r").over(Window.partitionBy("fund_id")))
    k, n = F.col("k"), F.col("n")
    base = x.groupBy("fund_id").agg(
        F.count(r).alias("n_returns"),
        ann_return(r, ppy).alias("ann_return"),
        ann_vol(r, ppy).alias("ann_vol"),
        downside_dev(r, rf, ppy).alias("downside_dev"),
        cvar(r, k, n).alias("cvar"),
        (-F.min("dd")).alias("max_drawdown"),
        ulcer(F.col("dd")).alias("ulcer_index"),
        value_at_risk(r, k, n, 0.05).alias("var_95"),
        value_at_risk(r, k, n, 0.01).alias("var_99"),
        F.when(F.count(r) >= 3, F.skewness(r)).alias("skewness"),
        F.when(F.count(r) >= 4, F.kurtosis(r)).alias("kurtosis_excess"),
        F.max(F.abs(r)).alias("max_abs_return"),
    )
    c = F.col
    return base.select(
        "*",
        (c("cvar") * F.sqrt(F.lit(float(ppy)))).alias("cvar_annualized"),
        ratio(c("ann_return") - rf, c("ann_vol")).alias("sharpe"),
        ratio(c("ann_return") - rf, c("downside_dev")).alias("sortino"),
        ratio(c("ann_return") - rf, c("cvar") * F.sqrt(F.lit(float(ppy)))).alias("starr"),
        ratio(c("ann_return") - rf, c("ulcer_index")).alias("martin"),
        ratio(c("ann_return"), c("ulcer_index")).alias("martin_rf0"),
        (c("max_abs_return") > ANOMALY).alias("anomalous"),
    )
