"""Queries of the fund operators over the NAV rows and fund sheets. Their SQL would have to read the date notations; the operators' SQL is that of the order panel in ``reference_queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundspark.operators import screening, series, timeseries
from fundspark.plans.tools import Tools

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

PERIODS = ("ytd", "1y", "3y", "5y", "all")


def _over_panel(name: str, f) -> None:
    QUERIES[f"nav_{name}"] = lambda s, d: f(Tools(s, d).panel)


for _name, _f in {
    "fund_stats": series.stats,
    "fund_returns": lambda x: series.returns(x).select("fund_id", "dt", "r"),
    "drawdowns": lambda x: series.drawdowns(x).select("fund_id", "dt", "dd"),
    "rolling_sharpe": lambda x: timeseries.rolling_sharpe(x, 252, 0.02),
    "calendar_returns": timeseries.calendar_returns,
    "monthly_returns": timeseries.monthly_returns,
    "monthly_stats": timeseries.monthly_stats,
    "period_performance": lambda x: timeseries.period_performance(x, PERIODS),
    "period_return_asof": lambda x: timeseries.period_return(x, [("2019-01-01", "2019-12-31"), ("2020-01-01", "2022-12-31")]),
    "underwater_spells": timeseries.underwater_spells,
    "underwater": timeseries.underwater,
    "series_audit": timeseries.nav_audit,
    "head_tail": timeseries.head_tail,
}.items():
    _over_panel(_name, _f)

for _name in screening.CRITERIA:
    QUERIES[f"nav_screen_{_name}"] = lambda s, d, n=_name: Tools(s, d).screen_funds(n, 10)


def _largest(s: SparkSession, d: str) -> list[str]:
    """The five funds with the most assets: what a comparison is asked for, bounded by its own top-k."""
    return [r.fund_id for r in Tools(s, d).screen_funds("encours", 5).collect()]


def nav_compare_largest(s: SparkSession, d: str) -> DataFrame:
    return Tools(s, d).compare_funds(_largest(s, d))


def nav_correlation_largest(s: SparkSession, d: str) -> DataFrame:
    return Tools(s, d).funds_correlation(_largest(s, d))


def sheet_lines(s: SparkSession, d: str) -> DataFrame:
    """All lines of all fund sheets, characteristics and allocation too."""
    return screening.summary_lines(Tools(s, d)._sheets())


QUERIES |= {"nav_compare_largest": nav_compare_largest, "nav_correlation_largest": nav_correlation_largest, "sheet_lines": sheet_lines}
