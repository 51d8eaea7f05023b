"""The catalogue of risk metrics and the registry of datasets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Metric:
    """One metric: its name, formula, what it needs, and the column of ``series.stats`` that holds it (none: explained, never computed)."""

    key: str
    name: str
    formula: str
    needs: tuple[str, ...]
    column: str | None


CATALOG = {
    m.key: m
    for m in (
        Metric("sharpe", "Sharpe ratio", "(R - rf) / volatility", ("R", "sigma"), "sharpe"),
        Metric("sortino", "Sortino ratio", "(R - rf) / downside deviation", ("R", "downside_dev"), "sortino"),
        Metric("starr", "STARR", "(R - rf) / annualised CVaR 5 %", ("R", "cvar"), "starr"),
        Metric("martin", "Martin ratio", "(R - rf) / ulcer index", ("R", "ulcer"), "martin"),
        Metric("rdt_max_cvar", "Return under a CVaR bound", "max R with CVaR <= budget", (), None),
        Metric("rdt_max_drawdown", "Return under a drawdown bound", "max R with drawdown <= budget", (), None),
    )
}


def scalar_ratio(key: str, values: dict[str, float], rf: float = 0.0) -> float | None:
    """A ratio from given figures; None where one is missing or the risk isn't positive."""
    metric = CATALOG[key]
    if metric.column is None or any(values.get(n) is None for n in metric.needs):
        return None
    r, risk = (values[n] for n in metric.needs)
    return (r - rf) / risk if risk > 0 else None


@dataclass(frozen=True)
class Dataset:
    key: str
    label: str
    unit: str
    load: Callable[[SparkSession, str], DataFrame]


class Registry:
    """Datasets by key; ``find`` gives the first registered whose key is, or whose label or key holds, the words asked for."""

    def __init__(self) -> None:
        self.sets: dict[str, Dataset] = {}

    def register(self, ds: Dataset) -> None:
        self.sets[ds.key] = ds

    def find(self, query: str) -> Dataset | None:
        q = query.strip().lower()
        return next((d for d in self.sets.values() if q == d.key or q in d.label.lower() or q in d.key), None)
