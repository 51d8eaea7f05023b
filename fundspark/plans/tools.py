"""The tools over one data directory: each gives a DataFrame; failures are values of a ``status`` column or messages that begin with Erreur."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundspark.functions import gate, scalars
from fundspark.operators import retrieval, screening, series, timeseries
from fundspark.operators.readings import nav_rows, readable
from fundspark.plans.catalog import CATALOG, Dataset, Registry
from fundspark.session import tune
from fundspark.sources.tables import table


class Tools:
    """``panel`` (fund_id, dt, nav) is one NAV a fund and day, read from the NAV rows: the last delivery of the day's last moment."""

    def __init__(self, spark: SparkSession, data: str, workspace: str | None = None):
        self.spark, self.data = spark, data
        self.workspace = Path(workspace or ".").resolve()
        self.registry = Registry()
        for key, label, unit in (("fund_sheet", "fund sheets", "funds"), ("documents", "documents", "texts"), ("page_text", "pages", "pages")):
            self.registry.register(Dataset(key, label, unit, lambda s, d, k=key: table(s, d, k)))

    @property
    def panel(self) -> DataFrame:
        t = lambda n: table(self.spark, self.data, n)
        tune(self.spark)
        x = readable(nav_rows(self.spark, t("nav"), t("nav_feed"), t("fund_sheet"), ("nav_id", "received_at")))
        return x.where("isin is not null").groupBy(F.col("isin").alias("fund_id"), F.col("day").alias("dt")).agg(F.max_by("value", F.struct("at_s", "received_at", "nav_id")).alias("nav"))

    def isin_of(self, fund: str) -> str:
        """The isin of a fund asked for by isin or name; ValueError where no name fits, or several do."""
        isin, others = screening.resolve_fund(table(self.spark, self.data, "fund_sheet"), fund)
        if not isin:
            raise ValueError(f"Erreur : several funds fit {fund!r}: " + "; ".join(others) if others else f"Erreur : no fund fits {fund!r}")
        return isin

    def _of(self, *funds: str) -> DataFrame:
        """The panel of funds asked for by isin or name."""
        return self.panel.where(F.col("fund_id").isin(*[self.isin_of(f) for f in funds]))

    def _sheets(self) -> DataFrame:
        x = table(self.spark, self.data, "fund_sheet")
        return x.withColumns({"fund_id": F.col("isin"), "asset_class": F.coalesce(F.try_element_at("characteristics", F.lit(screening.ASSET_KEY)), F.lit("")), "sri": F.col("risk_sri")})

    def rag_search(self, question: str, top_k: int = 3, source: str = "") -> DataFrame:
        """Passages by BM25: over-fetched four times, then cut to the source and to ``max(top_k, 3)``."""
        docs = table(self.spark, self.data, "documents")
        hits = retrieval.bm25(docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")), self.spark.createDataFrame([(1, question)], "query_id int, text string"), 4 * top_k if source else 8)
        hits = hits.join(docs.select(F.col("doc_id").alias("id"), "source", "text"), "id")
        if source:
            hits = hits.where(F.contains(F.lower("source"), F.lit(source.lower())))
        return hits.orderBy("rank").limit(max(top_k, 3)).select("rank", "id", "score", "source", gate.fence(F.col("text")).alias("passage"))

    def list_documents(self) -> DataFrame:
        return table(self.spark, self.data, "documents").where("source is not null").select("source").distinct().orderBy("source")

    def count_funds(self, dataset: str = "") -> DataFrame:
        if dataset:
            found = self.registry.find(dataset)
            return (found.load(self.spark, self.data) if found else self.spark.range(0)).agg(F.count(F.lit(1)).alias("n"))
        navs = table(self.spark, self.data, "nav").select("isin").distinct()
        return table(self.spark, self.data, "fund_sheet").join(navs, "isin", "left_semi").agg(F.count(F.lit(1)).alias("n"))

    def find_fund(self, name: str) -> DataFrame:
        return screening.find_fund(table(self.spark, self.data, "fund_sheet"), name)

    def invested_value(self, fund: str, amount: float | str, period: str = "3y") -> DataFrame:
        """``amount`` may be text such as 10 000 €."""
        if isinstance(amount, str):
            amount = self.spark.range(1).select(scalars.to_amount(F.lit(amount)).alias("x")).first().x
            if amount is None:
                raise ValueError("Erreur : no amount")
        x = timeseries.period_performance(self._of(fund), (period,))
        return x.withColumn("value", amount * (1 + F.col("cumulative"))).withColumn("gain", F.col("value") - amount)

    def compare_funds(self, funds: list[str], rf: float = 0.02) -> DataFrame:
        if len(funds) < 2:
            raise ValueError("Erreur : at least two funds")
        found = {f: screening.resolve_fund(table(self.spark, self.data, "fund_sheet"), f)[0] or f for f in funds}  # one that isn't found is a row too
        asked = self.spark.createDataFrame([(f, i) for f, i in found.items()], "asked string, fund_id string")
        x = series.stats(self.panel.where(F.col("fund_id").isin(*found.values())), rf).select("fund_id", "ann_return", "ann_vol", "max_drawdown", "sharpe", "sortino", "anomalous")
        x = asked.join(x, "fund_id", "left").join(self._sheets().select("fund_id", "name", "sfdr", "sri"), "fund_id", "left")
        return x.withColumn("status", F.when(F.col("ann_return").isNull(), "unavailable").otherwise("ok"))

    def fund_calendar(self, fund: str) -> DataFrame:
        return timeseries.calendar_returns(self._of(fund))

    def fund_period(self, fund: str, start: str, end: str = "") -> DataFrame:
        """Between two dates; a year alone means all of it."""
        if start.isdigit() and len(start) == 4 and not end:
            start, end = f"{start}-01-01", f"{start}-12-31"
        return timeseries.period_return(self._of(fund), [(start, end)])

    def fund_monthly(self, fund: str) -> DataFrame:
        return timeseries.monthly_stats(self._of(fund))

    def fund_underwater(self, fund: str) -> DataFrame:
        return timeseries.underwater(self._of(fund))

    def fund_rolling_sharpe(self, fund: str, window: int = 252, rf: float = 0.0) -> DataFrame:
        return timeseries.rolling_sharpe(self._of(fund), window, rf)

    def funds_correlation(self, funds: list[str]) -> DataFrame:
        if len(funds) < 2:
            raise ValueError("Erreur : at least two funds")
        return timeseries.correlations(self._of(*funds))

    def fund_tail_risk(self, fund: str) -> DataFrame:
        return series.stats(self._of(fund)).select("fund_id", "cvar", "var_95", "var_99", "skewness", "kurtosis_excess")

    def fund_nav_series(self, fund: str, sample: int = 5) -> tuple[DataFrame, DataFrame]:
        x = self._of(fund)
        return timeseries.nav_audit(x), timeseries.head_tail(x, sample)

    def fees_projection(self, fund: str, amount: float, years: int) -> DataFrame:
        x = table(self.spark, self.data, "fund_sheet").where(F.col("isin") == self.isin_of(fund))
        return x.select("isin", screening.fees_projection(float(amount), F.col("costs.ongoing_pct"), years).alias("cost"))

    def fund_summary(self, isin: str, fields: tuple[str, ...] = ()) -> DataFrame:
        return screening.summary_lines(table(self.spark, self.data, "fund_sheet").where(F.col("isin") == self.isin_of(isin)), fields)

    def fund_stats(self, isin: str, rf: float = 0.02) -> DataFrame:
        """With a ``warning`` where a single return is out of proportion."""
        x = series.stats(self._of(isin), rf)
        return x.withColumn("warning", F.when(F.col("anomalous"), "a return above 50 % in one step: check the NAVs"))

    def fund_performance(self, isin: str, periods: tuple[str, ...] = ("ytd", "1y", "3y", "5y")) -> DataFrame:
        return timeseries.period_performance(self._of(isin), periods)

    def screen_funds(self, sort_by: str, top: int = 5, asset_class: str = "", sfdr: str = "", sri: str = "", rf: float = 0.02) -> DataFrame:
        """The best funds by a criterion, each with its profile."""
        sheets, stats = self._sheets(), series.stats(self.panel, rf)
        best = screening.screen(sheets, stats, sort_by, top, asset_class=asset_class, sfdr=sfdr, sri=sri)
        return screening.profile(sheets, stats, best)

    def metric(self, key: str, isin: str = "", returns: list[float] | None = None, values: dict[str, float] | None = None, rf: float = 0.0) -> DataFrame:
        """A catalogue metric from returns if given (magnitudes of 1 or more are percentages), else from the fund's NAVs, else from figures; two metrics are only explained."""
        m = CATALOG[key]
        if m.column is None:
            return self.spark.sql("SELECT CAST(NULL AS DOUBLE) AS value, 'explained' AS status")
        if returns:
            level, rows = 100.0, [(0, 100.0)]
            for k, r in enumerate(returns, 1):
                level *= 1 + (r / 100 if abs(r) >= 1 else r)
                rows.append((k, level))
            nav = self.spark.createDataFrame(rows, "k int, nav double").select(F.lit("given").alias("fund_id"), F.date_add(F.lit("2000-01-01").cast("date"), F.col("k")).alias("dt"), "nav")
        elif isin:
            nav = self._of(isin)
        else:
            from fundspark.plans.catalog import scalar_ratio

            v = scalar_ratio(key, values or {}, rf)
            return self.spark.createDataFrame([(v, "ok" if v is not None else "Erreur : figures missing")], "value double, status string")
        return series.stats(nav, rf).select(F.col(m.column).alias("value"), F.when(F.col(m.column).isNull(), "no risk").otherwise("ok").alias("status"))

    def calculator(self, expression: str) -> float:
        return self.spark.range(1).select(scalars.arithmetic(expression).alias("x")).first().x

    def _inside(self, path: str) -> Path:
        p = (self.workspace / path).resolve()
        if not p.is_relative_to(self.workspace):
            raise PermissionError("Erreur : path outside the workspace")
        return p

    def read_file(self, path: str) -> str:
        return self._inside(path).read_text(encoding="utf-8")

    def write_file(self, path: str, content: str) -> str:
        p = self._inside(path)
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(content, encoding="utf-8")
        return str(p)
