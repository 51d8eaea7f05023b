"""Search, filtering and ranking of funds by their sheets and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundspark.operators.series import ANOMALY, MIN_HISTORY

# criterion -> (column, falling order); the sheet's own assets need no history
CRITERIA = {
    "sharpe": ("sharpe", True), "sortino": ("sortino", True), "rendement": ("ann_return", True),
    "volatilite": ("ann_vol", False), "max_drawdown": ("max_drawdown", False), "encours": ("aum", True),
}
ASSET_KEY = "Classe d'actifs"


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def sheet_filter(asset_class: str = "", sfdr: str = "", sri: str = "") -> Column:
    """Asset class by substring, SFDR digits by substring, SRI by equality; an empty argument doesn't filter, a null cell never fits a filter."""
    keep = F.lit(True)
    if asset_class:
        keep &= F.contains(F.lower(F.col("asset_class")), F.lit(asset_class.lower()))
    if sfdr:
        keep &= F.contains(digits(F.col("sfdr")), F.lit("".join(ch for ch in sfdr if ch.isdigit())))
    if sri:
        keep &= digits(F.col("sri").cast("string")) == F.lit(sri.strip())
    return keep


def screen(sheets: DataFrame, stats: DataFrame, sort_by: str, top: int = 5, **filters: str) -> DataFrame:
    """The ``top`` funds by a criterion, ties by fund_id. Cheap filters on sheets come first; the limit is the feature (TakeOrdered, no full sort)."""
    if sort_by not in CRITERIA:
        raise ValueError(f"unknown criterion {sort_by!r}: {', '.join(CRITERIA)}")
    column, falling = CRITERIA[sort_by]
    kept = sheets.where(sheet_filter(**filters))
    if column == "aum":
        x = kept.where(F.col("aum").isNotNull()).select("fund_id", F.col("aum").alias("value"))
    else:
        sound = stats.where((F.col("n_returns") >= MIN_HISTORY) & (F.col("max_abs_return") <= ANOMALY) & F.col(column).isNotNull())
        x = kept.join(sound, "fund_id").select("fund_id", F.col(column).alias("value"))
    order = (F.desc("value") if falling else F.asc("value"), F.asc("fund_id"))
    best = x.orderBy(*order).limit(max(1, int(top)))
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("rank", "fund_id", "value")


def find_fund(sheets: DataFrame, query: str, most: int = 8) -> DataFrame:
    """Funds by name: an ISIN wins; else those with the most query words in the name, shorter names first, then falling ISIN."""
    words = [w for w in F_split(query) if w]
    name = F.lower(F.coalesce("name", F.lit("")))
    hits = sum((F.contains(name, F.lit(w)).cast("int") for w in words), F.lit(0))
    exact = F.upper("isin") == query.strip().upper()
    x = sheets.select("isin", "name", hits.alias("hits"), exact.alias("exact")).where((F.col("hits") > 0) | F.col("exact"))
    some_exact, most_hits = x.agg(F.max("exact")).scalar(), x.agg(F.max("hits")).scalar()
    x = x.where(F.when(some_exact, F.col("exact")).otherwise(F.col("hits") == most_hits))
    return x.select("isin", "name", F.col("hits").cast("int").alias("hits")).orderBy(F.desc("hits"), F.length(F.coalesce("name", F.lit(""))), F.desc("isin")).limit(most)


def F_split(query: str) -> list[str]:
    import re

    return re.split(r"[\s\-/]+", query.lower().strip())


# Label and column of a sheet's lines, in order; the costs, which come out whole or not at all.
LINES = (("nom", "name"), ("isin", "isin"), ("devise", "currency"), ("type de part", "share_type"), ("vl", "nav"), ("date vl", "nav_date"), ("encours", "aum"), ("date encours", "aum_date"), ("sfdr", "sfdr"), ("sri", "risk_sri"), ("indice", "benchmark"))
COST_LINES = (("frais entree", "entry_pct"), ("frais sortie", "exit_pct"), ("frais courants", "ongoing_pct"), ("frais transaction", "transaction_pct"), ("frais performance", "performance_pct"))


def summary_lines(sheets: DataFrame, wanted: tuple[str, ...] = ()) -> DataFrame:
    """(isin, ord, label, value) of the lines of a fund's sheet: fields, characteristics, performances of the year (entries of the allocation whose label tells of one), the rest of the allocation, costs.

    Nulls are dropped, of equal lines the first stays. ``wanted`` filters by words of the labels; one word of a cost keeps the whole block of costs.
    """
    line = lambda ord, label, value, cost=False: F.struct(F.lit(ord).cast("int").alias("ord"), label.alias("label"), value.cast("string").alias("value"), F.lit(cost).alias("cost"))
    parts = [F.array(*[line(k, F.lit(label), F.col(c)) for k, (label, c) in enumerate(LINES)])]
    if "characteristics" in sheets.columns:
        entries = F.array_sort(F.map_entries("characteristics"))
        parts.append(F.coalesce(F.transform(entries, lambda e: line(100, F.lower(e["key"]), e["value"])), F.expr("array()")))
    if "asset_allocation" in sheets.columns:
        gain = lambda e: F.contains(F.lower(F.coalesce(e["label"], F.lit(""))), F.lit("perf"))
        parts.append(F.coalesce(F.transform(F.filter("asset_allocation", gain), lambda e: line(200, F.lower(e["label"]), e["pct"])), F.expr("array()")))
        parts.append(F.coalesce(F.transform(F.filter("asset_allocation", lambda e: ~gain(e)), lambda e: line(300, F.lower(e["label"]), e["pct"])), F.expr("array()")))
    parts.append(F.array(*[line(400 + k, F.lit(label), F.col(f"costs.{c}"), True) for k, (label, c) in enumerate(COST_LINES)]))
    x = sheets.select(F.col("isin").alias("key"), F.explode(F.array_distinct(F.concat(*parts))).alias("l")).select(F.col("key").alias("isin"), "l.*").where(F.col("value").isNotNull() & F.col("label").isNotNull())
    low = [w.lower() for w in wanted if w]
    if low:
        touches_costs = any(w in label for w in low for label, _ in COST_LINES)
        fits = F.exists(F.array(*[F.lit(w) for w in low]), lambda w: F.contains(F.col("label"), w))
        x = x.where(F.when(F.col("cost"), F.lit(touches_costs)).otherwise(fits))
    return x.drop("cost")


def profile(sheets: DataFrame, stats: DataFrame, screened: DataFrame) -> DataFrame:
    """Screened funds (rank, fund_id, value) with what tells them apart: name, asset class, SFDR, SRI, assets, and their return, volatility and drawdown where known."""
    x = screened.join(sheets.select("fund_id", "name", "asset_class", "sfdr", F.col("sri").cast("string").alias("sri"), "aum"), "fund_id")
    return x.join(stats.select("fund_id", "ann_return", "ann_vol", "max_drawdown"), "fund_id", "left")


def resolve_fund(sheets: DataFrame, asked: str) -> tuple[str, list[str]]:
    """(isin, []) of a fund asked for by isin or by words of its name, or ('', candidates) where several names fit as well, or none."""
    rows = find_fund(sheets, asked).collect()  # at most eight
    if not rows:
        return "", []
    if len(rows) == 1 or rows[0].isin.upper() == asked.strip().upper():
        return rows[0].isin, []
    return "", [f"{r.isin} {r.name}" for r in rows]


def fees_projection(amount: float, pct: Column, years: int) -> Column:
    """What is lost to a yearly fee of ``pct`` percent."""
    return F.lit(amount) - F.lit(amount) * F.pow(1 - pct / 100, F.lit(float(years)))
