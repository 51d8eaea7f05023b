"""Queries on the NAV rows and the dirty fields of the core problems (p3 to p7)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundspark.functions.timestamps import parse_cells, resolve
from fundspark.functions.zones import zone_intervals, zones_in
from fundspark.operators.grid import regular_series
from fundspark.operators.moments import same_moment_pairs
from fundspark.operators.readings import nav_rows
from fundspark.operators.rolling import daily_totals, trailing_totals
from fundspark.operators.spikes import implausible
from fundspark.operators.units import quantities, same_quantity_pairs
from fundspark.session import tune
from fundspark.sources.tables import table


def _rows(spark: SparkSession, d: str, keep: tuple[str, ...] = ("nav_id", "received_at")) -> DataFrame:
    tune(spark)
    return nav_rows(spark, table(spark, d, "nav"), table(spark, d, "nav_feed"), table(spark, d, "fund_sheet"), keep)


def _prospectus_dates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "prospectus_data").select("prospectus_id", "isin", "date_document")
    return resolve(parse_cells(rows, "date_document"), zone_intervals(spark, zones_in(rows, "date_document")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return implausible(_rows(spark, d)).select("nav_id").distinct()


def p3_flags(spark: SparkSession, d: str) -> DataFrame:
    """Each implausible row with its kind (impossible, spike, frozen) and score."""
    return implausible(_rows(spark, d))


#: Cells of quantities: kind, table, key, fields.
UNIT_FIELDS = (
    ("fee", "fund_summaries", "summary_id", ("frais_gestion_annuels", "frais_entree_max")),
    ("amount", "fund_summaries", "summary_id", ("actif_net",)),
    ("amount", "prospectus_data", "prospectus_id", ("valeur_initiale_part",)),
)


def p4_quantities(spark: SparkSession, d: str) -> DataFrame:
    """Each cell of the four fields as one number in the common unit, with its currency for amounts."""
    return _quantities(spark, d).select("field", "id", "isin", "quantity", "currency")


def _quantities(spark: SparkSession, d: str) -> DataFrame:
    """The cells of all fields, one row each (a table's fields of one kind from one scan), with quantity and currency."""
    sources, parts = table(spark, d, "source_units"), []
    for kind in ("fee", "amount"):
        cells = [
            table(spark, d, name).select(
                F.col(key).alias("id"), "isin", "extracted_by", "devise", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("cell")) for f in fields])).alias("c")
            )
            for k, name, key, fields in UNIT_FIELDS
            if k == kind
        ]
        rows = reduce(DataFrame.unionByName, cells).select("id", "isin", "extracted_by", "devise", "c.field", "c.cell")
        parts.append(quantities(spark, rows, "cell", sources, kind))
    return reduce(DataFrame.unionByName, parts)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return same_quantity_pairs(_quantities(spark, d), "id", "cell", "field")


def p5_moments(spark: SparkSession, d: str) -> DataFrame:
    """Each NAV date and prospectus date in one unambiguous form, or as unresolvable."""
    days, second = F.floor(F.col("utc_s") / 86_400).cast("int"), F.pmod("utc_s", F.lit(86_400))
    clock = [F.floor(second / 3600), F.floor(second / 60) % 60, second % 60]
    moment = F.format_string("%sT%02d:%02d:%02dZ", F.date_from_unix_date(days).cast("string"), *[c.cast("int") for c in clock])
    day = F.date_format("day_written", "yyyy-MM-dd")
    form = F.when(F.col("date_status") == "moment", moment).when(F.col("date_status") == "day", day)
    nav = _rows(spark, d).select(F.lit("nav.date").alias("field"), F.col("nav_id").alias("id"), "date_status", form.alias("normal"))
    doc = _prospectus_dates(spark, d).select(
        F.lit("prospectus_data.date_document").alias("field"), F.col("prospectus_id").alias("id"), "date_status", form.alias("normal")
    )
    return nav.unionByName(doc)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    read = ("isin", "date_status", "utc_s", "day_written")
    nav = _rows(spark, d, ("nav_id",)).select(F.lit("nav.date").alias("field"), F.col("nav_id").alias("id"), F.col("date").alias("cell"), *read)
    doc = _prospectus_dates(spark, d)
    doc = doc.select(F.lit("prospectus_data.date_document").alias("field"), F.col("prospectus_id").alias("id"), F.col("date_document").alias("cell"), *read)
    return same_moment_pairs(nav.unionByName(doc), "id", "isin", "cell", "field")


def p6_series(spark: SparkSession, d: str) -> DataFrame:
    return regular_series(_rows(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_series(spark, d).where(F.col("readings") == 0).select("nav_file", F.date_format("period_start", "yyyy-MM-dd").alias("period_start"))


def p7_totals(spark: SparkSession, d: str) -> DataFrame:
    return trailing_totals(daily_totals(_rows(spark, d)))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    totals = trailing_totals(daily_totals(_rows(spark, d)), with_totals=False).where((F.col("readings_7") == 0) | (F.col("readings_30") == 0))
    window = F.explode(F.filter(F.array(F.when(F.col("readings_7") == 0, 7), F.when(F.col("readings_30") == 0, 30)), lambda w: w.isNotNull()))
    return totals.select("nav_file", F.date_format("day", "yyyy-MM-dd").alias("day"), window.alias("window_days"))


QUERIES = {
    "p3_found": p3_found,
    "p3_flags": p3_flags,
    "p4_found": p4_found,
    "p4_quantities": p4_quantities,
    "p5_found": p5_found,
    "p5_moments": p5_moments,
    "p6_found": p6_found,
    "p6_series": p6_series,
    "p7_found": p7_found,
    "p7_totals": p7_totals,
}
ORACLE: dict[str, str] = {}
