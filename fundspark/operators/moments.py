"""Cells of the same series that state one moment (or one day) in different strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundspark.operators.pairs import differing_pairs


def same_moment_pairs(rows: DataFrame, id_col: str, group_col: str, cell_col: str, field_col: str) -> DataFrame:
    """(field, id_a < id_b) of rows of one group and field whose cells give the same moment or, both without clock time, the same day.

    ``rows`` went through ``timestamps.resolve``. Only pairs with different
    strings come out; a null group or id, and unresolvable or unreadable cells, give none.
    Copies of one cell aren't compared with each other (``differing_pairs``).
    """
    moment = F.col("date_status") == "moment"
    key = F.when(moment, F.col("utc_s")).when(F.col("date_status") == "day", F.unix_date("day_written").cast("bigint"))
    keyed = rows.select(
        F.col(id_col).alias("id"), F.col(field_col).alias("field"), F.col(group_col).alias("_group"), moment.alias("_exact"), key.alias("_key"), F.col(cell_col).alias("stored")
    )
    return differing_pairs(keyed.dropna(), ["field", "_group", "_exact", "_key"], ("field",))
