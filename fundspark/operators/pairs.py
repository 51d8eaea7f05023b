"""Pairs of rows that agree on a key and are stored differently, without comparing rows that are stored alike."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundspark.session import small_side


def differing_pairs(rows: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """(``keep``, id_a, id_b), id_a < id_b, of the rows (id, stored, ``keys``) with equal keys whose ``stored`` differs; ``keep`` is among the keys.

    1. An aggregate with a map-side part leaves the keys that hold more than one
       stored form (told by the least and largest 64-bit hash); copies of one form, however many, end here.
    2. The distinct forms of a key are paired.
    3. Rows meet their form's partners on (key, form). Every meeting is a pair of
       the result, so the work is in proportion to it; AQE splits a form that holds very many rows.

    Keys and ``stored`` must not be null. Repeated rows give a pair once. The rows are kept, as they are read three times.
    """
    rows = rows.select("id", "stored", *keys).persist(StorageLevel.MEMORY_AND_DISK)
    form = F.xxhash64("stored")
    mixed = rows.groupBy(*keys).agg(F.min(form).alias("_lo"), F.max(form).alias("_hi")).where("_lo <> _hi").select(*keys)
    rows = rows.join(small_side(mixed), keys, "left_semi")
    forms = rows.select(*keys, "stored").distinct()
    two = forms.withColumnRenamed("stored", "_sa").join(forms.withColumnRenamed("stored", "_sb"), keys).where("_sa < _sb")
    a = rows.withColumnsRenamed({"id": "_ia", "stored": "_sa"}).join(two, [*keys, "_sa"])
    b = rows.withColumnsRenamed({"id": "_ib", "stored": "_sb"})
    met = a.join(b, [*keys, "_sb"]).where("_ia <> _ib")
    return met.select(*keep, F.least("_ia", "_ib").alias("id_a"), F.greatest("_ia", "_ib").alias("id_b")).distinct()
