"""Zone-offset intervals: which UTC offset a zone's wall clock had between which local times."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The years that the date notations can give.
FIRST_YEAR, LAST_YEAR = 1900, 2199
_STEP_S = 10 * 86_400


def _offset(zone: ZoneInfo, utc_s: int) -> int:
    at = datetime.fromtimestamp(utc_s, timezone.utc)
    return int(at.astimezone(zone).utcoffset().total_seconds())


def _year_start(year: int) -> int:
    return int(datetime(year, 1, 1, tzinfo=timezone.utc).timestamp())


def offset_intervals(name: str) -> list[tuple[int, int, int]]:
    """(local from, local to, offset), in seconds, of every stretch of constant offset of a zone."""
    zone = ZoneInfo(name)
    begin, end = _year_start(FIRST_YEAR) - 2 * 86_400, _year_start(LAST_YEAR + 1) + 2 * 86_400
    out, since, off = [], begin, _offset(zone, begin)
    at = begin
    while at < end:
        nxt = min(at + _STEP_S, end)
        if _offset(zone, nxt) != off:
            lo, hi = at, nxt
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if _offset(zone, mid) == off else (lo, mid)
            out.append((since + off, hi + off, off))
            since, off, at = hi, _offset(zone, hi), hi
        else:
            at = nxt
    out.append((since + off, end + off, off))
    return out


@lru_cache(maxsize=4)
def _rows(names: tuple[str, ...]) -> list[tuple[str, int, list[tuple[int, int, int]]]]:
    rows = []
    for name in names:
        spans = offset_intervals(name)
        k = 0
        for year in range(FIRST_YEAR, LAST_YEAR + 1):
            lo, hi = _year_start(year), _year_start(year + 1)
            while k < len(spans) and spans[k][1] <= lo:
                k += 1
            own, j = [], k
            while j < len(spans) and spans[j][0] < hi:
                own.append(spans[j])
                j += 1
            rows.append((name.lower(), year, own))
    return rows


def named_zones() -> tuple[str, ...]:
    """IANA names with an area, such as Europe/Paris; a bounded list that doesn't grow with the data."""
    areas = ("Africa", "America", "Antarctica", "Asia", "Atlantic", "Australia", "Europe", "Indian", "Pacific")
    return tuple(sorted(z for z in available_timezones() if z.split("/")[0] in areas))


def zone_intervals(spark: SparkSession, names: tuple[str, ...] | None = None) -> DataFrame:
    """The intervals of each zone, exploded by local year: zone, year and from, to, offset of the 1st, 2nd ... interval of that year.

    Its size is zones x 300 short rows whatever the data, so it may always be
    broadcast. ``names`` (default: all IANA zones) must be IANA names.
    """
    rows = _rows(tuple(sorted({n for n in (named_zones() if names is None else names) if n})))
    slots = max((len(own) for _, _, own in rows), default=1)
    # one literal, read on the executors: no driver-side frame library is needed for it
    text = "\n".join(f"{z}|{y}|" + ",".join(str(v) for span in own for v in span) for z, y, own in rows)
    x = spark.range(1).select(F.explode(F.split(F.lit(text), "\n")).alias("row")).where("row <> ''")
    x = x.select(F.split("row", r"\|").alias("p")).select(F.col("p")[0].alias("zone"), F.col("p")[1].cast("int").alias("year"), F.split(F.col("p")[2], ",").alias("v"))
    value = lambda k: F.try_element_at("v", F.lit(k + 1)).cast("bigint")
    cols = [value(3 * k + j).alias(f"{n}_{k}") for k in range(slots) for j, n in enumerate(("_from", "_to", "_offset"))]
    return x.select("zone", "year", *cols)


def zones_in(cells: DataFrame, col: str) -> tuple[str, ...]:
    """The IANA zones named anywhere in the end of the strings of ``col``: a distinct over one column, bounded by the list of IANA names."""
    known = {z.lower(): z for z in named_zones()}
    name = F.lower(F.regexp_extract(F.col(col), r"([A-Za-z]+/[A-Za-z_/+-]+)\s*$", 1))
    found = cells.where(F.col(col).rlike(r"[A-Za-z]/[A-Za-z]")).select(name.alias("z")).where(F.col("z").isin(*known)).distinct()
    return tuple(known[r.z] for r in found.collect())


def resolve_local(df: DataFrame, zone_key: str, local_s: str, intervals: DataFrame) -> DataFrame:
    """Adds ``zone_matches`` (how many offset intervals hold the local time; null for a zone that isn't in the table, or null) and ``zone_offset_s`` (if one).

    An as-of join on the equality of (zone, local year): two matching
    intervals mean that the clocks show the time twice, none that they never
    do; one gives the offset.
    """
    slots = sum(c.startswith("_from_") for c in intervals.columns)
    year = F.year(F.date_from_unix_date(F.floor(F.col(local_s) / 86_400).cast("int")))
    side = F.broadcast(intervals.withColumnsRenamed({"zone": "_zone", "year": "_year"}))
    joined = df.withColumn("_ly", F.when(F.col(zone_key).isNotNull(), year)).join(
        side, (F.col(zone_key) == F.col("_zone")) & (F.col("_ly") == F.col("_year")), "left"
    )
    hit = [F.coalesce((F.col(local_s) >= F.col(f"_from_{k}")) & (F.col(local_s) < F.col(f"_to_{k}")), F.lit(False)) for k in range(slots)]
    matches = sum((h.cast("int") for h in hit[1:]), hit[0].cast("int"))
    offset = F.coalesce(*[F.when(h, F.col(f"_offset_{k}")) for k, h in enumerate(hit)])
    return joined.select(*df.columns, F.when(F.col("_zone").isNotNull(), matches).alias("zone_matches"), F.when(matches == 1, offset).alias("zone_offset_s"))
