"""Mixed date notations to one unambiguous moment or day, in JVM expressions.

``parse_cells`` reads the notation, ``resolve`` finds the UTC moment by the
as-of join of :mod:`fundspark.functions.zones`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundspark.functions.zones import resolve_local

# Month names and short forms in fr, en, de, es, without accents.
MONTHS = {
    1: "jan january janv janvier jaen januar jaenner ene enero",
    2: "feb february fev fevr fevrier februar febrero",
    3: "mar march mars marz maerz mrz marzo",
    4: "apr april avr avril abr abril",
    5: "may mai mayo",
    6: "jun june juin juni junio",
    7: "jul july juil juillet juli julio",
    8: "aug august aout ago agosto",
    9: "sep sept september septembre septiembre set setiembre",
    10: "oct october octobre okt oktober octubre",
    11: "nov november novembre noviembre",
    12: "dec december decembre dez dezember dic diciembre",
}

# Zone abbreviations with one meaning in this domain, in minutes east of UTC.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120,
    "eet": 120, "eest": 180, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480,
    "pdt": -420, "jst": 540, "hkt": 480, "sgt": 480,
}

_ACCENTED = "àâäáãåçéèêëíìîïñóòôöõúùûüÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuAAAAAACEEEEIIIINOOOOOUUUU"
_BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000\t\n\r"
_DROPPED = "".join(map(chr, (*range(0x0300, 0x0345), 0x00AD, *range(0x200B, 0x2010), 0x2060, 0xFEFF)))

_WHO = r"^(?:[a-z]+\.?,? )??(?:le |the |el |am |den )?"
_ZONE = r"(z|[a-z][a-z_]*(?:/[a-z_+-]+)*(?:[+-]\d{1,2}(?::?\d{2})?)?|[+-]\d{1,2}(?::?\d{2})?)"
_CLOCK = r"(?:(?:t| |, | a | at )(\d{1,2})[:h](\d{2})(?::(\d{2})(?:[.,]\d+)?)?(?: ?([ap])m\b)?(?: ?" + _ZONE + ")?)?$"

# (pattern, order and groups as "kind|day|month|year|hour|minute|second|half|zone")
_NOTATIONS = (
    (r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d{2})" + _CLOCK, "n|$1|$3|$4|$5|$6|$7|$8|$9"),
    (r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})" + _CLOCK, "y|$4|$3|$1|$5|$6|$7|$8|$9"),
    (r"^(\d{4})(\d{2})(\d{2})(?:[t ]?(\d{2})(\d{2})(\d{2})? ?" + _ZONE + "?)?$", "y|$3|$2|$1|$4|$5|$6||$7"),
    (_WHO + r"(\d{1,2})(?:er|st|nd|rd|th|\.|º)?[ -](?:de )?([a-z]+)\.?[ -](?:de )?(\d{4}|\d{2})" + _CLOCK, "m|$1|$2|$3|$4|$5|$6|$7|$8"),
    (r"^(?:[a-z]+, )?([a-z]+)\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})" + _CLOCK, "m|$2|$1|$3|$4|$5|$6|$7|$8"),
)

#: Days from the spreadsheet epoch (1899-12-30) to 1970-01-01, and the serials that count as dates (1954 to 2064).
SERIAL_EPOCH, SERIAL_FIRST, SERIAL_LAST = 25_569, 20_000, 60_000


def _months() -> Column:
    pairs = [F.lit(x) for n, names in MONTHS.items() for name in names.split() for x in (name, n)]
    return F.create_map(*pairs)


def _int(col: Column) -> Column:
    return F.when(col != "", col.cast("int"))


def tidy(cell: Column) -> Column:
    """Lower case, without accents, odd blanks and invisible marks, single blanks."""
    plain = F.translate(cell, _ACCENTED + _BLANKS + _DROPPED, _PLAIN + " " * len(_BLANKS))
    return F.trim(F.regexp_replace(F.lower(plain), " {2,}", " "))


def parse_cells(df: DataFrame, cell: str, day_first: Column | None = None, feed_zone: Column | None = None) -> DataFrame:
    """Reads the notation of ``cell``; adds

    * ``day_written`` date, ``has_clock`` boolean,
    * ``local_s`` seconds of the wall clock as if it were UTC (null without clock),
    * ``fixed_s`` seconds east of UTC if the cell says so, ``zone_key`` lower-case name of the zone to look up,
    * ``epoch_s`` for cells that are numbers of seconds or milliseconds since 1970.

    ``day_first`` orders all-numeric dates that don't start with the year (null: day first); ``feed_zone`` is the zone of clock
    times that state none. A null, blank, unreadable or impossible cell gives nulls everywhere. Two-digit years are 1969 to 2068.
    """
    t = F.col("_t")
    canon = None
    for pattern, form in _NOTATIONS:
        hit = t.rlike(pattern)
        canon = F.when(hit, F.regexp_replace(t, pattern, form)) if canon is None else canon.when(hit, F.regexp_replace(t, pattern, form))
    df = df.withColumn("_t", tidy(F.col(cell)))
    df = df.withColumn("_c", F.split(canon, "\\|"))
    get = lambda k: F.col("_c")[k]
    number = F.when(t.rlike(r"^\d{5}$|^\d{10}$|^\d{13}$"), t.cast("bigint"))
    df = df.withColumn(
        "_p",
        F.struct(
            get(0).alias("kind"),
            _int(get(1)).alias("a"),
            F.when(get(0) == "m", F.try_element_at(_months(), get(2))).otherwise(F.when(get(0) != "m", _int(get(2)))).alias("b"),
            _int(get(3)).alias("y"),
            F.length(get(3)).alias("yl"),
            _int(get(4)).alias("h"),
            _int(get(5)).alias("mi"),
            F.coalesce(_int(get(6)), F.lit(0)).alias("s"),
            get(7).alias("half"),
            F.nullif(get(8), F.lit("")).alias("z"),
            number.alias("n"),
        ),
    )
    p = lambda k: F.col("_p")[k]
    first = F.lit(True) if day_first is None else F.coalesce(day_first, F.lit(True))
    swap = (p("kind") == "n") & ~first
    year = F.when(p("yl") == 2, p("y") + F.when(p("y") < 69, 2000).otherwise(1900)).otherwise(p("y"))
    hour = F.when(p("half") == "", p("h")).when(
        p("h").between(1, 12), p("h") % 12 + F.when(p("half") == "p", 12).otherwise(0)
    )
    df = df.withColumn(
        "_q", F.struct(F.when(swap, p("b")).otherwise(p("a")).alias("d"), F.when(swap, p("a")).otherwise(p("b")).alias("m"), year.alias("y"), hour.alias("h"))
    )
    q = lambda k: F.col("_q")[k]
    leap = ((q("y") % 4 == 0) & (q("y") % 100 != 0)) | (q("y") % 400 == 0)
    last = F.when(q("m").isin(4, 6, 9, 11), 30).when(q("m") == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    real = q("m").between(1, 12) & (q("d") >= 1) & (q("d") <= last) & q("y").between(1900, 2199)
    clock_ok = p("h").isNull() | (q("h").between(0, 23) & p("mi").between(0, 59) & p("s").between(0, 59))
    written = F.when(real & clock_ok, F.make_date(q("y"), q("m"), q("d")))
    serial = F.when(p("n").between(SERIAL_FIRST, SERIAL_LAST), F.date_from_unix_date((p("n") - SERIAL_EPOCH).cast("int")))
    epoch = F.when(p("n") > 9_999_999_999, F.floor(p("n") / 1000)).when(p("n") > 99_999, p("n"))
    df = df.withColumn("_day", written).withColumn("epoch_s", epoch)
    df = df.withColumn(
        "day_written",
        F.coalesce(F.col("_day"), serial, F.when(F.col("epoch_s").isNotNull(), F.date_from_unix_date(F.floor(F.col("epoch_s") / 86_400).cast("int")))),
    )
    clocked = F.col("_day").isNotNull() & p("h").isNotNull()
    df = df.withColumn(
        "local_s", F.when(clocked, F.unix_date("_day").cast("bigint") * 86_400 + q("h") * 3600 + p("mi") * 60 + p("s"))
    )
    z = p("z")
    zoned = r"^(?:utc|gmt|ut)?([+-])(\d{1,2})(?::?(\d{2}))?$"
    offset = F.when(
        z.rlike(zoned),
        (F.regexp_extract(z, zoned, 2).cast("int") * 3600 + F.coalesce(_int(F.regexp_extract(z, zoned, 3)), F.lit(0)) * 60)
        * F.when(F.regexp_extract(z, zoned, 1) == "-", -1).otherwise(1),
    )
    table = F.create_map(*[F.lit(x) for k, v in ABBREVIATIONS.items() for x in (k, v * 60)])
    stated = F.when(z.isNull(), F.lit(None).cast("string") if feed_zone is None else F.lower(feed_zone)).otherwise(z)
    fixed = F.when(F.col("local_s").isNotNull(), F.coalesce(F.try_element_at(table, stated), offset))
    df = df.withColumn("fixed_s", fixed)
    return (
        df.withColumn(
            "zone_key", F.when(F.col("local_s").isNotNull() & F.col("fixed_s").isNull(), stated)
        )
        .withColumn("has_clock", F.when(F.col("day_written").isNotNull(), F.col("local_s").isNotNull() | F.col("epoch_s").isNotNull()))
        .drop("_t", "_c", "_p", "_q", "_day")
    )


def resolve(df: DataFrame, zones: DataFrame) -> DataFrame:
    """After ``parse_cells``: adds ``utc_s`` (the moment, in seconds) and ``date_status``.

    The status is ``moment``, ``day`` (no clock time), ``ambiguous``,
    ``nonexistent``, ``no_zone`` (clock time without a known zone, or in one of unknown name) or
    ``unreadable`` (null, blank, not a date, impossible). ``zones``: ``zone_intervals`` of all zones that occur.
    """
    df = resolve_local(df, "zone_key", "local_s", zones)
    offset = F.coalesce(F.col("fixed_s"), F.col("zone_offset_s"))
    return df.withColumn("utc_s", F.coalesce(F.col("epoch_s"), F.col("local_s") - offset)).withColumn(
        "date_status",
        F.when(F.col("day_written").isNull(), "unreadable")
        .when(~F.col("has_clock"), "day")
        .when(F.col("utc_s").isNotNull(), "moment")
        .when(F.col("zone_matches") > 1, "ambiguous")
        .when(F.col("zone_matches") == 0, "nonexistent")
        .otherwise("no_zone"),
    )
