"""Dates, units, spikes, grids and rolling totals, against brute force and on the edges."""

import itertools
from datetime import date, datetime, timedelta, timezone
from fractions import Fraction
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from fundspark.functions.timestamps import parse_cells, resolve
from fundspark.functions.zones import zone_intervals
from fundspark.operators import grid, moments, rolling, spikes, units
from fundspark.operators.readings import nav_rows, readable

NAV = "nav_id bigint, isin string, nav_file string, date string, nav string, feed_code string, received_at timestamp, value string, tz_name string, day string"
FEEDS = [("f1", "Europe/Paris", True), ("f4", "America/New_York", False), ("f8", None, True)]
SHEETS = [("A", "day", "Europe/Paris"), ("W", "week", "Europe/Paris"), ("M", "month", "Europe/Paris"), ("D", "weekday", "Europe/Paris")]


def rows_of(spark, cells):
    """nav_rows of (id, isin, date, nav, feed[, hours]) with extra columns whose names clash."""
    t0 = datetime(2024, 1, 1)
    data = [(c[0], c[1], f"{c[1]}/nav.csv" if c[1] else None, c[2], c[3], c[4], t0 + timedelta(hours=c[5] if len(c) > 5 else c[0] or 0), "x", "y", "z") for c in cells]
    nav = spark.createDataFrame(data, NAV)
    feeds = spark.createDataFrame(FEEDS, "feed_code string, tz_name string, day_first boolean")
    sheets = spark.createDataFrame(SHEETS, "isin string, rhythm string, tz_name string").withColumn("nav", F.lit(1.0))
    return nav_rows(spark, nav, feeds, sheets, ("nav_id", "received_at")), nav


CASES = [
    ("14/05/2013", "f1", "day", "2013-05-14"), ("05/14/2013", "f4", "day", "2013-05-14"), ("24-04-14", "f1", "day", "2014-04-24"), ("2014/03/18", "f1", "day", "2014-03-18"),
    ("20140115", "f1", "day", "2014-01-15"), ("41472", "f1", "day", "2013-07-17"), ("20-NOV-2013", "f1", "day", "2013-11-20"), ("10. März 2014", "f1", "day", "2014-03-10"),
    ("1er août 2018", "f1", "day", "2018-08-01"), ("6 janv. 2014", "f1", "day", "2014-01-06"), ("Aug 9, 2013", "f1", "day", "2013-08-09"), (" 31/03/2014 ", "f1", "day", "2014-03-31"),
    ("14 de noviembre de 2018", "f1", "day", "2018-11-14"), ("20 déc. 2023", "f1", "day", "2023-12-20"), ("le 12 août 2018", "f1", "day", "2018-08-12"),
    ("07/09/2016 18:45:00", "f1", "moment", "2016-09-07T16:45:00"), ("9/22/2022 7:30:00 PM", "f4", "moment", "2022-09-22T23:30:00"), ("27/06/2017 18h45", "f1", "moment", "2017-06-27T16:45:00"),
    ("2016-09-12T19:53:00+02:00", "f8", "moment", "2016-09-12T17:53:00"), ("Thu, 06 Oct 2016 16:45:00 GMT", "f8", "moment", "2016-10-06T16:45:00"),
    ("2017-10-05T19:09:00 UTC+2", "f8", "moment", "2017-10-05T17:09:00"), ("2018-02-13 12:45 America/New_York", "f1", "moment", "2018-02-13T17:45:00"),
    ("22/03/2017 18:45:00 CET", "f8", "moment", "2017-03-22T17:45:00"), ("20161011T164500Z", "f8", "moment", "2016-10-11T16:45:00"), ("1477673100", "f8", "moment", "2016-10-28T16:45:00"),
    ("1513190220000", "f8", "moment", "2017-12-13T18:37:00"), ("24 Dec 2018 12:05:00 AM", "f1", "moment", "2018-12-23T23:05:00"), ("2020-07-12 08:44:31.000 +0200", "f1", "moment", "2020-07-12T06:44:31"),
    ("27/10/2019 02:30", "f1", "ambiguous", None), ("29/03/2020 02:30", "f1", "nonexistent", None), ("02/10/2018 18:00", "f8", "no_zone", None), ("2019-01-01 10:00 Nowhere/Town", "f1", "no_zone", None),
    ("15/03/2045 10:00", "f1", "moment", "2045-03-15T09:00:00"), ("15/07/45 10:00", "f1", "moment", "2045-07-15T08:00:00"), ("15/03/1965 10:00", "f1", "moment", "1965-03-15T09:00:00"),
    ("15/07/1947 10:00 Europe/London", "f1", "moment", "1947-07-15T08:00:00"), ("30/03/2194 02:30", "f1", "nonexistent", None), ("01/01/1900 00:00", "f4", "moment", "1900-01-01T05:00:00"),
    ("31/02/2024", "f1", "unreadable", None), ("2023-13-45", "f1", "unreadable", None), ("00/00/0000", "f1", "unreadable", None), ("n/a", "f1", "unreadable", None), ("", "f1", "unreadable", None),
    (None, "f1", "unreadable", None), ("12/05/2020 25:00", "f1", "unreadable", None), ("x" * 50_000, "f1", "unreadable", None),
]


def test_notations(spark):
    rows, _ = rows_of(spark, [(k, "A", c, "1", f) for k, (c, f, _, _) in enumerate(CASES)])
    got = {r.nav_id: r for r in rows.collect()}
    for k, (cell, _, status, form) in enumerate(CASES):
        r = got[k]
        said = None if r.date_status not in ("day", "moment") else str(r.day_written) if r.date_status == "day" else datetime.fromtimestamp(r.utc_s, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")
        assert (r.date_status, said) == (status, form), cell


def test_zone_intervals_against_zoneinfo(spark):
    rng = np.random.default_rng(3)
    zones = ("Europe/Paris", "America/New_York", "Asia/Tokyo", "Africa/Casablanca", "Australia/Lord_Howe")
    data = []
    for k, s in enumerate(rng.integers(0, 2_000_000_000, 1500).tolist() + [1572139800, 1585445400]):
        data.append((k, zones[k % 5].lower(), int(s)))
    df = spark.createDataFrame(data, "id int, zone_key string, local_s bigint")
    from fundspark.functions.zones import resolve_local

    for r in resolve_local(df, "zone_key", "local_s", zone_intervals(spark, zones)).collect():
        zone = ZoneInfo(zones[r.id % 5])
        naive = datetime(1970, 1, 1) + timedelta(seconds=r.local_s)
        fits = set()
        for fold in (0, 1):
            off = naive.replace(tzinfo=zone, fold=fold).utcoffset()
            back = (naive - off).replace(tzinfo=timezone.utc).astimezone(zone).replace(tzinfo=None)
            if back == naive:
                fits.add(int(off.total_seconds()))
        assert r.zone_matches == len(fits)
        assert r.zone_offset_s == (fits.pop() if len(fits) == 1 else None)


def test_numbers(spark):
    cells = ["605,4719", "193.19", "1 127.18", "9 160,50", "1,234.5", "1.234.567,8", "-0,01", "NaN", "inf", "n/a", "-", "", None, "1e3", "12 "]
    rows, _ = rows_of(spark, [(k, "A", "01/01/2020", c, "f1") for k, c in enumerate(cells)])
    got = [r.value for r in rows.orderBy("nav_id").collect()]
    assert got == [605.4719, 193.19, 1127.18, 9160.5, 1234.5, 1234567.8, -0.01, None, None, None, None, None, None, 1000.0, 12.0]


def test_same_moment_pairs(spark):
    cells = [
        (1, "A", "07/09/2016 18:45:00", "1", "f1"), (2, "A", "2016-09-07T16:45:00Z", "1", "f1"), (3, "A", "07/09/2016", "1", "f1"), (4, "A", "2016-09-07", "1", "f1"),
        (5, "A", "2016-09-07", "1", "f4"), (6, None, "2016/09/07", "1", "f1"), (7, "W", "2016/09/07", "1", "f1"), (8, "A", "27/10/2019 02:30", "1", "f1"), (9, "A", "27/10/2019 2h30", "1", "f1"),
    ]
    rows, _ = rows_of(spark, cells)
    rows = rows.withColumn("field", F.lit("f"))
    got = {tuple(r) for r in moments.same_moment_pairs(rows, "nav_id", "isin", "date", "field").collect()}
    assert got == {("f", 1, 2), ("f", 3, 4), ("f", 3, 5)}
    assert moments.same_moment_pairs(rows.limit(0), "nav_id", "isin", "date", "field").count() == 0


def series_cells(values, isin="A", start=date(2022, 1, 3)):
    return [(k, isin, (start + timedelta(days=k)).strftime("%d/%m/%Y"), None if v is None else f"{v:.4f}", "f1") for k, v in enumerate(values)]


def test_spikes_runs_and_ranges(spark):
    rng = np.random.default_rng(5)
    v = list(100 * np.exp(np.cumsum(rng.normal(0, 0.002, 400))))
    v[50] *= 1.12  # a spike, not followed
    v[120], v[121] = v[120] * 0.8, v[121] * 0.8  # two readings long
    for k in range(200, 212):
        v[k] = v[199]  # frozen; 199 itself is the first reading
    for k in range(300, 400):
        v[k] *= 1.3  # a move that lasts
    v[20], v[21], v[22] = 0.0, -5.0, 99999999.99
    v[30] = None
    rows, nav = rows_of(spark, series_cells(v) + [(900, None, "01/01/2022", "7", "f1"), (901, "A", "bad", "7", "f1")])
    got = {r.nav_id: r.kind for r in spikes.implausible(rows).collect()}
    assert got == {50: "spike", 120: "spike", 121: "spike", 20: "impossible", 21: "impossible", 22: "impossible"} | {k: "frozen" for k in range(200, 212)}
    assert spikes.implausible(rows.limit(0)).count() == 0


def test_esd_limits_decide(monkeypatch):
    rng = np.random.default_rng(6)
    calm, wild = rng.normal(0, 1, 400), rng.standard_t(2, 400)
    for r in (calm, wild):
        low, high, mean, sd, limit = spikes.esd_bounds(*spikes._counted(r), 1e-9)
        assert limit > 5 and not np.isfinite([low, high]).all() or (np.abs(wild) > 15).any()
    r = np.r_[calm, [40.0, 41.0, -39.0]]
    low, high, mean, sd, _ = spikes.esd_bounds(*spikes._counted(r), 1e-9)
    assert (low, high) == (-39.0, 40.0) and abs(mean) < 0.2 and 0.9 < sd < 1.1  # of the rest, so that extremes don't mask each other
    assert spikes.esd_bounds(np.zeros(1), np.array([50]), 0.1)[:2] == (-np.inf, np.inf)
    # textbook limits of the test for 54 values at 5 %
    assert [round(spikes.esd_limit(54, i, 0.05), 2) for i in (1, 2, 3, 10)] == [3.16, 3.15, 3.14, 3.09]
    v = 100 * np.exp(np.cumsum(rng.normal(0, 0.002, 300)))
    v[100] *= 1.05
    judge = lambda: (spikes.judge_segment(np.arange(300) * 86400, v, np.zeros(300), np.arange(300), np.full(300, 4), 60 * 86400.0)[0] == "spike").sum()
    assert judge() == 1
    monkeypatch.setattr(spikes, "esd_limit", lambda *a: 0.0)
    assert judge() > 20  # nothing but the limits keeps the others out


def test_ranges_are_a_source_s_own():
    rng = np.random.default_rng(2)
    v = 12e6 * np.exp(np.cumsum(rng.normal(0, 0.002, 400)))
    at = np.arange(400) * 86400
    kind, _ = spikes.judge_segment(at, v, np.zeros(400), np.arange(400), np.full(400, 2), 60 * 86400.0)
    assert (kind == "").all()
    v[7], v[50:56] = v[7] * 100, 99999999.99 * 40
    kind, _ = spikes.judge_segment(at, v, np.zeros(400), np.arange(400), np.full(400, 2), 60 * 86400.0)
    assert set(np.flatnonzero(kind != "")) == {7, *range(50, 56)}


def test_coarse_and_constant_series_have_no_frozen_stretches():
    rng = np.random.default_rng(1)
    coarse = np.round(18.5 + np.cumsum(rng.choice([-0.01, 0, 0, 0, 0, 0, 0, 0.01], 500)), 2)
    for v in (coarse, np.full(300, 12.0), np.array([5.0]), np.array([])):
        n = len(v)
        kind, _ = spikes.judge_segment(np.arange(n) * 86400, v, np.zeros(n), np.arange(n), np.full(n, 2), 60 * 86400.0)
        assert not (kind == "frozen").any() and not (kind == "spike").any()


def test_segments_do_not_change_a_verdict(spark, monkeypatch):
    rng = np.random.default_rng(9)
    v = list(100 * np.exp(np.cumsum(rng.normal(0, 0.002, 900))))
    for k in range(40, 900, 97):
        v[k] *= 1.2
    rows, nav = rows_of(spark, [(*c, 24 * k) for k, c in enumerate(series_cells(v))])
    whole = {r.nav_id for r in spikes.implausible(rows).collect()}
    monkeypatch.setattr(spikes, "SEGMENT_ROWS", 300)
    cut = {r.nav_id for r in spikes.implausible(rows).collect()}
    assert whole == cut == set(range(40, 900, 97))


def test_copies_and_one_batch_change_no_verdict(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = list(100 * np.exp(np.cumsum(rng.normal(0, 0.01, 90))))
    v[30] *= 1.9
    v[60] *= 80
    cells = [(k, "M", (date(2012, 1, 5) + timedelta(days=30 * k)).strftime("%d/%m/%Y"), f"{x:.4f}", "f1", 0) for k, x in enumerate(v)]
    copies = [(1000 * n + c[0], *c[1:]) for c in cells for n in range(1, 40)]
    want = {(30, "spike"), (60, "impossible")}
    for limit in (50_000, 500):  # more rows than the limit, fewer times
        monkeypatch.setattr(spikes, "SEGMENT_ROWS", limit)
        rows, nav = rows_of(spark, cells + copies)
        got = [(r.nav_id % 1000, r.kind) for r in spikes.implausible(rows).collect()]
        assert set(got) == want and len(got) == 80


def test_cut_sources_have_the_whole_source_s_scale_and_runs(spark, monkeypatch):
    rng = np.random.default_rng(11)
    sd = np.where(np.arange(1500) < 1000, 0.001, 0.02)  # a stretch of its own would have another scale
    v = 100 * np.exp(np.cumsum(rng.normal(0, 1, 1500) * sd))
    v[1200] *= 1.6
    v[100:1450:50] *= 1.25
    v[401:1000] = v[401]  # over several cuts
    rows, nav = rows_of(spark, series_cells(v, start=date(2018, 1, 1)))
    whole = {(r.nav_id, r.kind, round(r.score, 2)) for r in spikes.implausible(rows).collect()}
    assert sum(k == "frozen" for _, k, _ in whole) == 598 and any(k == "spike" for _, k, _ in whole)
    monkeypatch.setattr(spikes, "SEGMENT_ROWS", 250)
    assert {(r.nav_id, r.kind, round(r.score, 2)) for r in spikes.implausible(rows).collect()} == whole


def test_grid(spark):
    cells = [
        (1, "D", "03/01/2022 12:00:00", "10", "f1"), (2, "D", "03/01/2022 18:00:00", "20", "f1"), (3, "D", "06/01/2022 00:00:00", "30", "f1"), (4, "D", "10/01/2022", "40", "f1"),
        (5, "D", "10/01/2022", "41", "f1", 99), (6, "W", "03/01/2022", "1", "f1"), (7, "W", "20/01/2022", "3", "f1"), (8, "M", "15/01/2022", "1", "f1"), (9, "M", "15/06/2022", "2", "f1"),
        (10, "X", "01/01/2022", "5", "f1"), (11, None, "01/01/2022", "5", "f1"), (12, "A", "bad", "5", "f1"),
    ]
    rows, _ = rows_of(spark, cells)
    got = {(r.nav_file, str(r.period_start)): r for r in grid.regular_series(rows).collect()}
    day = {k[1]: r for k, r in got.items() if k[0] == "D/nav.csv"}
    assert sorted(day) == ["2022-01-03", "2022-01-04", "2022-01-05", "2022-01-06", "2022-01-07", "2022-01-10"]
    assert [day[k].readings for k in sorted(day)] == [2, 0, 0, 1, 0, 1]
    assert day["2022-01-03"].average == pytest.approx(15.0) and day["2022-01-03"].coverage == pytest.approx(0.5)
    assert day["2022-01-04"].average == 20.0 and day["2022-01-04"].status == "filled" and day["2022-01-04"].coverage == 1.0
    assert day["2022-01-10"].last_value == 41.0  # the later delivery of the same moment
    assert sorted(k[1] for k in got if k[0] == "W/nav.csv") == ["2022-01-03", "2022-01-10", "2022-01-17"]
    months = [r.readings for k, r in sorted(got.items()) if k[0] == "M/nav.csv"]
    assert months == [1, 0, 0, 0, 0, 1]
    assert [r.status for k, r in sorted(got.items()) if k[0] == "M/nav.csv"][4] == "missing"
    assert len([k for k in got if k[0] == "X/nav.csv"]) == 1 and not [k for k in got if k[0] is None or k[0] == "A/nav.csv"]
    assert grid.regular_series(rows.limit(0)).count() == 0
    gone = [r for r in got.values() if r.status == "missing"]
    assert gone and all(r.average is None and r.last_value is None and r.coverage == 0 for r in gone)


def test_weekends_under_the_weekday_rhythm(spark):
    cells = [
        (1, "D", "07/01/2022 12:00:00", "10", "f1"), (2, "D", "08/01/2022 09:00:00", "1000", "f1"), (3, "D", "08/01/2022 15:00:00", "2000", "f1"), (4, "D", "10/01/2022 12:00:00", "20", "f1"),
        (5, "D", "15/01/2022 10:00:00", "3000", "f1"),
    ]
    rows, _ = rows_of(spark, cells)
    got = {str(r.period_start): r for r in grid.regular_series(rows).collect()}
    assert sorted(got) == ["2022-01-07", *(f"2022-01-{d}" for d in range(10, 15))]
    friday, monday = got["2022-01-07"], got["2022-01-10"]
    assert (friday.readings, friday.average, friday.coverage, friday.last_value) == (1, 10.0, 0.5, 10.0)
    assert (monday.readings, monday.average, monday.coverage, monday.last_value) == (1, pytest.approx((2000 + 20) / 2), 1.0, 20.0)
    assert got["2022-01-11"].average == 20.0 and got["2022-01-14"].status == "filled"
    early, _ = rows_of(spark, [(1, "D", "08/01/2022 09:00:00", "7", "f1"), (2, "D", "11/01/2022 00:00:00", "8", "f1")])
    first = {str(r.period_start): (r.readings, r.average, r.coverage) for r in grid.regular_series(early).collect()}
    assert first == {"2022-01-10": (0, 7.0, 1.0), "2022-01-11": (1, 8.0, 0.0)}
    alone, _ = rows_of(spark, [(1, "D", "08/01/2022 09:00:00", "7", "f1")])
    assert grid.regular_series(alone).count() == 0


def test_trailing_totals_against_brute_force(spark):
    rng = np.random.default_rng(2)
    cells, k = [], 0
    for isin in ("A", "W"):
        for off in sorted(rng.choice(200, 60, replace=False).tolist()):
            k += 1
            cells.append((k, isin, (date(2021, 11, 1) + timedelta(days=off)).strftime("%d/%m/%Y"), f"{rng.uniform(1, 9):.2f}", "f1"))
    rows, _ = rows_of(spark, cells + [(k + 1, "A", "n/a", "3", "f1"), (k + 2, None, "01/01/2022", "3", "f1")])
    daily = {}
    for r in readable(rows).where("nav_file is not null").collect():
        daily.setdefault(r.nav_file, {})[r.day] = r.value
    got = rolling.trailing_totals(rolling.daily_totals(rows)).collect()
    assert len(got) == sum((max(v) - min(v)).days + 1 for v in daily.values())
    for r in got:
        for w in (7, 30):
            own = [v for d, v in daily[r.nav_file].items() if r.day - timedelta(days=w) < d <= r.day]
            assert r[f"readings_{w}"] == len(own)
            assert (r[f"total_{w}"] is None) == (not own)
            if own:
                assert r[f"total_{w}"] == pytest.approx(sum(own), abs=1e-4) and r[f"average_{w}"] == pytest.approx(sum(own) / len(own), abs=1e-5)
    assert rolling.trailing_totals(rolling.daily_totals(rows.limit(0))).count() == 0


def test_conversion_graph():
    c = {(u, t): (a, b) for u, t, a, b in units.conversions()}
    assert c["bp", "fraction"] == (Fraction(1, 10_000), 0) and c["billion", "unit"] == (10**9, 0) and c["permille", "fraction"][0] == Fraction(1, 1000)
    k = {(u, t): x for u, t, *x in units.conversions((("celsius", "kelvin", "1", "273.15"), ("fahrenheit", "celsius", "5/9", "-160/9")), ("kelvin",))}
    assert k["fahrenheit", "kelvin"] == [Fraction(5, 9), Fraction("273.15") - Fraction(160, 9)]
    with pytest.raises(ValueError):
        units.conversions((("a", "b", "2", "0"), ("b", "c", "2", "0"), ("a", "c", "5", "0")), ("c",))


FEES = [
    ("1,90 %", "x01", "0.0190"), ("1.40%", "x02", "0.0140"), ("0,0135", "x06", "0.0135"), ("175", "x04", "0.0175"), ("2.25", "x05", "0.0225"), ("175 points de base", "x01", "0.0175"), ("140bp", "x01", "0.0140"),
    ("17‰", "x01", "0.0170"), ("25,5 pour mille", "x01", "0.0255"), ("au plus 0,6 p. cent de l'actif net", "x01", "0.0060"), ("110 euros per 10 000 euros placés", "x01", "0.0110"),
    ("18.5 EUR par tranche de 1 000 EUR investis", "x02", "0.0185"), ("Néant", "x01", "0"), ("Pas de frais", "x01", "0"), ("157 EUR", "x01", None), ("voir prospectus", "x01", None), ("", "x01", None), (None, "x01", None),
    ("12", "x99", None), ("2,5 %", None, None), ("9" * 60, "x01", None),
]
AMOUNTS = [
    ("88,09 millions euros", "x01", "88090000", "EUR"), ("6,879,000 kUS$", "x05", "6879000000", "USD"), ("18.630", "x06", "18630000", "EUR"), ("2.276 Mrd. €", "x05", "2276000000", "EUR"), ("29.38 M EUR", "x02", "29380000", "EUR"),
    ("EUR 18 630 000,00", "x03", "18630000", "EUR"), ("18.63", "x05", "18630000", "EUR"), ("100.000 euro cents", "x03", "1000", "EUR"), ("0,1235 K CHF", "x01", "123.5", "CHF"), ("50 euros (valeur d'origine)", "x01", "50", "EUR"),
    ("2500 USc", "x01", "25", "USD"), ("1'685'000'000 EUR", "x02", "1685000000", "EUR"), ("12 345 pence", "x01", "123.45", "GBP"), ("¥ 500 000", "x01", "500000", "JPY"), ("non communiqué", "x01", None, None), (None, "x01", None, None),
]


def test_quantities(spark):
    src = spark.createDataFrame(
        [("x01", ",", "percent", "unit"), ("x02", ".", "fraction", "unit"), ("x03", ",", "percent", "million"), ("x04", ".", "bp", "thousand"), ("x05", ".", "percent", "million"), ("x06", ",", "fraction", "thousand")],
        "source_code string, decimal_mark string, fee_unit string, amount_unit string",
    )
    schema = "id int, cell string, extracted_by string, devise string, isin string, quantity string, factor string, target string"
    for cases, kind in ((FEES, "fee"), (AMOUNTS, "amount")):
        df = spark.createDataFrame([(k, c[0], c[1], "EUR", "A", "q", "f", "t") for k, c in enumerate(cases)], schema)
        got = {r.id: r for r in units.quantities(spark, df, "cell", src, kind).collect()}
        for k, c in enumerate(cases):
            assert (None if got[k].quantity is None else Fraction(got[k].quantity)) == (None if c[2] is None else Fraction(c[2])), c
            if kind == "amount":
                assert got[k].currency == c[3], c
        assert units.quantities(spark, df.limit(0), "cell", src, kind).count() == 0


def test_same_quantity_pairs(spark):
    rows = spark.createDataFrame(
        [(1, "A", 1.0, "EUR", "1 €"), (2, "A", 1.0, "EUR", "1 EUR"), (3, "A", 1.0, "USD", "1"), (4, "B", 1.0, "EUR", "1,0"), (5, "A", 1.0, "EUR", "1 €"), (6, None, 1.0, "EUR", "x"), (7, "A", None, None, "y"),
         (8, "A", 1.0, None, "1"), (9, "A", 1.0, None, "1,0"), (2, "A", 1.0, "EUR", "1 EUR")],
        "id int, isin string, quantity double, currency string, cell string",
    ).withColumn("field", F.lit("f"))
    amounts = {tuple(r) for r in units.same_quantity_pairs(rows.withColumn("is_amount", F.lit(True)), "id", "cell", "field").collect()}
    assert amounts == {("f", 1, 2), ("f", 2, 5)}
    fees = {tuple(r) for r in units.same_quantity_pairs(rows.withColumn("is_amount", F.lit(False)), "id", "cell", "field").collect()}
    assert {("f", 1, 2), ("f", 3, 9), ("f", 2, 5), ("f", 8, 9)} <= fees and ("f", 3, 8) not in fees and ("f", 1, 5) not in fees


def test_differing_pairs_against_brute_force(spark):
    from fundspark.operators.pairs import differing_pairs

    rng = np.random.default_rng(8)
    data = [(k, int(rng.integers(0, 6)), "abcd"[int(rng.integers(0, 4))], 0) for k in range(120)] + [(k, 9, "same", 0) for k in range(200, 400)] + [(5, 1, "a", 0)]
    rows = spark.createDataFrame(data, "id bigint, key int, stored string, _lo int")
    want = {(min(a[0], b[0]), max(a[0], b[0])) for a, b in itertools.combinations(data, 2) if a[1] == b[1] and a[2] != b[2] and a[0] != b[0]}
    got = differing_pairs(rows, ["key"]).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert differing_pairs(rows.limit(0), ["key"]).count() == 0


def test_document_dates_are_day_first(spark):
    df = spark.createDataFrame([(1, "03/04/2020"), (2, None)], "id int, c string")
    got = {r.id: (r.date_status, str(r.day_written)) for r in resolve(parse_cells(df, "c"), zone_intervals(spark, ())).collect()}
    assert got == {1: ("day", "2020-04-03"), 2: ("unreadable", "None")}
