"""Implausible readings: spikes, frozen values and impossible values, judged per source.

Robust seasonal-trend decomposition: the trend is the mean of the median
readings just before and just after, the season the median remainder by weekday (or by
hour where a source has many readings a day). The remainders of the whole source
go through the generalised extreme studentised deviate test, and one beyond
its limits is a spike if the series is back at its level afterwards; runs and ranges have their own checks.
"""

from __future__ import annotations

import math
from statistics import NormalDist
from typing import TYPE_CHECKING

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundspark.operators.readings import readable
from fundspark.session import small_side

if TYPE_CHECKING:
    import numpy as np
    import pyarrow as pa

DAY_S = 86_400
#: Readings on each side that give the level.
NEIGHBOURS = 5
#: Significance of the studentised deviate test ("far beyond the usual movement"), and expected number of natural runs so long at which a run counts as frozen.
ALPHA, RUN_ALPHA = 1e-6, 1e-2
#: Largest share of the remainders that the test may find outlying.
MOST_OUTLYING = 0.5
#: Least number of equal dates that can be a frozen stretch.
MIN_RUN = 6
#: A value so many times the level on either side, or so many times beyond the quartiles of its source (or so many times below), can't be a price.
IMPOSSIBLE_RATIO = 50.0
#: Distinct reading times of one source that go into one task; a larger source is cut into stretches of time, which changes no verdict.
SEGMENT_ROWS = 500_000
#: Remainders are compared with so many binary digits, so that the counts of a source by value stay small whatever its size.
DIGITS = 12

RESULT = "nav_id bigint, isin string, at_s bigint, value double, kind string, score double"
#: A judged reading; a part of a cut source's figures; its figures, and its frozen stretches over the cuts, for each of its segments.
JUDGED = "isin string, at_s bigint, value double, kind string, score double"
PART = "isin string, what string, part bigint, key bigint, until bigint, v double, n bigint"
MOVEMENT = "isin string, segment bigint, figures array<double>"
STRETCHES = "isin string, segment bigint, least double, stretches array<struct<start:bigint,until:bigint,v:double,n:bigint>>"


def esd_limit(n: int, i: int, alpha: float = ALPHA) -> float:
    """Critical value of the generalised ESD test for the ``i``-th extreme of ``n`` values."""
    i = min(i, max(n - 1, 1))
    df = max(n - i - 1, 1)
    z = -NormalDist().inv_cdf(alpha / (2.0 * (n - i + 1)))
    # Student's t from the normal quantile by Wallace's transformation, which holds far into the tails
    t2 = df * math.expm1(min((z * (8 * df + 3) / (8 * df + 1)) ** 2 / df, 600.0))
    return (n - i) * math.sqrt(t2 / ((df + t2) * (n - i + 1)))


def esd_bounds(v: np.ndarray, n: np.ndarray, least_sd: float, alpha: float = ALPHA) -> tuple[float, float, float, float, float]:
    """(lower bound, upper bound, mean, deviation, limit) of the generalised ESD test over values ``v``, rising, that occur ``n`` times.

    The value furthest from the mean is taken away again and again, mean and
    deviation being those of the rest; outlying are all values taken up to the last one whose studentised deviate
    exceeds its limit. Values at or beyond a bound are outlying, and so is any other one whose deviate from the
    mean and deviation of the rest exceeds the limit of the next one to be taken. Equal values share a verdict.
    """
    v, n = v.tolist(), n.tolist()
    count = total = sum(n)
    s1, s2 = sum(a * b for a, b in zip(v, n)), sum(a * a * b for a, b in zip(v, n))
    low, high, taken, most = 0, len(v) - 1, 0, int(total * MOST_OUTLYING)
    least_limit = min(esd_limit(total, 1, alpha), esd_limit(total, max(most, 1), alpha))  # below it the exact limit isn't needed

    def spread(c: float, s1: float, s2: float) -> tuple[float, float]:
        mean = s1 / c
        return mean, max(math.sqrt(max(s2 - c * mean * mean, 0.0) / max(c - 1, 1)), least_sd)

    found = (-math.inf, math.inf, *spread(max(count, 1), s1, s2), esd_limit(total, 1, alpha))
    while low < high:
        mean, _ = spread(count, s1, s2)
        at = high if v[high] - mean >= mean - v[low] else low
        x, k = v[at], n[at]
        taken += k
        if taken > most:
            break
        count, s1, s2 = count - k, s1 - k * x, s2 - k * x * x
        mean, sd = spread(count + 1, s1 + x, s2 + x * x)  # while one of the equal values is left
        deviate = abs(x - mean) / sd
        over = deviate > least_limit and deviate > esd_limit(total, taken, alpha)
        low, high = (low, high - 1) if at == high else (low + 1, high)
        if over:
            found = (v[low - 1] if low else -math.inf, v[high + 1] if high + 1 < len(v) else math.inf, *spread(count, s1, s2), esd_limit(total, taken + 1, alpha))
    return found


def _level(x: np.ndarray, at: np.ndarray, reach: float, back: bool) -> np.ndarray:
    """Median of up to NEIGHBOURS values before (after) each one, none further than ``reach``; NaN if there is none."""
    import numpy as np
    n = len(x)
    near = np.full((n, NEIGHBOURS), np.nan)
    for k in range(1, NEIGHBOURS + 1):
        if k >= n:
            break
        if back:
            near[k:, k - 1] = np.where(at[k:] - at[:-k] <= reach, x[:-k], np.nan)
        else:
            near[:-k, k - 1] = np.where(at[k:] - at[:-k] <= reach, x[k:], np.nan)
    near.sort(axis=1)  # NaN last
    m = (~np.isnan(near)).sum(axis=1)
    lo, hi = np.maximum((m - 1) // 2, 0), m // 2
    rows = np.arange(n)
    return (near[rows, lo] + near[rows, np.minimum(hi, NEIGHBOURS - 1)]) / 2 if n else np.zeros(0)


def _least_run(length: np.ndarray, n: np.ndarray) -> float:
    """Least length of a frozen stretch, among ``n`` stretches of each ``length``; infinite if none is frozen."""
    least = math.inf
    while True:  # the natural rate of repeats is that of the stretches not found frozen
        rest = length < least
        p = (((length - 1) * n)[rest].sum() + 0.5) / ((length * n)[rest].sum() + 1)
        found = (length >= least) | ((length >= MIN_RUN) & (n.sum() * p ** (length - 1.0) < RUN_ALPHA))
        now = float(length[found].min()) if found.any() else math.inf
        if now == least:
            return least
        least = now


def _runs(slot: np.ndarray, value: np.ndarray, received: np.ndarray, ids: np.ndarray, calm: np.ndarray):
    """(first slot, last slot, value, length) of the runs of equal values over the first deliveries (a correction that comes later doesn't end a run)."""
    import numpy as np
    if not len(calm):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, int)
    order = calm[np.lexsort((ids[calm], received[calm], slot[calm]))]
    r = order[np.r_[True, slot[order][1:] != slot[order][:-1]]]
    at, v = slot[r], value[r]
    start = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    length = np.diff(np.r_[start, len(v)])
    return at[start], at[start + length - 1], v[start], length


def _slots(at_s: np.ndarray, dense: bool | None):
    """Slot of each reading (its day, or its moment in a dense source), and whether the source is dense."""
    import numpy as np
    day = at_s // DAY_S
    if dense is None:
        dense = len(np.unique(at_s)) > 2 * max(len(np.unique(day)), 1)
    return (at_s if dense else day * DAY_S), dense


def _representatives(slot, value, received, ids):
    """The rows with a positive value, and the one received last of each slot."""
    import numpy as np
    good = np.flatnonzero(value > 0)
    order = good[np.lexsort((-ids[good], -received[good], slot[good]))]
    return good, order[np.r_[True, slot[order][1:] != slot[order][:-1]]] if len(order) else order


def _season_key(at: np.ndarray, dense: bool) -> np.ndarray:
    return (at // 3600) % 24 if dense else (at // DAY_S) % 7


def _rounded(v: np.ndarray) -> np.ndarray:
    """To DIGITS binary digits."""
    import numpy as np
    bit = 52 - DIGITS
    return ((np.asarray(v, float).view(np.int64) + (1 << (bit - 1))) & ~((1 << bit) - 1)).view(float) + 0.0


def _counted(v: np.ndarray, n: np.ndarray | None = None):
    """Distinct values, rising, and how often each occurs."""
    import numpy as np
    u, back, k = np.unique(v, return_inverse=True, return_counts=True)
    return u, (k if n is None else np.bincount(back, weights=n, minlength=len(u)).astype(np.int64))


def _quantile(v: np.ndarray, n: np.ndarray, q: float) -> float:
    """Of rising values ``v`` that occur ``n`` times; the mean of the two in the middle for a median of an even number."""
    import numpy as np
    upto = np.cumsum(n)
    lo, hi = np.searchsorted(upto, [math.ceil(q * upto[-1]) - 1, math.floor(q * upto[-1])], side="right")
    return float((v[min(lo, len(v) - 1)] + v[min(hi, len(v) - 1)]) / 2)


def _figures(key: np.ndarray, rest: np.ndarray, n: np.ndarray, x: np.ndarray, xn: np.ndarray, decimals: float) -> list[float]:
    """Figures of a whole source: quartiles of the logarithms, bounds, mean, deviation and limit of the remainders, then the season of each key.

    ``rest`` are remainders (of season ``key``) that occur ``n`` times, ``x`` rising logarithms that occur ``xn`` times.
    """
    import numpy as np
    season = np.zeros(24)
    for k in range(24):
        of = key == k
        if n[of].sum() >= 20:
            season[k] = _quantile(*_counted(rest[of], n[of]), 0.5)
    tick = 0.5 * 10.0**-decimals / math.exp(_quantile(x, xn, 0.5))
    bounds = (-math.inf, math.inf, 0.0, max(tick, 1e-9), math.inf)
    if len(rest):
        bounds = esd_bounds(*_counted(_rounded(rest - season[key]), n), max(tick, 1e-9))
    return [_quantile(x, xn, 0.25), _quantile(x, xn, 0.75), *bounds, *season.tolist()]


def _nearest(y, before, after):
    """Departure from the nearer of the two levels; from the only one at an end, 0 without any."""
    import numpy as np
    b, a = np.abs(y - before), np.abs(y - after)
    return np.nan_to_num(np.where(np.isnan(a), b, np.where(np.isnan(b), a, np.minimum(b, a))), nan=0.0)


def _remainders(slot, dense, value, received, ids, reach_s: float):
    """Good rows, representatives, the level before and after each representative, its logarithm and remainder (NaN without a level on both sides).

    Values out of all proportion to the level on either side don't take part in the levels of their neighbours.
    """
    import numpy as np
    good, rep = _representatives(slot, value, received, ids)
    at, x = slot[rep], np.log(value[rep])
    before, after = _level(x, at, reach_s, True), _level(x, at, reach_s, False)
    far = _nearest(x, before, after) > math.log(IMPOSSIBLE_RATIO)
    if far.any():
        calm = np.where(far, np.nan, x)
        before, after = _level(calm, at, reach_s, True), _level(calm, at, reach_s, False)
    return good, rep, before, after, x, x - (before + after) / 2


def _judge_values(slot, dense, value, parts, figures):
    """(kind, score) by value alone: '', 'impossible' or 'spike'."""
    import numpy as np
    n = len(value)
    kind, score = np.full(n, "", dtype=object), np.zeros(n)
    kind[~(value > 0)] = "impossible"
    good, rep, before, after, _, _ = parts
    if not len(good) or figures is None:
        return kind, score
    q1, q3, low, high, mean, sd, limit, *season = figures
    at = slot[rep]
    where = np.searchsorted(at, slot[good])
    y, b, a = np.log(value[good]), before[where], after[where]
    own = np.asarray(season)[_season_key(slot[good], dense)]
    r = _rounded(_rounded(y - (b + a) / 2) - own)
    up, down = y - own - b, y - own - a
    dev = np.minimum(np.abs(up), np.abs(down))
    ratio = math.log(IMPOSSIBLE_RATIO)
    wild = (_nearest(y, b, a) > ratio) | (y > q3 + ratio) | (y < q1 - ratio)
    brief = (up * down > 0) & (np.abs(a - b) < 0.5 * dev)
    deviate = np.where(np.isnan(r), 0.0, np.abs(r - mean) / sd)
    spike = brief & ((r >= high) | (r <= low) | (deviate > limit))
    kind[good[spike]] = "spike"
    kind[good[wild]] = "impossible"
    score[good] = deviate
    return kind, score


def _freeze(kind, score, slot, value, stretches) -> None:
    for start, until, v, k in stretches:
        inside = (slot > start) & (slot <= until) & (value == v)
        kind[inside] = "frozen"
        score[inside] = k


def judge_segment(at_s: np.ndarray, value: np.ndarray, received: np.ndarray, ids: np.ndarray, decimals: np.ndarray, reach_s: float, first: tuple | None = None, dense: bool | None = None):
    """(kind, score) of each row of one whole source; kind is '', 'impossible', 'spike' or 'frozen'.

    Repeated deliveries share a slot (the day; the moment for a source with
    more than two readings a day); the delivery received last speaks for it, and every row is
    judged by its own value. Order of the rows doesn't matter. ``first``: received and id of the first delivery, where a row stands for several.
    """
    import numpy as np
    slot, dense = _slots(at_s, dense)
    parts = _remainders(slot, dense, value, received, ids, reach_s)
    _, rep, _, _, x, rest = parts
    figures = None
    if len(rep):
        some = ~np.isnan(rest)
        figures = _figures(_season_key(slot[rep], dense)[some], _rounded(rest[some]), np.ones(int(some.sum()), np.int64), *_counted(_rounded(x)), float(decimals[rep].max()))
    kind, score = _judge_values(slot, dense, value, parts, figures)
    start, until, v, length = _runs(slot, value, *(first or (received, ids)), (kind == "").nonzero()[0])
    if len(length):
        frozen = length >= _least_run(length, length * 0 + 1)
        _freeze(kind, score, slot, value, zip(start[frozen], until[frozen], v[frozen], length[frozen]))
    return kind, score


def _columns(table: pa.Table):
    return {c: table.column(c).to_numpy(zero_copy_only=False) for c in table.column_names if c not in ("isin", "reach_s", "dense", "segment_s")} | {
        "isin": table.column("isin")[0].as_py(), "reach_s": float(table.column("reach_s")[0].as_py()), "dense": bool(table.column("dense")[0].as_py()),
    }


def _judged(c: dict, kind: np.ndarray, score: np.ndarray, pick: np.ndarray) -> pa.Table:
    import pyarrow as pa
    return pa.table(
        {
            "isin": pa.array([c["isin"]] * len(pick), pa.string()), "at_s": pa.array(c["at_s"][pick], pa.int64()), "value": pa.array(c["value"][pick], pa.float64()),
            "kind": pa.array(kind[pick], pa.string()), "score": pa.array(score[pick], pa.float64()),
        }
    )


def _judge_whole(table: pa.Table) -> pa.Table:
    c = _columns(table)
    kind, score = judge_segment(c["at_s"], c["value"], c["last_s"], c["last_id"], c["decimals"], c["reach_s"], (c["first_s"], c["first_id"]), c["dense"])
    return _judged(c, kind, score, (kind != "").nonzero()[0])


def _part(isin: str, rows: list[tuple]) -> pa.Table:
    import pyarrow as pa
    names = ("what", "part", "key", "until", "v", "n")
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
    return pa.table({"isin": pa.array([isin] * len(rows), pa.string())} | {k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(zip(names, kinds))})


def _counts(table: pa.Table) -> pa.Table:
    """Counts of the logarithms and remainders of a segment's own readings, and that the segment exists."""
    import numpy as np
    c = _columns(table)
    slot, dense = _slots(c["at_s"], c["dense"])
    _, rep, _, _, x, rest = _remainders(slot, dense, c["value"], c["last_s"], c["last_id"], c["reach_s"])
    own = c["own"][rep].astype(bool)
    rows = [("segment", int(c["segment"][0]), 0, 0, float(c["decimals"][rep][own].max(initial=-1)), 1)]
    rows += [("x", 0, 0, 0, float(a), int(b)) for a, b in zip(*_counted(_rounded(x[own])))]
    key, some = _season_key(slot[rep], dense), own & ~np.isnan(rest)
    for k in np.unique(key[some]):
        rows += [("rest", 0, int(k), 0, float(a), int(b)) for a, b in zip(*_counted(_rounded(rest[some & (key == k)])))]
    return _part(c["isin"], rows)


def _movement(table: pa.Table) -> pa.Table:
    """Figures of a whole source from its segments' counts, for each segment; none for a source without a positive value."""
    import numpy as np
    import pyarrow as pa
    what, part, key, v, n = (table.column(c).to_numpy(zero_copy_only=False) for c in ("what", "part", "key", "v", "n"))
    seg, rest, x = what == "segment", what == "rest", what == "x"
    if not x.any():
        return pa.table({"isin": pa.array([], pa.string()), "segment": pa.array([], pa.int64()), "figures": pa.array([], pa.list_(pa.float64()))})
    order = np.argsort(v[x])
    figures = _figures(key[rest].astype(int), v[rest], n[rest], v[x][order], n[x][order], v[seg].max())
    own = part[seg]
    return pa.table({"isin": pa.array([table.column("isin")[0].as_py()] * len(own)), "segment": pa.array(own), "figures": pa.array([figures] * len(own), pa.list_(pa.float64()))})


def _own_runs(c: dict, figures):
    """Slots, verdicts by value, which rows are the segment's own, and the runs of these."""
    slot, dense = _slots(c["at_s"], c["dense"])
    kind, score = _judge_values(slot, dense, c["value"], _remainders(slot, dense, c["value"], c["last_s"], c["last_id"], c["reach_s"]), figures)
    own = c["own"].astype(bool)
    return slot, kind, score, own, _runs(slot, c["value"], c["first_s"], c["first_id"], (own & (kind == "")).nonzero()[0])


def _segment_runs(table: pa.Table, movement: pa.Table) -> pa.Table:
    """Counts of the lengths of a segment's inner runs, its first and last run, and that the segment exists."""
    import numpy as np
    if not table.num_rows:
        return _part("", [])
    c = _columns(table)
    segment = int(c["segment"][0])
    start, until, v, length = _own_runs(c, movement.column("figures")[0].as_py() if movement.num_rows else None)[-1]
    edges = [("edge", segment, int(start[i]), int(until[i]), float(v[i]), int(length[i])) for i in dict.fromkeys((0, len(start) - 1))] if len(start) else []
    return _part(c["isin"], [("segment", segment, 0, 0, 0.0, 1)] + edges + [("run", 0, int(k), 0, 0.0, int(n)) for k, n in zip(*np.unique(length[1:-1], return_counts=True))])


def _stretches(table: pa.Table) -> pa.Table:
    """For each segment of a source: the least length of a frozen stretch of the whole source, and the frozen stretches that begin or end a segment and meet this one, joined over the cuts."""
    import numpy as np
    import pyarrow as pa
    rows = table.to_pylist()
    joined: list[list] = []
    last = None
    for r in sorted((r for r in rows if r["what"] == "edge"), key=lambda r: r["key"]):
        if joined and last != r["part"] and joined[-1][2] == r["v"]:
            joined[-1][1], joined[-1][3] = r["until"], joined[-1][3] + r["n"]
            joined[-1][4].append(r["part"])
        else:
            joined.append([r["key"], r["until"], r["v"], r["n"], [r["part"]]])
        last = r["part"]
    inner = [r for r in rows if r["what"] == "run"]
    least = _least_run(np.array([r["key"] for r in inner] + [j[3] for j in joined], float), np.array([r["n"] for r in inner] + [1] * len(joined)))
    meets: dict[int, list] = {r["part"]: [] for r in rows if r["what"] == "segment"}
    for *j, parts in joined:
        if j[3] >= least:
            for p in dict.fromkeys(parts):
                meets[p].append(dict(zip(("start", "until", "v", "n"), j)))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("until", pa.int64()), ("v", pa.float64()), ("n", pa.int64())]))
    return pa.table(
        {"isin": pa.array([rows[0]["isin"]] * len(meets)), "segment": pa.array(list(meets), pa.int64()), "least": pa.array([least] * len(meets), pa.float64()), "stretches": pa.array(list(meets.values()), kind)}
    )


def _judge_segment_of(table: pa.Table, known: pa.Table) -> pa.Table:
    """Verdicts on a segment's own readings from the whole source's figures."""
    import pyarrow as pa
    if not table.num_rows:
        return pa.table({"isin": pa.array([], pa.string()), "at_s": pa.array([], pa.int64()), "value": pa.array([], pa.float64()), "kind": pa.array([], pa.string()), "score": pa.array([], pa.float64())})
    c = _columns(table)
    k = known.to_pylist()[0] if known.num_rows else {"figures": None, "least": math.inf, "stretches": []}
    slot, kind, score, own, (start, until, v, length) = _own_runs(c, k["figures"])
    inner = [(a, b, w, n) for a, b, w, n in zip(start[1:-1], until[1:-1], v[1:-1], length[1:-1]) if n >= k["least"]]
    _freeze(kind, score, slot, c["value"], inner + [tuple(s[x] for x in ("start", "until", "v", "n")) for s in k["stretches"]])
    return _judged(c, kind, score, ((kind != "") & own).nonzero()[0])


def source_extent(x: DataFrame) -> DataFrame:
    """Per isin of readable rows: ``reach_s`` (how far neighbours may lie), ``dense`` and ``segment_s`` (length of a segment, null for a source that stays whole).

    All come from the distinct reading times, so that copies and repeated
    deliveries count once. The reach is 60 average distances between slots, at least 10
    days. A source of more than SEGMENT_ROWS distinct times is cut into stretches of whole days
    with so many on average, never shorter than four reaches.
    """
    times = x.select("isin", F.floor(F.col("at_s") / DAY_S).alias("day"), "at_s").distinct()
    days = times.groupBy("isin", "day").agg(F.count(F.lit(1)).alias("n"), F.min("at_s").alias("lo"), F.max("at_s").alias("hi"))
    stats = days.groupBy("isin").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("days"), (F.max("hi") - F.min("lo")).alias("span_s"))
    dense = F.col("n") > 2 * F.col("days")
    stats = stats.withColumn("dense", dense).withColumn("reach_s", F.greatest(F.lit(10.0 * DAY_S), 60.0 * F.col("span_s") / F.when(dense, F.col("n")).otherwise(F.col("days"))))
    length = F.greatest(F.col("span_s") * SEGMENT_ROWS / F.col("n"), 4 * F.col("reach_s"))
    return stats.select(F.col("isin").alias("_isin2"), "reach_s", "dense", F.when(F.col("n") > SEGMENT_ROWS, F.ceil(length / DAY_S) * DAY_S).alias("segment_s"))


def _judge_cut(x: DataFrame) -> DataFrame:
    """Verdicts on the readings of sources that are cut, as JUDGED: the same as if they were whole.

    Each stretch has a margin on both sides so that cutting doesn't change a
    reading's neighbours. Season, bounds and natural rate of repeats are the
    whole source's, from counts (by value of DIGITS binary digits) that the stretches give; they come
    back with a row for each stretch, which meets the stretch's readings on their own partitioning.
    """
    home = F.floor(F.col("at_s") / F.col("segment_s"))
    margin = F.col("reach_s") + DAY_S
    low, high = F.floor((F.col("at_s") - margin) / F.col("segment_s")), F.floor((F.col("at_s") + margin) / F.col("segment_s"))
    x = x.withColumn("_home", home).withColumn("segment", F.explode(F.array_distinct(F.array(home, low, high))))
    x = x.withColumn("own", F.col("segment") == F.col("_home")).drop("_home", "segment_s")
    x = x.repartition("isin", "segment").persist(StorageLevel.MEMORY_AND_DISK)
    own = x.groupBy("isin", "segment")
    key = ("isin", "what", "part", "key", "until", "v")
    sums = lambda parts: parts.groupBy(*key).agg(F.sum("n").alias("n")).groupBy("isin")
    movement = sums(own.applyInArrow(_counts, PART)).applyInArrow(_movement, MOVEMENT).persist(StorageLevel.MEMORY_AND_DISK)
    parts = own.cogroup(movement.groupBy("isin", "segment")).applyInArrow(_segment_runs, PART)
    known = sums(parts).applyInArrow(_stretches, STRETCHES).join(movement, ["isin", "segment"], "left")
    return own.cogroup(known.groupBy("isin", "segment")).applyInArrow(_judge_segment_of, JUDGED)


def _readings(x: DataFrame, extent: DataFrame) -> DataFrame:
    """A row for each isin, time and value, with its first and last delivery and the source's extent."""
    one = x.groupBy("isin", "at_s", "value").agg(F.max(F.struct("received_s", "nav_id", "decimals")).alias("z"), F.min(F.struct("received_s", "nav_id")).alias("a"))
    one = one.select(
        "isin", "at_s", "value", F.col("z.received_s").alias("last_s"), F.col("z.nav_id").alias("last_id"), F.col("z.decimals").alias("decimals"),
        F.col("a.received_s").alias("first_s"), F.col("a.nav_id").alias("first_id"),
    )
    return one.join(extent, F.col("isin") == F.col("_isin2")).drop("_isin2")


def implausible(rows: DataFrame) -> DataFrame:
    """Implausible readings among ``rows`` (of ``nav_rows``, with ``received_at`` and ``nav``), as RESULT; ``score`` is the studentised remainder, or the length of a frozen stretch.

    Readable rows are kept, since the extents, the readings and the result
    read them. Rows of one isin, time and value get one verdict, so they are judged as one reading
    (with its first and last delivery) and copies of any number don't meet in a task; a source of very
    many distinct times is cut into stretches. Rows that aren't readable, or of a null
    isin, never come out; repeated rows are judged alike; an empty table gives an empty result.
    """
    x = readable(rows).where(F.col("isin").isNotNull())
    x = x.select(
        "nav_id", "isin", "at_s", "value", F.coalesce(F.unix_micros(F.col("received_at").cast("timestamp")), F.lit(0)).alias("received_s"),
        F.length(F.regexp_extract(F.trim("nav"), r"[.,](\d+)$", 1)).alias("decimals"),
    ).persist(StorageLevel.MEMORY_AND_DISK)
    extent = small_side(source_extent(x))
    cut = extent.where(F.col("segment_s").isNotNull()).select(F.col("_isin2").alias("isin"))
    if cut.limit(1).count():
        cut = small_side(cut)
        whole, cut = x.join(cut, "isin", "left_anti"), x.join(cut, "isin", "left_semi")
        judged = _readings(whole, extent).groupBy("isin").applyInArrow(_judge_whole, JUDGED).unionByName(_judge_cut(_readings(cut, extent)))
    else:
        judged = _readings(x, extent).groupBy("isin").applyInArrow(_judge_whole, JUDGED)
    return x.join(small_side(judged), ["isin", "at_s", "value"]).select("nav_id", "isin", "at_s", "value", "kind", "score")
