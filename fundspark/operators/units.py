"""Quantities in different units to one common unit.

Conversions are edges of a graph with affine functions y = a*x + b. Shortest
compositions to the common unit are computed once, cycles are checked for
consistency, and rows are converted by an equi-join on their unit.
"""

from __future__ import annotations

from collections import deque
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fundspark.functions.timestamps import tidy
from fundspark.operators.pairs import differing_pairs
from fundspark.session import bounded_broadcast

# Unit, unit, factor, offset.
EDGES = (
    ("percent", "fraction", "0.01", "0"),
    ("permille", "percent", "0.1", "0"),
    ("bp", "percent", "0.01", "0"),
    ("bp", "fraction", "0.0001", "0"),
    ("cent", "unit", "0.01", "0"),
    ("thousand", "unit", "1000", "0"),
    ("million", "thousand", "1000", "0"),
    ("million", "unit", "1000000", "0"),
    ("billion", "million", "1000", "0"),
)
TARGETS = ("fraction", "unit")


def conversions(edges=EDGES, targets=TARGETS) -> list[tuple[str, str, Fraction, Fraction]]:
    """(unit, target, factor, offset) of the shortest composition from each unit to each target that it reaches.

    Edges work both ways. Raises ValueError if two paths between units disagree, or if an edge can't be inverted.
    """
    graph: dict[str, list[tuple[str, Fraction, Fraction]]] = {}
    for u, v, a, b in edges:
        a, b = Fraction(a), Fraction(b)
        if not a:
            raise ValueError(f"{u} -> {v} can't be inverted")
        graph.setdefault(v, []).append((u, a, b))  # walked from the target backwards
        graph.setdefault(u, []).append((v, 1 / a, -b / a))
    out = []
    for target in targets:
        best = {target: (Fraction(1), Fraction(0))}
        todo = deque([target])
        while todo:
            v = todo.popleft()
            a2, b2 = best[v]
            for u, a, b in graph.get(v, []):
                step = (a2 * a, a2 * b + b2)
                if u not in best:
                    best[u] = step
                    todo.append(u)
                elif best[u] != step:
                    raise ValueError(f"paths from {u} to {target} disagree")
        out += [(u, target, a, b) for u, (a, b) in best.items()]
    return out


def conversion_table(spark: SparkSession) -> DataFrame:
    """One row per unit: its size is that of the list of units."""
    rows = [(u, t, format(float(a), ".12f"), format(float(b), ".12f")) for u, t, a, b in conversions()]
    values = ", ".join(f"('{u}', '{t}', {a}BD, {b}BD)" for u, t, a, b in rows)
    return spark.sql(
        f"SELECT unit AS _unit, target AS _target, CAST(factor AS DECIMAL(20,8)) AS _factor, CAST(shift AS DECIMAL(20,8)) AS _shift FROM VALUES {values} AS t(unit, target, factor, shift)"
    )


_NUMBER = r"[0-9](?:[0-9 .,'’]*[0-9])?"
_MONEY = r"(?:eur|€|euros?|usd|us\$|\$|dollars?(?: us)?|gbp|£|jpy|¥|yens?|chf|francs?(?: suisses?)?)"

# Words of units and currencies, on lower-case text without accents.
_NO_FEE = r"^(?:aucune?|neant|none|nil|pas de frais|sans frais|no fees?|keine?|ninguno|ninguna|gratuit|0)$"
_PER = r"(?:per|pour|par tranche de|for|je|por|por cada|pro)"
_PERCENT = r"%|\bpct\b|\bp\.? ?cent\b|\bpour ?cent\b|\bper ?cent\b|\bprozent\b|\bpor ciento\b"
_PERMILLE = r"‰|\bpour mille\b|\bp\.? ?mille\b|\bper mille\b|\bpromille\b|\bpor mil\b"
_BP = r"\bbps?\b|\bpbs?\b|\bbasis points?\b|\bpoints? de base\b|\bbasispunkte?\b|\bpuntos basicos\b"
_QUALIFIERS = r"\bmax(?:imum|\.)?|\bjusqu'a|\bau plus|\bl'an\b|\bp\.a\.|\bpar an\b"
_CURRENCIES = (
    ("USD", r"\busd\b|us\$|\$|\bdollars?\b|\busc\b|\bus cents?\b|\bcents? us\b|usd\b"),
    ("GBP", r"gbp\b|£|\bgbx\b|\bpence\b|\bpenny\b|^p$|\blivres?\b"),
    ("JPY", r"jpy\b|¥|yens?\b"),
    ("CHF", r"chf\b|francs? suisses?\b|\brappen\b"),
    ("EUR", r"eur\b|€|euros?\b"),
)
_SCALES = (
    ("cent", r"\bcents?\b|\bcentimes?\b|\busc\b|\bgbx\b|\bpence\b|\bpenny\b|^p$|\brappen\b"),
    ("thousand", r"\bmilliers?\b|\bthousands?\b|\btsd\b|\bmille\b|\btausend\b|\bk\b|\bk" + _MONEY + r"|\bk(?=€|£|¥)"),
    ("billion", r"\bmilliards?\b|\bmds?\b|\bmrd\b|\bbn\b|\bbillions?\b"),
    ("million", r"\bmillions?\b|\bmln\b|\bmio\b|\bmm?\b|\bm" + _MONEY + r"|\bm(?=€|£|¥)"),
)


def _first(text: Column, table) -> Column:
    out = None
    for name, pattern in table:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out


def _decimal(text: Column, mark: Column, kind: str) -> Column:
    """A number whose decimal mark is ``mark``; any other mark only groups digits. More than one decimal mark, or a mark where ``mark`` is unknown, gives null."""
    comma = F.translate(F.translate(text, " .'’", ""), ",", ".")
    point = F.translate(text, " ,'’", "")
    return F.when(mark == ",", comma).when((mark == ".") | ~text.rlike("[.,]"), point).try_cast(kind)


def quantities(
    spark: SparkSession, rows: DataFrame, cell: str, sources: DataFrame, kind: str, source_col: str = "extracted_by", currency_col: str = "devise"
) -> DataFrame:
    """Adds ``quantity`` (decimal, in fractions for ``kind`` fee and in whole currency units for ``kind`` amount), ``currency`` and ``is_amount``.

    ``sources``: source_code, decimal_mark, fee_unit, amount_unit. A number
    without unit or currency takes the source's unit; with a currency but
    no scale it is in whole units of it; a currency not stated is the row's.
    Fees: "no fee" is 0, an amount per base its ratio, a flat amount null.
    Null, blank and wordy cells, and rows of an unknown source without unit, give null.
    The sources are broadcast behind a check of their number, the conversions as their size is that of the list of units.
    Columns of ``rows`` named quantity, currency or is_amount are replaced.
    """
    src = sources.groupBy(F.col("source_code").alias("_src")).agg(
        F.first("decimal_mark").alias("_mark"), F.first("fee_unit" if kind == "fee" else "amount_unit").alias("_own")
    )
    x = rows.join(bounded_broadcast(src, sources), F.col(source_col) == F.col("_src"), "left")
    x = x.withColumn("_t", tidy(F.col(cell)))
    t = F.col("_t")
    x = x.withColumn("_n", F.regexp_extract(t, _NUMBER, 0)).withColumn(
        "_rest", F.trim(F.regexp_replace(F.regexp_replace(t, _NUMBER, " "), " {2,}", " "))
    )
    n, rest, mark = F.col("_n"), F.col("_rest"), F.col("_mark")
    if kind == "fee":
        based = "^[^0-9]*" + _NUMBER + " ?" + _MONEY + " " + _PER + r" (" + _NUMBER + ") ?" + _MONEY
        base = _decimal(F.regexp_extract(t, based, 1), mark, "decimal(12,2)")
        value = _decimal(n, mark, "decimal(18,8)")
        ratio = F.when(base > 0, F.try_divide(value, base))
        bare = F.trim(F.regexp_replace(rest, _QUALIFIERS, " ")) == ""
        unit = (
            F.when(rest.rlike(_PERMILLE), "permille").when(rest.rlike(_BP), "bp").when(rest.rlike(_PERCENT), "percent").when(bare, F.col("_own"))
        )
        x = x.withColumn("_ratio", F.when(t.rlike(_NO_FEE), F.lit(0).cast("decimal(33,12)")).when(t.rlike(based), ratio.cast("decimal(33,12)")))
        x = x.withColumn("_u", F.when(F.col("_ratio").isNull() & (n != ""), unit)).withColumn("_v", value)
        x = x.withColumn("currency", F.lit(None).cast("string"))
    else:
        stated = _first(rest, _CURRENCIES)
        unit = F.coalesce(_first(rest, _SCALES), F.when(stated.isNotNull(), "unit"), F.when(rest == "", F.col("_own")))
        x = x.withColumn("_ratio", F.lit(None).cast("decimal(33,12)"))
        x = x.withColumn("_u", F.when(n != "", unit)).withColumn("_v", _decimal(n, mark, "decimal(20,8)"))
        x = x.withColumn("currency", F.coalesce(stated, F.upper(F.trim(currency_col))))
    target = "fraction" if kind == "fee" else "unit"
    table = conversion_table(spark).where(F.col("_target") == target).drop("_target")
    x = x.join(F.broadcast(table), F.col("_u") == F.col("_unit"), "left")
    converted = (F.col("_v").cast("decimal(20,8)") * F.col("_factor") + F.col("_shift")).cast("decimal(33,12)")
    x = x.withColumn("quantity", F.coalesce("_ratio", converted))
    x = x.withColumn("currency", F.when(F.col("quantity").isNotNull(), F.col("currency"))).withColumn("is_amount", F.lit(kind == "amount"))
    return x.drop("_src", "_mark", "_own", "_t", "_n", "_rest", "_ratio", "_u", "_v", "_unit", "_factor", "_shift")


def same_quantity_pairs(rows: DataFrame, id_col: str, cell: str, field_col: str) -> DataFrame:
    """(field, id_a < id_b) of rows of one isin and field with the same quantity, and for amounts the same currency, in strings that differ.

    ``rows`` went through ``quantities``, where a fee has no ``currency`` and ``is_amount`` is false. Null isins and quantities give none, nor do
    amounts whose currency isn't known. Copies of one cell aren't compared with each other (``differing_pairs``).
    """
    currency = F.when(F.col("is_amount"), F.col("currency")).otherwise(F.lit(""))
    keyed = rows.select(
        F.col(id_col).alias("id"), F.col(field_col).alias("field"), F.col("isin").alias("_isin"), F.col("quantity").alias("_quantity"), currency.alias("_currency"), F.col(cell).alias("stored")
    )
    return differing_pairs(keyed.dropna(), ["field", "_isin", "_quantity", "_currency"], ("field",))
