"""Text of models and reports to values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_in(text: Column) -> Column:
    """The JSON of an answer: inside a fence if there is one, else from the first bracket to the last."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(text)
    return F.nullif(F.regexp_extract(body, r"(?s)([\[{].*[\]}])", 1), F.lit(""))


def parse_json(text: Column, schema: str) -> Column:
    """``json_in`` with a schema; what doesn't parse is null."""
    return F.from_json(json_in(text), schema, {"mode": "PERMISSIVE"})


def report_answers(report: Column) -> Column:
    """(id, body) of each section of a Markdown report that is headed by an id such as ``## g12``."""
    parts = F.filter(F.split(report, r"\n## (?=g\d)"), lambda p: p.rlike(r"^(?:## )?g\d"))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^(?:## )?(g\d+)", 1).alias("id"), F.trim(F.regexp_replace(p, r"^(?:## )?g\d+[^\n]*\n?", "")).alias("body")))


def shorten(text: Column, most: int) -> Column:
    """At most ``most`` characters, cut at a word."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(F.left(t, F.lit(most)), r"\s\S*$", ""), F.lit("…")))


def clean_field(text: Column, most: int = 120) -> Column:
    """A field of a summary: N/A for null, blank and serialised lists or maps, else cut at a word."""
    bad = text.isNull() | (F.trim(text) == "") | text.rlike(r"^\s*[\{\[']")
    return F.when(bad, "N/A").otherwise(shorten(text, most))


def numeric_match(found: Column, value: Column, tolerance: float = 0.02) -> Column:
    """Whether an array of numbers holds ``value``, as it is, times 100 or negated, within 2 % or up to rounding at 0 to 4 decimals."""
    wanted = F.array(value, value * 100, -value, value * -100)

    def fits(g: Column, e: Column) -> Column:
        close = F.abs(g - e) <= F.abs(e) * tolerance
        for k in range(5):
            close = close | ((F.bround(e, k) == g) & (g != 0))
        return close

    return F.exists(found, lambda g: F.exists(wanted, lambda e: fits(g, e)))


def sfdr_near(text: Column) -> Column:
    """Article 9, 8 or 6 within 200 characters of the first of each trigger."""
    found = None
    windows = []
    for trigger in ("sfdr", "2019/2088", "durabilite"):
        at = F.locate(trigger, F.lower(text))
        windows.append(F.when(at > 0, F.substring(text, F.greatest(at - 200, F.lit(1)), F.lit(400))))
    near = F.concat_ws(" ", *windows)
    for n in ("9", "8", "6"):
        hit = near.rlike(rf"(?i)art(?:icle|\.)?\s*{n}\b")
        found = F.when(hit, f"Article {n}") if found is None else found.when(hit, f"Article {n}")
    return found
